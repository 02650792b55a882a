"""Quality by a sparse rule ensemble: paths of small boosted trees become rules over text statistics, a lasso logistic
fit weighs them, and the rules that keep a weight are compiled into one Spark column."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from leafspark.llm.boosting import grow, holds
from leafspark.llm.shared import let, pick

#: The bound of the labelled sample that the classifier is fitted on (rows, lowest hashes of doc_id first).
SAMPLE = 10_000
ROUNDS, DEPTH, BINS, PENALTY = 24, 3, 32, 2e-4


def statistics(text: Column) -> dict[str, Column]:
    """Shares and means of a whole text; an empty or null text has zeros."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    chars, words = F.greatest(F.length(t), F.lit(1)).cast("double"), F.greatest(count(r"\S++"), F.lit(1.0))
    return {"n_chars": F.length(t).cast("double"), "word_length": chars / words, "symbols": count(r"[^\p{L}\p{N}\s.,;:'\"()-]") / chars, "capitals": count(r"\p{Lu}") / chars,
            "digits": count("[0-9]") / chars, "stops": count("[.,;:]") / words, "repeats": count(r"(?<!\S)(\S++)\s++\1(?!\S)") / words}


FEATURES = ["n_chars", "word_length", "symbols", "capitals", "digits", "stops", "repeats"]


@dataclass
class Rules:
    """Each rule: a weight and its conditions (feature, above, limit); a rule holds if all conditions do."""
    bias: float = 0.0
    rules: list[tuple[float, list[tuple[str, bool, float]]]] = field(default_factory=list)

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(float(self.bias))
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for name, above, limit in conditions:
                holds = holds & ((stats[name] > limit) if above else (stats[name] <= limit))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = PENALTY, steps: int = 600) -> Rules:
    """Rules of a labelled sample. Without rows the score is one half, with one class only its smoothed share."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Rules(float(np.log(share / (1 - share))))
    paths = list(dict.fromkeys(tuple(sorted(set(path))) for _, inner in grow(x, y, ROUNDS, DEPTH, BINS)[1] for path in inner))
    full = np.stack([np.ones(len(y))] + [holds(x, path) for path in paths], 1).astype(np.float64)
    rate = 4 * len(y) / np.linalg.eigvalsh(full.T @ full)[-1]
    w = ahead = np.zeros(full.shape[1])
    momentum = 1.0
    for _ in range(steps):  # accelerated proximal gradient; the intercept has no penalty
        p = 1 / (1 + np.exp(-full @ ahead))
        new = ahead + rate * (full.T @ (y - p)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return Rules(float(w[0]), [(float(v), [(names[j], above, c) for j, above, c in path]) for v, path in zip(w[1:], paths) if abs(v) > 1e-4])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Rules:
    """Fit on at most `sample` labels that are not held out; a null label or doc_id is not used. Of rows that repeat a
    labelled doc_id at most four times as many are taken, in the order of a hash of their statistics; null and empty texts
    have zero statistics. An empty table gives rules without rows (a score of one half)."""
    known = pick(labels, label_id="doc_id", quality="quality").where("label_id is not null and quality is not null").where(~held_out(F.col("label_id")))
    known = known.orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(sample)
    src = pick(docs, doc_id=id_col, text=text_col)
    rows = src.join(F.broadcast(known), src.doc_id == known.label_id).select("quality", *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    rows = rows.orderBy(F.xxhash64("quality", *FEATURES)).limit(4 * sample).toPandas()
    return fit(rows[FEATURES].to_numpy(np.float64), rows["quality"].to_numpy(np.float64), FEATURES)


def score(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts are scored by their zero statistics."""
    src = pick(docs, doc_id=id_col, text=text_col)
    stats = src.select("doc_id", *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rules.score({n: F.col(n) for n in FEATURES}).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules score at one half or more, with all their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    stats = statistics(F.col(f"c{names.index(text_col)}"))
    # Without let() the filter would be pushed below the statistics and repeat their patterns for each condition.
    row = F.struct(*[c.alias(n) for n, c in stats.items()])
    return plain.where(let(row, lambda s: rules.score({n: s[n] for n in FEATURES})) >= 0.5).toDF(*names)
