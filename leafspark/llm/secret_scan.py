"""Secrets in texts: fixed patterns, and spans that a pair of character Markov models finds. DataFrame functions only.

Places come from splitting: the pieces between a pattern's matches and the matches themselves, in order, give by their
lengths where each match starts (code points). The models are tables of how often a character follows another in random
strings and in ordinary identifiers; the log-likelihood ratio of a candidate is the sum over its pairs. Both are
counted from samples that the corpus itself labels: values of the fixed patterns, and words of several documents' prose.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leafspark.llm.shared import let, pick

#: The fixed patterns: kind, Java pattern, the group whose length counts, least length. Order is the order of kinds.
KINDS = [
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24)]  # the same as its runs of any length, short ones dropped
#: Candidates of the models: runs of letters, digits and the signs of encoded keys, with a letter and a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+"
CANDIDATE_LEAST = 16
#: Ordinary identifiers to count from.
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_]{3,}+"
#: Letters and digits are states of their own, everything else is one more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
SIZE = len(ALPHABET) + 1
#: The bound of the sample that the models are counted from (documents, lowest hashes of doc_id first).
SAMPLE = 4000
#: A candidate is a secret from this log-likelihood ratio on: in total, and for each pair of characters.
TOTAL_RATIO, MEAN_RATIO = 14.0, 0.7
#: Weight of the single characters' shares in a pair's chance.
LEAN = 10
#: No pair counts for more than this, so that one rare pair decides nothing.
CLIP = 3.0
#: Places of an array that are summed up at a time.
RUN = 64
SPAN = "array<struct<start:int,order:int,kind:string,end:int>>"


def running(values: Column, levels: int = 3) -> Column:
    """The sum up to and with each place of an array of ints that is not empty: sums of runs of RUN places, then of runs
    of runs, so that no place walks through more than RUN values on a level."""
    add = lambda v: F.aggregate(v, F.lit(0), lambda total, x: total + x)
    if not levels:
        return let(values, lambda v: F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: add(F.slice(v, 1, i))))

    def by_runs(v):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda r: add(F.slice(v, r * RUN + 1, RUN)))

        def placed(r, sums):
            def at(i):
                run = F.floor((i - 1) / RUN).cast("int")
                return F.element_at(sums, run + 1) - F.element_at(r, run + 1) + add(F.slice(v, run * RUN + 1, i - run * RUN))
            return F.transform(F.sequence(F.lit(1), F.size(v)), at)
        return let(runs, lambda r: let(running(r, levels - 1), lambda sums: placed(r, sums)))
    return let(values, by_runs)


def spans(text: Column, pattern: str, group: int, least: int, kind: str, order: int, guard: Column, wanted=None) -> Column:
    """Array of (start, order, kind, end), in order, of the matches whose group has at least the length; none without the
    guard. wanted(span, match) may drop more of them."""
    lengths = lambda strings: F.transform(strings, lambda m: F.length(m))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = lengths(matches)
    held = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else sizes
    gaps = lengths(F.split(text, pattern))  # one more than the matches

    def placed(parts):
        ends = running(F.transform(parts, lambda p: p["gap"] + p["size"]))
        found = F.transform(F.arrays_zip(parts.alias("p"), ends.alias("end")), lambda r: F.struct(
            (r["end"] - r["p"]["size"]).alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), r["end"].alias("end"), *[r["p"][c].alias(c) for c in ("held", "match")]))
        kept = F.filter(found, lambda r: (r["held"] >= least) & (wanted(r, r["match"]) if wanted else F.lit(True)))
        return F.transform(kept, lambda r: F.struct(r["start"].alias("start"), r["order"].alias("order"), r["kind"].alias("kind"), r["end"].alias("end")))
    parts = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), held.alias("held"), (matches if wanted else F.array().cast("array<string>")).alias("match")), lambda r: r["size"].isNotNull())
    found = let(parts, lambda p: F.when(F.size(p) > 0, placed(p)))
    return F.coalesce(F.when(guard, found).otherwise(F.lit(None).cast(SPAN)), F.array().cast(SPAN))


def overlaps(found: Column, span: Column) -> Column:
    """Whether a span overlaps one of a sorted array of spans that do not overlap: the last that starts before its end, by halving."""
    last = F.aggregate(F.array(*[F.lit(1 << k) for k in range(26, -1, -1)]), F.lit(0), lambda at, k: F.when(
        (at + k <= F.size(found)) & (F.element_at(found, F.least(at + k, F.size(found)))["start"] < span["end"]), at + k).otherwise(at))
    return F.when(F.size(found) > 0, let(last, lambda at: (at > 0) & (F.element_at(found, F.greatest(at, F.lit(1)))["end"] > span["start"]))).otherwise(F.lit(False))


def base_spans(text: Column) -> list[Column]:
    """The spans of each fixed kind."""
    guards = [F.regexp_like(text, F.lit(r"(?i)password|passwd|secret|token|api_?key")), text.contains("AKIA"), F.regexp_like(text, F.lit(KINDS[2][1]))]
    return [spans(text, pattern, group, least, kind, i, guard) for i, ((kind, pattern, group, least), guard) in enumerate(zip(KINDS, guards))]


def sample_of(docs: DataFrame, sample: int) -> DataFrame:
    """At most `sample` rows (doc_id, text) by hash of doc_id; only identifiers are ordered, texts are then fetched."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "chosen")
    return docs.join(F.broadcast(ids), docs.doc_id == F.col("chosen")).select("doc_id", "text")


def with_values(docs: DataFrame) -> DataFrame:
    """The rows in which a fixed pattern finds a value that is long enough to count from."""
    longer = [r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{%d}" % CANDIDATE_LEAST, r"AKIA[A-Z0-9]{%d}" % (CANDIDATE_LEAST - 4), KINDS[2][1]]
    return docs.where(reduce(lambda x, y: x | y, [F.regexp_like("text", F.lit(pattern)) for pattern in longer]))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[float]:
    """ratio[SIZE * a + b]: log of the chance that b follows a in random strings over that in ordinary identifiers.

    Random strings are the values that the fixed patterns find in at most `sample` of the documents that have some
    (so rare secrets are found wherever they are), identifiers the words of as many documents, without such values and
    without candidates; each different one counts once. At most 2 * SIZE * SIZE counts come to the driver. Rows without
    doc_id are not sampled, null and empty texts have no words. Without values or words all ratios are zero.
    """
    every = pick(docs, doc_id=id_col, text=text_col)
    src = sample_of(every, sample)
    values = [F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) for _, pattern, group, _ in KINDS]
    random = sample_of(with_values(every), sample).select(F.explode(F.concat(*values)).alias("word")).where(F.length("word") >= CANDIDATE_LEAST)
    prose = F.col("text")
    for pattern in [pattern for _, pattern, *_ in KINDS] + [CANDIDATE]:
        prose = F.regexp_replace(prose, pattern, " ")
    plain = src.select(F.explode(F.regexp_extract_all(prose, F.lit(IDENTIFIER), F.lit(0))).alias("word"))
    words = random.distinct().withColumn("kind", F.lit(1)).union(plain.distinct().withColumn("kind", F.lit(0)))
    chars = words.select("kind", F.split("word", "").alias("c"))
    pairs = chars.select("kind", F.explode(F.arrays_zip(F.col("c").alias("a"), F.slice("c", 2, F.size("c")).alias("b"))).alias("p")).where("p.b is not null")
    counted = pairs.groupBy("kind", F.instr(F.lit(ALPHABET), F.col("p.a")).alias("a"), F.instr(F.lit(ALPHABET), F.col("p.b")).alias("b")).count().collect()
    totals = [[[0] * SIZE for _ in range(SIZE)] for _ in range(2)]
    for r in counted:
        totals[r["kind"]][r["a"]][r["b"]] = r["count"]
    if not any(map(any, totals[0])) or not any(map(any, totals[1])):
        return [0.0] * (SIZE * SIZE)
    # A pair's chance leans on how common its second character is among all, the more the rarer the first one is.
    after = [[sum(row[b] for row in rows) for b in range(SIZE)] for rows in totals]
    common = [[(n + 0.5) / (sum(column) + 0.5 * SIZE) for n in column] for column in after]
    chance = lambda kind, a, b: (totals[kind][a][b] + LEAN * common[kind][b]) / (sum(totals[kind][a]) + LEAN)
    return [max(-CLIP, min(CLIP, math.log(chance(1, a, b) / chance(0, a, b)))) for a in range(SIZE) for b in range(SIZE)]


def log_ratio(word: Column, ratio: list[float]) -> Column:
    """The log-likelihood ratio of a string: the sum over its pairs of characters."""
    table = F.split(F.lit(",".join(f"{r:.6f}" for r in ratio)), ",").cast("array<double>")
    states = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(states, lambda s: F.aggregate(F.sequence(F.lit(1), F.size(s) - 1), F.lit(0.0), lambda total, i: total + F.element_at(table, F.element_at(s, i) * SIZE + F.element_at(s, i + 1) + 1)))


def model_spans(text: Column, ratio: list[float], taken: list[Column]) -> Column:
    """Spans of candidates that the models take for secrets and that overlap no span of `taken`, arrays of one kind each."""
    def secret(span, match):
        free = ~reduce(lambda x, y: x | y, [overlaps(found, span) for found in taken])
        return F.when(free, let(log_ratio(match, ratio), lambda total: (total >= TOTAL_RATIO) & (total >= MEAN_RATIO * (F.length(match) - 1)))).otherwise(F.lit(False))
    return spans(text, CANDIDATE, 0, CANDIDATE_LEAST, "model", len(KINDS), F.regexp_like(text, F.lit(CANDIDATE)), secret)


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratio: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of (start, order, kind, end), in order of start and kind, for every row.

    Starts and ends are code points, ends exclusive. base has the fixed patterns' spans (one may lie within another of
    a different kind), added those of the models that overlap none of them. Null and empty texts have none.
    """
    src = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = [f"base{i}" for i in range(len(KINDS))]
    base = src.select("doc_id", "text", *[found.alias(name) for found, name in zip(base_spans(F.col("text")), kinds)])
    return base.select("doc_id", F.sort_array(F.concat(*kinds)).alias("base"), model_spans(F.col("text"), ratio, [F.col(k) for k in kinds]).alias("added"))


def secret_report(docs: DataFrame, ratio: list[float], **names: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model) from the spans of scan."""
    found = scan(docs, ratio, **names)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind, *_ in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_model"))
