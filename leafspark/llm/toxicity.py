"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is a learned vector of the word (if it is in the vocabulary) beside the sum of learned vectors of its
runs of four characters (bytes, with the word's borders). Both start from how much more often toxic texts have them. Both directions run over windows of WINDOW words, STRIDE apart; attention pools the states of a
window, and a text scores as its worst window. What a word adds to the gates depends on the word alone, so it is
computed once for each different word of a block. All windows of a whole text are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafspark.llm.shared import pick, write_table

WINDOW, STRIDE = 64, 48
HIDDEN, WORD_DIM, CHAR_DIM, BUCKETS = 8, 8, 8, 16384
#: Bounds of what is learned from: labelled rows (lowest hashes of doc_id first), words of the vocabulary, windows a row.
SAMPLE, VOCABULARY, PER_ROW = 5000, 3000, 2
#: Words and runs whose odds are not at least so many deviations from even start as any other.
CLEAR = 4.0
EPOCHS, BATCH, RATE = 5, 320, 0.005
#: Words and windows that are held at once while scoring.
BLOCK_WORDS, BLOCK_WINDOWS, CACHE_WORDS, PART_CHARS = 400_000, 2048, 200_000, 200_000
_word = re.compile(r"\w+")


def word_lists(text: str) -> Iterator[list[str]]:
    """The lower-cased words of a text, in parts of limited size that end between words."""
    text, at = text.lower(), 0
    while at < len(text):
        end = at + PART_CHARS
        if end < len(text):
            last = _word.match(text, end)
            end = last.end() if last else end
        yield _word.findall(text, at, min(end, len(text)))
        at = end


def window_places(n: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows of n words; none for no words."""
    return [(s, min(s + WINDOW, n)) for s in range(0, max(n - WINDOW + STRIDE, 1), STRIDE)] if n else []


def runs_of_four(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of four bytes of each word with its borders, and where each word's begin."""
    parts = [b"\x02" + w.encode() + b"\x03" for w in words]
    parts = [w if len(w) > 3 else w + b"\x03" for w in parts]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    code = (((data[:-3] * 257 + data[1:-2]) * 257 + data[2:-1]) * 257 + data[3:]) * 2654435761 % 4294967296 * BUCKETS >> 32
    ends = np.cumsum(sizes)[:-1]
    keep = np.ones(len(data) - 3, bool)
    for back in (1, 2, 3):
        keep[ends - back] = False
    return code[keep], np.concatenate(([0], np.cumsum(sizes - 3)[:-1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, the forward pass and its gradients."""

    def __init__(self, vocabulary: dict[str, int], odds: np.ndarray, char_odds: np.ndarray | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary  # word to row of "word"; row 0 is any other word
        width = WORD_DIM + CHAR_DIM
        p = {"word": rng.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM)), "char": rng.normal(0, 0.1, (BUCKETS, CHAR_DIM)),
             "W": rng.normal(0, width ** -0.5, (2, width, 3 * HIDDEN)), "U": rng.normal(0, HIDDEN ** -0.5, (2, HIDDEN, 3 * HIDDEN)), "b": np.zeros((2, 1, 3 * HIDDEN)),
             "attend": rng.normal(0, 0.3, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        p["word"] *= 0.1
        p["char"] *= 0.1
        p["word"][1:, 0] = np.clip(odds, -3, 3)
        if char_odds is not None:
            p["char"][:, 0] = np.clip(char_odds, -3, 3)
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        rows = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        bucket, starts = runs_of_four(words)
        sizes = np.diff(np.append(starts, len(bucket)))
        chars = np.add.reduceat(self.p["char"][bucket], starts, axis=0)
        return np.concatenate((self.p["word"][rows], chars), 1).astype(np.float32), (rows, bucket, sizes)

    def gates(self, words: list[str]) -> np.ndarray:
        """(2, words, 3 * HIDDEN): what each word adds to the gates of each direction."""
        x, _ = self.inputs(words)
        return x @ self.p["W"] + self.p["b"]

    def states(self, gates: np.ndarray, places: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(steps, windows, 2 * HIDDEN) from word places (windows, steps); past a window's length states do not move."""
        n, steps = places.shape
        H, U = HIDDEN, self.p["U"]
        h, out = np.zeros((2, n, H), np.float32), np.empty((steps, n, 2 * H), np.float32)
        full = bool((lengths == steps).all())
        x = np.empty((2, n, 3 * H), np.float32)
        for s in range(steps):
            at = (s, steps - 1 - s)
            for d in (0, 1):
                np.take(gates[d], places[:, at[d]], axis=0, out=x[d])
            u = h @ U
            zr = sigmoid(x[..., :2 * H] + u[..., :2 * H])
            z, r = zr[..., :H], zr[..., H:]
            m = np.tanh(x[..., 2 * H:] + r * u[..., 2 * H:])
            new = m + z * (h - m)
            on = None
            if not full:
                on = np.stack([at[d] < lengths for d in (0, 1)]).astype(np.float32)[..., None]
                new = h + on * (new - h)
            if keep is not None:
                keep.append((h, u[..., 2 * H:], z, r, m, on))
            h = new
            out[at[0], :, :H], out[at[1], :, H:] = h[0], h[1]
        return out

    def pooled(self, states: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, attention weights and pooled states."""
        weight = states @ self.p["attend"]
        weight[np.arange(len(states))[:, None] >= lengths] = -np.inf
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pool = np.einsum("tn,tnh->nh", weight, states)
        return pool @ self.p["out"] + self.p["bias"], weight, pool

    def logits(self, gates: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.pooled(self.states(gates, places, lengths), lengths)[0]

    def loss_and_slopes(self, words: list[str], places: np.ndarray, lengths: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, dict]:
        """Weighted cross entropy of a batch and its gradients by back propagation through time."""
        H, p = HIDDEN, self.p
        x, (rows, bucket, sizes) = self.inputs(words)
        gates, keep = x @ p["W"] + p["b"], []
        states = self.states(gates, places, lengths, keep)
        logit, weight, pool = self.pooled(states, lengths)
        chance = 1 / (1 + np.exp(-logit.astype(np.float64)))
        loss = float(-(weights * (y * np.log(chance + 1e-12) + (1 - y) * np.log(1 - chance + 1e-12))).sum() / weights.sum())
        up = ((chance - y) * weights / weights.sum()).astype(np.float32)
        g = {"bias": up.sum(keepdims=True), "out": pool.T @ up}
        d_pool = up[:, None] * p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pool, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["attend"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = weight[..., None] * d_pool + d_score[..., None] * p["attend"]
        g["U"], d_gates = np.zeros_like(p["U"]), np.zeros_like(gates)
        carry, steps = np.zeros((2, len(y), H), np.float32), places.shape[1]
        for s in reversed(range(steps)):
            h, un, z, r, m, on = keep[s]
            at = (s, steps - 1 - s)
            d_h = carry + np.stack((d_states[at[0], :, :H], d_states[at[1], :, H:]))
            d_new = d_h if on is None else d_h * on
            d_m = d_new * (1 - z) * (1 - m * m)
            d_z = d_new * (h - m) * z * (1 - z)
            d_r = d_m * un * r * (1 - r)
            d_u = np.concatenate((d_z, d_r, d_m * r), 2)
            d_x = np.concatenate((d_z, d_r, d_m), 2)
            g["U"] += np.swapaxes(h, 1, 2) @ d_u
            carry = d_h - d_new + d_new * z + d_u @ np.swapaxes(p["U"], 1, 2)
            for d in (0, 1):
                np.add.at(d_gates[d], places[:, at[d]], d_x[d])
        g["W"], g["b"] = x.T @ d_gates, d_gates.sum(1, keepdims=True)
        d_in = (d_gates @ np.swapaxes(p["W"], 1, 2)).sum(0)
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], rows, d_in[:, :WORD_DIM])
        np.add.at(g["char"], bucket, np.repeat(d_in[:, WORD_DIM:], sizes, axis=0).astype(np.float32))
        return loss, g

    def train(self, windows: list[list[str]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        """Adam; the rarer class gets as much weight as the other."""
        rng, first, second, t = np.random.default_rng(seed), {}, {}, 0
        weights = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                part = order[at:at + BATCH]
                numbers: dict[str, int] = {}
                places, lengths = padded([[numbers.setdefault(w, len(numbers)) for w in windows[i]] for i in part])
                _, g = self.loss_and_slopes(list(numbers), places, lengths, y[part], weights[part])
                t += 1
                for k, slope in g.items():
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * slope
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * slope * slope
                    self.p[k] -= (RATE * first[k] / (1 - 0.9 ** t) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)


def padded(rows: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], np.int64)
    places = np.zeros((len(rows), max(int(lengths.max()), 1)), np.int32)
    for i, r in enumerate(rows):
        places[i, :len(r)] = r
    return places, lengths


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Network:
    """Train on at most `sample` labelled rows that are not held out.

    The vocabulary is the words whose share of documents differs most between the classes. Of each row the windows
    whose words have the highest odds are learned from, since a toxic text is mostly not toxic everywhere. Without two
    classes the network scores the smoothed share of ones.
    """
    known = pick(labels, label_id="doc_id", toxic="toxic").where("label_id is not null and toxic is not null").where(~held_out(F.col("label_id")))
    known = known.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(sample)
    src = pick(docs, doc_id=id_col, text=text_col)
    rows = write_table(src.join(F.broadcast(known), src.doc_id == known.label_id).select(F.col("text"), F.col("toxic").cast("int").alias("toxic")), "toxicity-sample")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    if not ones or not zeros:
        net = Network({}, np.zeros(0))
        net.p["out"][:] = 0
        net.p["bias"][:] = np.log((ones + 1) / (zeros + 1))
        return net

    def own_units(batches):
        for batch in batches:
            units, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {w for part in word_lists(text or "") for w in part}
                own |= {f"\x02{b}" for b in np.unique(runs_of_four(list(own))[0]).tolist()} if own else set()
                units += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(toxic, pa.int32())], ["unit", "toxic"])
    counts = rows.mapInArrow(own_units, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("ones"), F.count("*").alias("n")).where("n >= 4")
    odds = (F.log((F.col("ones") + 0.5) / (ones + 1)) - F.log((F.col("n") - F.col("ones") + 0.5) / (zeros + 1))) * F.col("n") / (F.col("n") + 20)
    counts = write_table(counts.select("unit", odds.alias("odds"), (F.abs(odds) * F.sqrt("n")).alias("weight")).where(F.col("weight") >= CLEAR), "toxicity-units")
    chosen = counts.where("unit not like '\x02%'").orderBy(F.desc("weight"), "unit").limit(VOCABULARY).collect()
    ratio = {r["unit"]: r["odds"] for r in chosen}
    char_odds = np.zeros(BUCKETS)
    for r in counts.where("unit like '\x02%'").select("unit", "odds").collect():  # at most BUCKETS rows
        char_odds[int(r["unit"][1:])] = r["odds"]

    net = Network({w: i + 1 for i, w in enumerate(ratio)}, np.array(list(ratio.values())), char_odds)

    def by_odds(words: list[str], places: list[tuple[int, int]]) -> np.ndarray:
        bucket, starts = runs_of_four(words)
        worth = np.add.reduceat(char_odds[bucket], starts) + np.array([ratio.get(w, 0.0) for w in words])
        total = np.concatenate(([0.0], np.cumsum(np.maximum(worth, 0))))
        return np.array([total[b] - total[a] for a, b in places])

    def by_network(words: list[str], places: list[tuple[int, int]]) -> np.ndarray:
        numbers: dict[str, int] = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in words]
        return net.logits(net.gates(list(numbers)), *padded([ids[a:b] for a, b in places]))

    table = None
    for rank in (by_odds, by_network):  # the second round learns from what the first mistook
        found = rows.mapInArrow(_windows_by(rank), "words array<string>, toxic int").orderBy(F.xxhash64("words")).toPandas()
        table = found if table is None else pd.concat((table, found))
        if len(table):
            net.train([list(w) for w in table["words"]], table["toxic"].to_numpy(np.float64))
    return net


def _windows_by(rank):
    """Of each row the best window, and of a row of zeros PER_ROW: what a text without toxic windows has at worst."""
    def run(batches):
        for batch in batches:
            found, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for part in word_lists(text or "") for w in part]
                places = window_places(len(words))
                for i in np.argsort(-rank(words, places), kind="stable")[:1 if label else PER_ROW] if places else []:
                    found.append(words[places[i][0]:places[i][1]])
                    toxic.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), pa.array(toxic, pa.int32())], ["words", "toxic"])
    return run


class _Numbers(dict):
    """Words by order of arrival."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class _Scorer:
    """Scores texts of one task; words that were met keep their gates until the store is full."""

    def __init__(self, net: Network):
        self.net, self.numbers, self.gates = net, _Numbers(), None

    def texts(self, texts: Iterator[str]) -> np.ndarray:
        out, places, ends, owner, held = [], [], [], [], 0
        for text in texts:
            parts = [np.fromiter(map(self.numbers.__getitem__, part), np.int32, len(part)) for part in word_lists(text)]
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            for a, b in window_places(len(ids)):
                places.append(ids[a:b])
                owner.append(len(ends))
            ends.append(0)
            held += len(ids)
            if held >= BLOCK_WORDS:
                out.append(self._flush(places, owner, len(ends)))
                places, ends, owner, held = [], [], [], 0
        out.append(self._flush(places, owner, len(ends)))
        return np.concatenate(out)

    def _flush(self, places: list[np.ndarray], owner: list[int], n: int) -> np.ndarray:
        if self.numbers.new:
            fresh = self.net.gates(self.numbers.new)
            self.gates = fresh if self.gates is None else np.concatenate((self.gates, fresh), 1)
            self.numbers.new = []
        best = np.full(n, -np.inf)
        order = np.argsort([-len(p) for p in places], kind="stable")
        for at in range(0, len(order), BLOCK_WINDOWS):
            part = order[at:at + BLOCK_WINDOWS]
            spots, lengths = padded([places[i] for i in part])
            np.maximum.at(best, np.array(owner)[part], self.net.logits(self.gates, spots, lengths))
        best[np.isinf(best)] = float(self.net.p["bias"][0])  # no words
        if len(self.numbers) > CACHE_WORDS:
            self.numbers, self.gates = _Numbers(), None
        return 1 / (1 + np.exp(-best))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a text without words scores as the bias alone does."""
    src = pick(docs, doc_id=id_col, text=text_col)

    def run(batches):
        scorer = _Scorer(net)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.texts(t.as_py() or "" for t in batch.column(1)), pa.float64())], ["doc_id", "score"])
    scored = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
