"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both token lists of a text are lists of byte ends. As long as the lists agree at the current index shift, tokens stand one
to one: the stretch is measured by probes of doubling length and a search back, whole slices compared at a time. Where
they part, an irregular group is resolved token by token up to the next common end, and the shift becomes what that
group made it. Each pair of tokens whose bytes overlap is a link.

How often two ids are linked is counted by tasks and added up over the corpus. A document is scored with the counts of its
links: those of the most frequent pairs (a fixed number) are sent to all tasks, links of other pairs meet their counts
in a join, so neither table nor broadcast has to hold the whole list of pairs, and the join has no hot key.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from leafspark.llm import bpe
from leafspark.llm.shared import pick, write_table

#: Pairs whose counts every task gets (20 bytes each).
FREQUENT = 200_000
#: Distinct pairs that a task adds up before it hands them on.
HELD_PAIRS = 400_000
#: Texts over so many characters are given to the second tokenizer in parts.
PART = 50_000
_loaded: dict[str, object] = {}


class ByteLevel:
    """The tokens of a byte-level BPE in a tokenizer.json file, special tokens read as plain text.

    The plain form (no normalizer, the usual splitting pattern, no prefix space) runs on tiktoken with the file's
    vocabulary, whose ids rise in the order of the merges; any other on the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"] for t in told["added_tokens"]}
        vocabulary = {token: i for token, i in told["model"]["vocab"].items() if token not in special}
        size = 1 + max([*told["model"]["vocab"].values(), *(t["id"] for t in told["added_tokens"])])
        self.data = [b""] * size
        for token, i in vocabulary.items():
            self.data[i] = bytes(byte_of[c] for c in token)
        split = told["pre_tokenizer"] or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        ids = [vocabulary.get(a + b, -1) for a, b in merges]
        self.plain = told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and ids == sorted(set(ids)) and -1 not in ids
        if self.plain:
            import public_tokenizers
            import tiktoken
            self.engine = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.data[i]: i for i in vocabulary.values()}, special_tokens={})
        else:
            from tokenizers import Tokenizer
            self.engine = Tokenizer.from_file(path)
            self.engine.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.plain:
            return [bpe.encode(text, self.engine) for text in texts]
        return [self.engine.encode(text, add_special_tokens=False).ids for text in texts]


class Pieces:
    """The tokens of a sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        self.engine = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.engine.id_to_piece(i) for i in range(self.engine.get_piece_size())]
        self.data = [bytes([int(n[3:5], 16)]) if self.engine.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        # A long text may be cut at a lone space if no piece has one after something else.
        self.cuts = not any("▁" in n.lstrip("▁") for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = self.engine.encode([t if len(t) <= PART else "" for t in texts], num_threads=1)
        for k, text in enumerate(texts):
            if len(text) > PART:
                parts = self.engine.encode(list(self.parts(text)), num_threads=1)
                out[k] = [i for part in parts for i in part]
        return out

    def parts(self, text: str, size: int = PART) -> Iterator[str]:
        """The text cut at lone spaces, which are left out: the model puts one before each part."""
        start = 0
        if self.cuts:
            for space in re.finditer(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])", text):
                if space.start() - start >= size:
                    yield text[start:space.start()]
                    start = space.end()
        yield text[start:]


def loaded(kind, path: str):
    if path not in _loaded:
        _loaded[path] = kind(path)
    return _loaded[path]


def stretch(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many ends from a[i] and b[j] on agree place by place, if the first do: probes of 2, 4, ... and then half of the
    last, and half of that."""
    n, step = 1, 2
    while True:
        p, q = i + n, j + n
        part = a[p:p + step]
        if not part or part != b[q:q + step]:
            break
        n += len(part)
        step *= 2
    while step > 1:
        step >>= 1
        p, q = i + n, j + n
        part = a[p:p + step]
        if len(part) == step and part == b[q:q + step]:
            n += step
    return n


def groups(a: list[int], b: list[int]) -> list[tuple[int, int, int, int, bool]]:
    """The alignment of two lists of ends that end alike: (i, i2, j, j2, one) in order, stretches of tokens one to one or
    single irregular groups."""
    steps = []
    i = j = 0
    whole = len(a)
    while i < whole:
        p, q, x, y = i, j, a[i], b[j]
        if x == y:
            n = stretch(a, b, i, j)
            p, q = i + n, j + n
            steps.append((i, p, j, q, True))
        else:
            while x != y:
                if x < y:
                    p += 1
                    x = a[p]
                else:
                    q += 1
                    y = b[q]
            p += 1
            q += 1
            steps.append((i, p, j, q, False))
        i, j = p, q
    return steps


def _every(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each low up to its high."""
    many = high - low
    return np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


class Aligned(NamedTuple):
    """Of some texts: their groups, the number of groups, and for each link the text and the ids of both sides."""
    told: list[bytes]
    numbers: np.ndarray
    doc: np.ndarray
    a: np.ndarray
    b: np.ndarray


class Aligner:
    """Token lists of texts, aligned."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = loaded(ByteLevel, path_a), loaded(Pieces, path_b)
        self.lengths = [np.array(list(map(len, t.data)), np.int64) for t in (self.a, self.b)]
        most = max(len(t.data) for t in (self.a, self.b))
        if most > 1 << 20:
            raise ValueError("a vocabulary of over 2^20 tokens")
        width = len(str(most))
        self.digits = [np.array([list(str(i).encode().ljust(width, b"\0")) for i in range(len(t.data))], np.uint8) for t in (self.a, self.b)]

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none where either side's bytes are not those of the text with a space before it."""
        out = []
        spaced = [" " + (t or "") for t in texts]
        for text, whole, a, b in zip(texts, spaced, self.a.encode(spaced), self.b.encode([t or "" for t in texts])):
            data = whole.encode()
            same = text and b"".join(map(self.b.data.__getitem__, b)) == data and b"".join(map(self.a.data.__getitem__, a)) == data
            out.append((a, b) if same else ([], []))
        return out

    def align(self, tokens: list[tuple[list[int], list[int]]]) -> Aligned:
        """The alignment of some texts' tokens; what does not need the walk itself is array arithmetic over all of them."""
        ids = [np.array([i for pair in tokens for i in pair[side]], np.int64) for side in (0, 1)]
        begins = [np.concatenate(([0], np.cumsum(np.array([len(pair[side]) for pair in tokens], np.int64)))) for side in (0, 1)]
        ends = [np.cumsum(size[own]) for size, own in zip(self.lengths, ids)]  # on through all texts, which end alike on both sides
        steps: list[tuple] = []
        sizes = []
        for k in range(len(tokens)):
            found = groups(*[own[at[k]:at[k + 1]].tolist() for own, at in zip(ends, begins)])
            steps += found
            sizes.append(len(found))
        of_step = np.repeat(np.arange(len(tokens)), np.array(sizes, np.int64))
        i, i2, j, j2, one = np.array(steps, np.int64).reshape(-1, 5).T
        i, i2, j, j2 = i + begins[0][of_step], i2 + begins[0][of_step], j + begins[1][of_step], j2 + begins[1][of_step]
        # One entry a group: where it ends on both sides.
        many = np.where(one == 1, i2 - i, 1)
        inside = _every(np.zeros_like(many), many)
        run = np.repeat(one == 1, many)
        last = [np.where(run, np.repeat(low, many) + inside + 1, np.repeat(high, many)) for low, high in ((i, i2), (j, j2))]
        numbers = np.bincount(of_step, many, len(tokens)).astype(np.int64)
        # Links: stretches place by place; in irregular groups each end on either side closes one.
        odd = one == 0
        closed = np.unique(np.concatenate([e[_every(low[odd], high[odd])] for e, low, high in ((ends[0], i, i2), (ends[1], j, j2))]))
        linked = [np.concatenate((np.repeat(low, many)[run] + inside[run], np.searchsorted(e, closed))) for low, e in ((i, ends[0]), (j, ends[1]))]
        doc = np.concatenate((np.repeat(of_step, many)[run], np.searchsorted(begins[0], linked[0][run.sum():], side="right") - 1))
        return Aligned(self._told(ids, last, begins), numbers, doc, ids[0][linked[0]], ids[1][linked[1]])

    def _told(self, ids, ends, begins) -> list[bytes]:
        """Each text's groups as a1,a2|b1;a3|b2,b3: one line of digits and a sign for each token, in the order of the groups."""
        counts = [np.diff(e, prepend=0) for e in ends]
        group = [np.repeat(np.arange(len(c)), c) for c in counts]
        order = [np.arange(len(ids[0])) + (ends[1] - counts[1])[group[0]], np.arange(len(ids[1])) + ends[0][group[1]]]
        width = self.digits[0].shape[1]
        lines = np.zeros((len(ids[0]) + len(ids[1]), width + 1), np.uint8)
        for side, last in ((0, b"|"), (1, b";")):
            lines[order[side], :width] = self.digits[side][ids[side]]
            lines[order[side], width] = np.where(np.arange(len(ids[side])) + 1 == ends[side][group[side]], last[0], ord(","))
        filled = lines != 0
        at = np.concatenate(([0], np.cumsum(filled.sum(1))))[begins[0] + begins[1]]
        data = lines[filled].tobytes()
        return [data[low:max(low, high - 1)] for low, high in zip(at[:-1], at[1:])]


def _counted(a: np.ndarray, b: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, where = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
    sums = np.bincount(where, weights=times, minlength=len(keys)).astype(np.int64)  # exact below 2^53
    return (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), sums


def _counted_each(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct id pairs of each text: (where each text's begin, a, b, times). Ids have up to 20 bits."""
    keys, times = np.unique(found.doc << 40 | found.a << 20 | found.b, return_counts=True)
    return np.searchsorted(keys, np.arange(len(found.told) + 1) << 40), keys >> 20 & 0xFFFFF, keys & 0xFFFFF, times


_LINKS = "a array<int>, b array<int>, times array<bigint>"
_NAMES = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"]


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", held: int = HELD_PAIRS) -> DataFrame:
    """The written table of the alignment: a row for each row of docs, with its distinct linked id pairs and how often each
    occurs in it, and rows with null row that add up the pairs of many documents. held bounds what a task keeps."""
    src = pick(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()

    def lists(begins, flat, kind_of):
        return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(flat, kind_of))

    def totals(kept, id_type):
        a, b, times = _counted(*(np.concatenate(c) for c in zip(*kept)))
        for k in range(0, len(a), 50_000):
            none = [pa.nulls(1, t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*none, *(lists([0, len(c[k:k + 50_000])], c[k:k + 50_000], t) for c, t in ((a, pa.int32()), (b, pa.int32()), (times, pa.int64())))], _NAMES)

    def run(batches):
        tool, kept, size, row, id_type = Aligner(path_a, path_b), [], 0, TaskContext.get().partitionId() << 36, None
        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                id_type, tokens = batch.schema.field(0).type, tool.tokens(batch.column(1).to_pylist())
                found = tool.align(tokens)
                columns = [pa.array(range(row, row + len(tokens)), pa.int64()), *(pa.array([len(pair[side]) for pair in tokens], pa.int64()) for side in (0, 1)),
                           pa.array(found.numbers, pa.int64()), pa.array(np.bincount(found.doc, minlength=len(tokens)), pa.int64()),
                           pa.array([hashlib.sha256(told).hexdigest() if told else "" for told in found.told], pa.string())]
                row += len(tokens)
                begins, *counted = _counted_each(found)
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *(lists(begins, c, t) for c, t in zip(counted, (pa.int32(), pa.int32(), pa.int64())))], _NAMES)
                kept.append(_counted(*counted))
                size += len(kept[-1][0])
                if size > 3 * held:
                    kept = [_counted(*(np.concatenate(c) for c in zip(*kept)))]
                    size = len(kept[0][0])
                    if size > held:
                        yield from totals(kept, id_type)
                        kept, size = [], 0
        if size:
            yield from totals(kept, id_type)
    return write_table(src.mapInArrow(run, f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {_LINKS}"), "aligned")


def pair_counts(table: DataFrame) -> DataFrame:
    """(a, b, count, best) of every linked id pair of the corpus; best: no pair of this b has a higher count.

    The window holds the pairs of one b id, at most one for each id of the other vocabulary.
    """
    links = table.where("row is null").select(F.explode(F.arrays_zip("a", "b", "times")).alias("p"))
    sums = links.groupBy("p.a", "p.b").agg(F.sum("p.times").alias("count"))
    return write_table(sums.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b"))), "pair-counts")


def scored(table: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every aligned row."""
    top = counts.orderBy(F.desc("count"), "a", "b").limit(frequent).toPandas()
    keys = top["a"].to_numpy(np.int64) << 32 | top["b"].to_numpy(np.int64)
    order = np.argsort(keys)
    keys, count, best = keys[order], top["count"].to_numpy(np.int64)[order], top["best"].to_numpy(bool)[order]
    rare = counts.count() > len(keys)
    sent = table.sparkSession.sparkContext.broadcast((keys, count, best))
    facts = _NAMES[:7]
    names = [*facts, "n_best", "count_sum", "a", "b", "times"]

    def run(batches):
        keys, count, best = sent.value
        for batch in batches:
            a, b, times = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "times"))
            ends = np.concatenate(([0], np.cumsum(np.asarray(a.value_lengths()))))
            a, b, times = (np.asarray(c.flatten()) for c in (a, b, times))
            key = a.astype(np.int64) << 32 | b
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            worth = np.where(known, times * count[at], 0) if len(keys) else times * 0
            hits = np.where(known & best[at], times, 0) if len(keys) else times * 0
            sums = [np.concatenate(([0], np.cumsum(v))) for v in (hits, worth)]
            left = np.concatenate(([0], np.cumsum(~known)))[ends]
            columns = [batch.column(i) for i in range(7)] + [pa.array(v[ends[1:]] - v[ends[:-1]], pa.int64()) for v in sums]
            yield pa.RecordBatch.from_arrays(columns + [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(v[~known], t)) for v, t in ((a, pa.int32()), (b, pa.int32()), (times, pa.int64()))], names)
    rows = table.where("row is not null")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:7])
    done = rows.mapInArrow(run, f"{kinds}, n_best long, count_sum long, {_LINKS}")
    final = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not rare:
        return done.select(*final)
    done = write_table(done, "scored")
    links = done.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("row", "p.*")
    met = links.join(counts, ["a", "b"]).groupBy(F.col("row").alias("of")).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more"))
    whole = done.drop("a", "b", "times").join(met, F.col("row") == F.col("of"), "left")
    both = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return whole.select(*final[:5], both("n_best", "more_best"), both("count_sum", "more"), "groups_sha256")


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """The alignment of each text, scored by the pair counts of all texts; one row for each row of docs.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and an
    empty digest. Repeated rows count as often as they occur, null ids stay. An empty table gives an empty table.
    """
    table = aligned(docs, path_a, path_b, id_col, text_col)
    return scored(table, pair_counts(table), frequent)
