"""Mixing sources to target weights.

The words of a source stand in one long line (documents in the order of a hash) that is cut into blocks of a fixed
number of words. A mix is a number of slots, spread over output shards: how many slots of each shard a source gets is
drawn as a multinomial, given the source's slots in all, so that every source meets its target and a shard can be drawn
by itself. The slots of a source are numbered through all shards, number k goes through a pseudorandom permutation of
the source's block numbers (another one for each round through the source), and blocks are joined by that number.

Everything follows from hashes, so reruns agree whatever the partitions. Sources are named in a mix, so their number is
bounded (a parameter); documents, blocks and slots are not.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from leafspark.llm.shared import pick, write_table

#: Words in a block, slots in an output shard.
BLOCK, SHARD = 128, 4096
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text, parted by the white space bytes 9 to 13 and 32; null has none."""
    flat = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(flat):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    ends, first = ends - ends[0], ends[0]
    if not ends[-1]:
        return np.zeros(len(flat), np.int64)
    space = _SPACE[np.frombuffer(flat.buffers()[2], np.uint8)[first:first + ends[-1]]]
    begins = ~space
    begins[1:] &= space[:-1]
    filled = np.diff(ends) > 0
    heads = ends[:-1][filled]
    begins[heads] = ~space[heads]
    counts = np.zeros(len(flat), np.int64)
    counts[filled] = np.add.reduceat(begins.view(np.uint8), heads, dtype=np.int64)
    return counts


def targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted of each source: share times all words by weight (repeating), none above most times its own size.

    What sources at their limit leave is shared out by weight among the others until nobody is above.
    """
    out, left = [0.0] * len(sizes), share * sum(sizes)
    free = list(range(len(sizes)))
    while free:
        total = sum(weights[i % len(weights)] for i in free)
        full = [i for i in free if left * weights[i % len(weights)] / total >= most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i % len(weights)] / total
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0 to size - 1 for each key: four Feistel rounds, walked on until the value is in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(np.float64) + 1) / 2)).astype(np.uint64))
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.arange(len(index))
    limit = size.astype(np.uint64)
    while len(todo):
        v, h, m, k = value[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = v >> h, v & m
        for step in range(4):
            mix = (right + k + np.uint64(0x9E3779B97F4A7C15 * (step + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            mix = (mix ^ mix >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (mix ^ mix >> np.uint64(32)) & m
        value[todo] = left << h | right
        todo = todo[value[todo] >= limit[todo]]
    return value.astype(np.int64)


def _split(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n slots, out of all slots with these counts by source, go to each source."""
    total = int(counts.sum())
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts, n, method="marginals") if total else counts
    mean = counts * (n / total)  # beyond what numpy draws exactly: the normal limit, and the sum put right
    drawn = np.clip(np.rint(rng.normal(mean, np.sqrt(mean * (1 - n / total) * (1 - counts / total)))), 0, counts).astype(np.int64)
    for i in np.argsort(-counts):
        drawn[i] += min(max(n - int(drawn.sum()), -int(drawn[i])), int(counts[i] - drawn[i]))
    return drawn


class Shares:
    """Slots of each source in each shard: multinomial draws given the totals, by halving the range of shards."""

    def __init__(self, totals: list[int], shard: int, seed: int):
        self.totals, self.shard, self.seed = np.array(totals, np.int64), shard, seed
        self.shards = -(-int(self.totals.sum()) // shard)
        self._node = functools.lru_cache(maxsize=256)(self._draw)

    def _draw(self, low: int, high: int, path: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(first slot, slots) by source of the shards from low up to high; path leads there from the whole range."""
        if not path:
            return np.zeros_like(self.totals), self.totals
        start, counts = self._node(*path[-1], path[:-1])
        a, b = path[-1]
        middle = (a + b) // 2
        left = _split(counts, (middle - a) * self.shard, np.random.default_rng([self.seed, a, b]))
        return (start, left) if low == a else (start + left, counts - left)

    def of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        low, high, path = 0, self.shards, ()
        while high - low > 1:
            path, middle = (*path, (low, high)), (low + high) // 2
            low, high = (low, middle) if shard < middle else (middle, high)
        return self._node(low, high, path)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = False) -> DataFrame:
    """(doc_id, source, spot, size) and the text if wanted: the words of each row and its hash, as a written table."""
    def run(batches):
        for batch in (whole.slice(k, 1_000) for whole in batches for k in range(0, whole.num_rows, 1_000)):
            kept = batch.columns if keep_text else batch.columns[:3]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(word_counts(batch.column(3)), pa.int64())], [*batch.schema.names[:len(kept)], "size"])
    src = pick(docs, doc_id=id_col, source=source_col, text=text_col).select("doc_id", "source", F.xxhash64("doc_id", "text").alias("spot"), "text")
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in src.schema][:4 if keep_text else 3]
    return write_table(src.mapInArrow(run, ", ".join([*columns, "size long"])), "mix-sizes")


def plan_mix(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK, max_sources: int = 100_000) -> list[dict]:
    """One entry a source, by code point with null last: its words, blocks, target and slots. Over max_sources is an error."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["size"] for r in rows], weights, share, most)
    out = []
    for r, target in zip(rows, wanted):
        blocks = -(-r["size"] // block)
        slots = min(int(most * blocks), round(target * blocks / r["size"])) if r["size"] else 0
        out.append({"source": r["source"], "docs": r["docs"], "source_size": r["size"], "target": target, "blocks": blocks, "slots": slots})
    return out


def draw_slots(spark: SparkSession, plan: list[dict], shard: int = SHARD, seed: int = 42) -> DataFrame:
    """(shard, place, s, block, round): one row a slot; s is the source's number in the plan, place the order in the shard."""
    totals = [p["slots"] for p in plan]
    shards = Shares(totals, shard, seed).shards
    blocks = np.array([p["blocks"] for p in plan], np.int64)
    keys = np.array([xxhash.xxh64_intdigest("" if p["source"] is None else "." + p["source"], seed) for p in plan], np.uint64)
    names = ["shard", "place", "s", "block", "round"]

    def run(batches):
        shares = Shares(totals, shard, seed)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                start, counts = shares.of(number)
                n = int(counts.sum())
                s = np.repeat(np.arange(len(counts)), counts)
                k = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts) + start[s]
                turn = k // blocks[s]
                block = permuted(k % blocks[s], blocks[s], keys[s] + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                place = np.random.default_rng([seed, number, 1]).permutation(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(place), pa.array(s), pa.array(block), pa.array(turn)], names)
    if not shards:
        return spark.createDataFrame([], "shard long, place long, s long, block long, round long")
    tasks = min(shards, max(8, spark.sparkContext.defaultParallelism, shards // 64))
    return spark.range(0, shards, 1, tasks).mapInArrow(run, "shard long, place long, s long, block long, round long")


def _placed(sizes: DataFrame, plan: list[dict]) -> DataFrame:
    """The rows of sizes with s and start, the first word of each in its source's line.

    Chunks of a source are numbered by themselves and chunk totals are summed up, so no window holds a whole source.
    Rows that agree in id and hash are one row of the window and stand apart again afterwards.
    """
    spark = sizes.sparkSession
    named = spark.createDataFrame([(p["source"], i) for i, p in enumerate(plan)], f"of {sizes.schema['source'].dataType.simpleString()}, s long")
    chunks = math.isqrt(max([1, *(p["docs"] for p in plan)]))  # as many as documents in each, for the largest source
    rows = sizes.join(F.broadcast(named), sizes["source"].eqNullSafe(named["of"])).drop("of", "source").withColumn("chunk", F.pmod("spot", F.lit(chunks)))
    texts = [F.first("text").alias("text")] if "text" in sizes.columns else []
    rows = rows.groupBy("s", "chunk", "spot", "doc_id", "size").agg(F.count("*").alias("copies"), *texts)
    words = F.col("size") * F.col("copies")
    before = rows.groupBy(F.col("s").alias("s2"), F.col("chunk").alias("chunk2")).agg(F.sum(words).alias("words"))
    before = before.select("s2", "chunk2", (F.sum("words").over(Window.partitionBy("s2").orderBy("chunk2")) - F.col("words")).alias("before"))
    inside = Window.partitionBy("s", "chunk").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum(words).over(inside) - words).join(before, (F.col("s") == F.col("s2")) & (F.col("chunk") == F.col("chunk2")))
    many = rows.withColumn("base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(10_000).cast("long"))))
    each = many.withColumn("copy", F.explode(F.sequence("base", F.least(F.col("base") + 9_999, F.col("copies") - 1))))
    return each.withColumn("start", F.col("before") + F.col("inside") + F.col("copy") * F.col("size")).select("s", "doc_id", "size", "start", *["text"] * len(texts))


def _segments(placed: DataFrame, block: int) -> DataFrame:
    """(s, doc_id, size, start, block, words): what each row has in each block that it touches; without words, a null block."""
    touched = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    cut = placed.select("*", F.explode_outer(touched).alias("block"))
    begin, end = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("*", (end - begin).alias("words"))


def mix_report(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: int = 42,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs: the words that a mix takes of it, repeats counted.

    A null text has no words; a null source is a source, the last one. Repeated rows count as often as they occur, a null
    doc_id is a value like others. A source without words has target 0. An empty table gives an empty table; other
    columns of docs, clashing names included, are ignored.
    """
    sizes = measured(docs, id_col, text_col, source_col)
    plan = plan_mix(sizes, weights, share, most, block)
    spark = docs.sparkSession
    times = draw_slots(spark, plan, shard, seed).groupBy(F.col("s").alias("s1"), F.col("block").alias("block1")).agg(F.count("*").alias("times"))
    times = times.hint("merge")  # Spark takes the slots for as few as the shards they are made from
    parts = _segments(_placed(sizes, plan), block)
    used = parts.join(times, (parts["s"] == F.col("s1")) & (parts["block"] == F.col("block1")), "left")
    whole = used.where("block is not null").groupBy("s", "start").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = parts.where("block is null").select("s", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    told = spark.createDataFrame([(i, p["source_size"], float(p["target"])) for i, p in enumerate(plan)], "s long, source_size long, target double")
    return whole.unionByName(none).join(F.broadcast(told), "s").select("doc_id", "size", "source_size", "target", "taken")


def packed(sizes: DataFrame, plan: list[dict], block: int = BLOCK) -> DataFrame:
    """(s, block, words) of measured rows with their texts: the blocks, words parted by one space; a source's last may be short."""
    def run(batches):
        for batch in batches:
            for s, start, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, at = (text or "").encode().split(), 0
                out: list[tuple] = []
                while at < len(words):
                    number = (start + at) // block
                    n = (number + 1) * block - start - at
                    out.append((s, number, start + at, b" ".join(words[at:at + n]).decode()))
                    at += n
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["s", "block", "at", "part"])
    pieces = _placed(sizes, plan).select("s", "start", "text").mapInArrow(run, "s long, block long, at long, part string")
    parts = F.array_sort(F.collect_list(F.struct("at", "part")))  # block parts at most
    return pieces.groupBy("s", "block").agg(F.array_join(F.transform(parts, lambda p: p["part"]), " ").alias("words"))


def mixed_blocks(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: int = 42,
                 id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(shard, place, source, block, round, words): the mix itself, one row a slot; edge cases as in mix_report."""
    sizes = measured(docs, id_col, text_col, source_col, keep_text=True)
    plan = plan_mix(sizes, weights, share, most, block)
    named = docs.sparkSession.createDataFrame([(i, p["source"]) for i, p in enumerate(plan)], f"s long, source {sizes.schema['source'].dataType.simpleString()}")
    slots = draw_slots(docs.sparkSession, plan, shard, seed)
    return slots.hint("merge").join(packed(sizes, plan, block), ["s", "block"]).join(F.broadcast(named), "s").select("shard", "place", "source", "block", "round", "words")
