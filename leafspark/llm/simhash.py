"""Near duplicates by SimHash, linked through tables of distances to reference fingerprints.

The references are zero and one mask for every two bits, so that a block's two distances tell how many of its bits a
fingerprint has. Fingerprints that differ in at most RADIUS bits have the same distances in all but RADIUS blocks, hence
in all blocks of at least two of the four quarters: the table deals each fingerprint once for each two quarters, by its
distances there, and every pair that may link meets in one cell. Within a cell pairs whose distances to any reference
differ by more than RADIUS are discarded, and the bits of the others compared; what leaves a cell is a spanning forest,
never its pairs. Cells over CELL fingerprints take an exact way without pairs: two fingerprints differ in at most two
bits if and only if some word differs from each in at most one, so members meet at those words.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafspark.llm.shared import components, pick, write_table

RADIUS = 2
#: Cells up to so many fingerprints are compared in memory (its square of bytes); larger ones go the way of shared words.
CELL = 1024
BLOCKS = 32
#: Zero, the two-bit masks, and wide masks that see several blocks at once: the reference fingerprints.
REFERENCES = np.array([0] + [3 << (2 * i) for i in range(BLOCKS)] + [0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF, 0x00000000FFFFFFFF], dtype=np.uint64)
TABLES = list(combinations(range(4), 2))


def fingerprint_of(text: bytes, width: int = 3) -> bytes:
    """Eight bytes, the highest bit first. Words are what lies between white space, A to Z lower-cased."""
    from xxhash import xxh64_digest
    words = text.lower().split()  # of bytes: ASCII letters and the six ASCII spaces only
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[:n - 1])).tolist()
    stops = (ends[min(width, len(words)) - 1:] - 1).tolist()
    hashes = np.frombuffer(b"".join([xxh64_digest(joined[a:b], 42) for a, b in zip(starts, stops)]), np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at:at + 65536], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each row's text; without words (or null) it is zero."""
    src = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            data = b"".join(fingerprint_of(t.as_py(), width) for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(data, ">i8").astype(np.int64))], ["doc_id", "fp"])
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def distances(fps: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distances (rows: fingerprints, columns: references)."""
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): each fingerprint once for each two quarters, by its distances to the references of their blocks."""
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            table = distances(fp)
            bits = ((2 + table[:, :1] - table[:, 1:1 + BLOCKS]) // 2).astype(np.int64)  # bits of the block that are set
            quarter = [(bits[:, 8 * q:8 * q + 8] * 3 ** np.arange(8)).sum(1) for q in range(4)]
            keys = [(t * 3 ** 16) + quarter[a] * 3 ** 8 + quarter[b] for t, (a, b) in enumerate(TABLES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(fp, len(keys)))], ["cell", "fp"])
    return fps.mapInArrow(run, "cell long, fp long")


def forest(cell: np.ndarray, fp: np.ndarray, radius: int = RADIUS, accept=None, likely=None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as places, of the links within each cell; cell is sorted. accept(i, j) judges what survives the
    bits and likely(many i, many j)."""
    same = np.flatnonzero(cell[1:] == cell[:-1])
    use = np.unique(np.concatenate((same, same + 1)))
    cell, fp = cell[use], fp[use]
    table, word, root = distances(fp), fp.view(np.uint64), np.arange(len(fp))
    left, right = [], []
    place = np.arange(len(fp))
    step = 1
    while True:
        place = place[place + step < len(fp)]
        place = place[cell[place] == cell[place + step]]
        if not len(place):
            break
        near = place[root[place] != root[place + step]]
        near = near[np.abs(table[near] - table[near + step]).max(1) <= radius] if len(near) else near
        near = near[np.bitwise_count(word[near] ^ word[near + step]) <= radius]
        if likely is not None and len(near):
            near = near[likely(use[near], use[near + step])]
        for i in near.tolist():
            a, b = i, i + step
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b and (accept is None or accept(use[i], use[i + step])):
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + step)
        while len(near) and (root[root] != root).any():
            root = root[root]
        step += 1
    return use[np.array(left, np.int64)], use[np.array(right, np.int64)]


def _within_cells(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        cell, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held:
            cell, fp = np.concatenate((held[0][0], cell)), np.concatenate((held[0][1], fp))
        last = np.searchsorted(cell, cell[-1]) if len(cell) else 0
        held = [(cell[last:], fp[last:])]  # the last cell may go on in the next batch
        a, b = forest(cell[:last], fp[:last])
        yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])
    for cell, fp in held:
        a, b = forest(cell, fp)
        yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])


def links(fps: DataFrame, cell_size: int = CELL) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that have the components of all links within RADIUS."""
    dealt = write_table(cells(fps), "simhash-cells")
    large = dealt.groupBy("cell").count().where(F.col("count") > cell_size).select("cell")
    small = dealt.join(large, "cell", "left_anti")
    near = small.repartition("cell").sortWithinPartitions("cell").mapInArrow(_within_cells, "a long, b long")
    crowd = dealt.join(large, "cell", "left_semi").select("fp").distinct()
    one_off = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)])
    words = crowd.select("fp", F.explode(one_off).alias("word"))
    first = words.groupBy("word").agg(F.min("fp").alias("m"))
    met = words.join(first, "word").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()
    return near.union(met)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Fingerprints link at RADIUS or fewer differing bits; component_id is the smallest doc_id that links reach. Copies
    share a fingerprint and are merged before anything is compared. Null and empty texts have fingerprint zero, linked
    like any other. A null doc_id is never a component_id unless its component has no other.
    """
    rows = write_table(fingerprints(docs, id_col, text_col, width), "simhash-rows")
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(own.select("fp")), "simhash-links")
    own = own.join(roots, own.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = own.groupBy("root").agg(F.min("low").alias("component_id"))
    named = own.join(lowest, "root").select(F.col("fp").alias("word"), "component_id")
    return rows.join(named, rows.fp == named.word).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Similar documents: shingle width, least similarity, and the fingerprint bits within which such pairs lie (of 64;
#: about 10 differ at similarity 0.8, with a deviation of 3).
WIDTH, SIMILARITY, WIDE_RADIUS = 5, 0.8, 24
#: Cells for pairs that lie farther apart than RADIUS: BANDS keys of ROWS least shingle hashes each. A pair at the least
#: similarity shares some key with a chance of 1 - (1 - 0.8 ** 3) ** 10 = 0.999.
BANDS, ROWS = 10, 3
#: Cells over so many documents are divided in parts: up to SPLITS of them, more only where a part would hold over
#: SPLITS * PART documents or PART_BYTES of sketches. Every two parts of a cell meet in a block.
PART, SPLITS, PART_BYTES = 512, 8, 16 << 20
#: Bits of the parity marks that bound how many shingles two texts do not share.
MARK = 1024
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(1, 1 << 63, (ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def profile_of(text: bytes) -> tuple[int, bytes, list[int], bytes]:
    """(key, fingerprint, cell keys, sketch) of a text's distinct five-word shingles; the sketch has them all, by 32 bits."""
    from xxhash import xxh64_digest, xxh64_intdigest
    words = text.lower().split()
    joined = b" ".join(words)
    key = xxh64_intdigest(joined, 7) - (1 << 63)
    if not words:
        return key, bytes(8), [], b""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - WIDTH + 1)
    starts, stops = np.concatenate(([0], ends[:n - 1])).tolist(), (ends[min(WIDTH, len(words)) - 1:] - 1).tolist()
    hashes = np.unique(np.frombuffer(b"".join([xxh64_digest(joined[a:b], 42) for a, b in zip(starts, stops)]), ">u8").astype(np.uint64))
    least, counts = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64), np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        np.minimum(least, (part[:, None] * _FACTORS).min(0), out=least)
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    keys = (least.reshape(BANDS, ROWS).T * _MIX).sum(0, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    sketch = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
    return key, np.packbits(2 * counts > len(hashes)).tobytes(), keys.view(np.int64).tolist(), sketch.tobytes()


def similarity_of(a: bytes, b: bytes) -> float:
    """The shared part of the shingle hashes of both texts together."""
    both = np.concatenate((np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def marks_of(sketches: list[bytes]) -> np.ndarray:
    """A row of MARK bits a sketch: which places an odd number of its hashes has. Two rows differ in no more bits than
    there are hashes in only one of the sketches."""
    rows = [np.packbits(np.bincount(np.frombuffer(s, np.uint32) % MARK, minlength=MARK).astype(np.uint8) & 1) for s in sketches]
    return np.array(rows, np.uint8).reshape(len(rows), MARK // 8).view(np.uint64)


def _similar_in_blocks(similarity: float):
    """Sorted by (cell, block): the links of a spanning forest of each block."""
    def judged(values):
        spots, key, fp, sketch = values
        if not len(key):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        spot = np.cumsum(np.concatenate(([0], (spots[1:] != spots[:-1]).any(1).astype(np.int64))))
        marks, sizes = marks_of(sketch), np.array([len(s) for s in sketch]) // 4

        def likely(i, j):
            both = sizes[i] + sizes[j]
            apart = np.maximum(np.bitwise_count(marks[i] ^ marks[j]).sum(1, dtype=np.int64), np.abs(sizes[i] - sizes[j]))
            return (both - apart) >= (similarity - 1e-9) * (both + apart)
        a, b = forest(spot, fp, WIDE_RADIUS, lambda i, j: similarity_of(sketch[i], sketch[j]) >= similarity - 1e-9, likely)
        return pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b])], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            cell, block, key, fp = (batch.column(i).to_numpy() for i in range(4))
            now = [np.stack((cell, block), 1), key, fp, np.array(batch.column(4).to_pylist() + [None], object)[:-1]]
            now = now if held is None else [np.concatenate(pair) for pair in zip(held, now)]
            if not len(now[0]):
                continue
            spots = now[0]
            last = int(np.flatnonzero((spots != spots[-1]).any(1))[-1]) + 1 if (spots != spots[-1]).any() else 0
            yield judged([v[:last] for v in now])
            held = [v[last:] for v in now]  # the last block may go on in the next batch
        if held is not None:
            yield judged(held)
    return run


def blocks(members: DataFrame) -> DataFrame:
    """(key, cell, block) of members (key, cell, size in bytes): a block for every two parts of a cell, so that every two
    members of a cell meet in some block. Cells of one member are left out."""
    sizes = members.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    least = F.greatest(F.least(F.ceil(F.col("n") / PART), F.lit(SPLITS)), F.ceil(F.col("n") / (SPLITS * PART)), F.ceil(F.col("bytes") / PART_BYTES))
    parts = sizes.select("cell", F.least("n", least).cast("long").alias("parts"))
    dealt = members.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("cell", "key"), F.col("parts")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: (o != F.col("part")) | (F.col("parts") == 1))
    return dealt.withColumn("other", F.explode(others)).select("key", "cell", (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).alias("block"))


def similar_links(members: DataFrame, profiles: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that have the components of all pairs of similar texts that share a cell. members: (key, cell, size),
    profiles: (own, fp, sketch) of each key."""
    dealt = blocks(members)
    full = dealt.join(profiles, dealt.key == profiles.own).select("cell", "block", "key", "fp", "sketch")
    return full.repartition("cell", "block").sortWithinPartitions("cell", "block", "fp").mapInArrow(_similar_in_blocks(similarity), "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row: groups of texts whose five-word shingles are similar.

    Words as for near_duplicates; a text of fewer than five words is one shingle. Pairs that share a cell key are
    compared by their distances to the references, then by their bits, then by their shingles. A cell of very many
    documents is divided in parts, and every part is compared with every other one; only links of spanning forests leave
    the tasks. Equal texts are merged first; texts without words are one group; null counts as empty. A null doc_id is a
    component_id only if its group has no other.
    """
    src = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            rows = [profile_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(np.frombuffer(b"".join(r[1] for r in rows), ">i8").astype(np.int64)),
                pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.binary())], ["doc_id", "key", "fp", "cells", "sketch"])
    rows = write_table(src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, key long, fp long, cells array<long>, sketch binary"), "similar-rows")
    members = rows.select("key", F.length("sketch").alias("size"), F.explode("cells").alias("cell")).distinct()
    profiles = rows.select(F.col("key").alias("own"), "fp", "sketch").dropDuplicates(["own"])
    roots = components(similar_links(members, profiles, similarity), "similar-components")
    own = rows.groupBy("key").agg(F.min("doc_id").alias("low"))
    own = own.join(roots, own.key == roots.node, "left").select("key", "low", F.coalesce("root", "key").alias("root"))
    named = own.join(own.groupBy("root").agg(F.min("low").alias("component_id")), "root").select(F.col("key").alias("own"), "component_id")
    return rows.join(named, rows.key == named.own).select("doc_id", "component_id")
