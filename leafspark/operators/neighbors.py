"""Exact nearest neighbours in feature space.

The base table is cut into cells around a fixed number of pivot vectors. For a query, cell counts and radii give
a safe upper bound on the distance of its k-th neighbour, and cells that lie wholly beyond that bound are skipped.
Packs of cells of limited size go one after the other to all tasks, which compare their queries with what remains; only
the k best of each pack are written. In a pack, single precision picks the pairs that may count (for Euclidean distance by
matrix products), and their distances are measured in full. Equal vectors are merged first, with as many of their ids as can matter, so many copies cost one row.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.session import ROWS_OF_PART, cut_lineage, drop_tables

DISTANCE_PLACES = 9
BLOCK = 32768  # half the base vectors of a pack; about as many queries are a task
VALUES = 1 << 22  # numbers of such a pack's vectors
MERGED = 8  # tables of packs that are put together
TILE = 2048  # base vectors that half as many queries are compared with at once


def _matrix(values) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in values])


def _rows_of(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(vectors), -1)


def _distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """All distances, in slices of rows that keep the differences small."""
    out, rows = np.empty((len(a), len(b))), max(1, (1 << 21) // max(b.size, 1))
    for start in range(0, len(a), rows):
        out[start:start + rows] = _measured(a[start:start + rows, None, :] - b[None, :, :], p)
    return out


def _measured(gap: np.ndarray, p: int) -> np.ndarray:
    return np.abs(gap).sum(axis=-1) if p == 1 else np.sqrt((gap * gap).sum(axis=-1))


def _pair_distances(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray, p: int) -> np.ndarray:
    """Rounded distances of the pairs (a[r], b[c])."""
    out = np.empty(len(r))
    for start in range(0, len(r), 1 << 15):
        part = slice(start, start + (1 << 15))
        out[part] = np.round(_measured(a[r[part]] - b[c[part]], p), DISTANCE_PLACES)
    return out


def _maybe_within(a: np.ndarray, b: np.ndarray, limit: np.ndarray, p: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of which none with a rounded distance up to ``limit`` of its row, or among the ``need``
    least of its row, is missing. Single precision decides, with room for its error; b is near the origin."""
    size, scale = (np.abs(v).sum(axis=1) if p == 1 else (v * v).sum(axis=1) for v in (a, b))
    kind = np.float32 if max(size.max(), scale.max()) < 1e30 else np.float64
    x, y = a.astype(kind), b.astype(kind)
    if p == 1:
        d = np.zeros((len(x), len(y)), kind)
        for start in range(0, len(x), 32):
            # Few rows at a time, one coordinate after another, stay in the cache.
            near, gap = d[start:start + 32], np.empty_like(d[start:start + 32])
            for u, v in zip(x[start:start + 32].T, np.ascontiguousarray(y.T)):
                near += np.abs(np.subtract(u[:, None], v, out=gap), out=gap)
    else:
        # Without the query's own square, which is the same for a whole row.
        d = x @ (-2 * y).T
        d += scale.astype(kind)
    scale = scale.max()
    room = 2.0 ** -23 * (2 * a.shape[1] + 16) * (size + scale)
    reach = limit + 1e-9 + limit * 1e-12
    most = reach + room if p == 1 else reach * reach - size + room
    if len(y) > need and np.isinf(limit).any():
        kth = np.partition(d, need - 1, axis=1)[:, need - 1].astype(float)
        most = np.minimum(most, kth + 2 * room + 1e-8 * (1 + np.sqrt(size + scale)))
    return np.nonzero(d <= np.nextafter(most.astype(kind), kind(np.inf))[:, None])


def _first_of_rows(need: int, r: np.ndarray, dist: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first ``need`` entries by (dist, ids) of each r."""
    by = np.lexsort((ids, dist, r))
    by = by[np.arange(len(by)) - np.searchsorted(r[by], r[by]) < need]
    return tuple(v[by] for v in (r, dist, ids, *more))


def _merge_copies(base: DataFrame, keep: int) -> DataFrame:
    """features, ids (the lowest ``keep`` ids), one row per distinct vector."""
    order = Window.partitionBy("features").orderBy("id")
    few = base.select("id", "features").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep)
    return few.groupBy("features").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def nearest_neighbors(queries: DataFrame, base: DataFrame, k: int, p: int = 2, exclude_self: bool = False, pivots: int | None = None) -> DataFrame:
    """query_id, neighbors: array of (dist, id) by rising distance, ties by id; k entries (fewer in a small base).

    queries, base: id (bigint), features (array of double). p = 1 for Manhattan, 2 for Euclidean distance.
    """
    need = k + 1 if exclude_self else k
    merged = cut_lineage(_merge_copies(base, need))
    pivots = pivots or min(max(merged.count() // TILE, 4), 256)
    heads = [np.asarray(r[0], dtype=float) for r in merged.select("features").orderBy(F.xxhash64("features"), "features").limit(pivots).collect()]
    if not heads:
        return queries.select(F.col("id").alias("query_id")).withColumn("neighbors", F.array().cast("array<struct<dist:double,id:bigint>>"))
    centers = np.array(heads)

    def assign(batches):
        for frame in batches:
            if len(frame):
                d = _distances(_matrix(frame.features), centers, p)
                yield frame.assign(cell=d.argmin(axis=1), reach=d.min(axis=1))

    cells = cut_lineage(merged.mapInPandas(assign, "features array<double>, ids array<bigint>, cell int, reach double"))
    stats = {r["cell"]: (r["radius"], r["n"], r["ids"]) for r in cells.groupBy("cell").agg(
        F.max("reach").alias("radius"), F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}
    known = np.array(sorted(stats))
    radius, ids = np.array([stats[c][0] for c in known]), np.array([stats[c][2] for c in known])
    drop_tables(merged)
    # Packs of whole cells; a larger cell is dealt to several packs of its own.
    size = max(1, min(2 * BLOCK, VALUES // max(centers.shape[1], 1)))
    first, parts, packs, room = {}, {}, 0, 0
    for c in known.tolist():
        parts[c] = math.ceil(stats[c][1] / size)
        if parts[c] > 1 or stats[c][1] > room:
            first[c], packs = packs, packs + parts[c]
            room = size if parts[c] == 1 else 0
        else:
            first[c] = packs - 1
        room -= stats[c][1]

    def candidates(batches):
        for frame in batches:
            if not len(frame):
                continue
            d = _distances(_matrix(frame.features), centers[known], p)
            far = d + radius
            order = np.argsort(far, axis=1)
            filled = np.cumsum(ids[order], axis=1) >= need
            last = np.where(filled.any(axis=1), filled.argmax(axis=1), len(known) - 1)
            bound = np.take_along_axis(np.take_along_axis(far, order, axis=1), last[:, None], axis=1)[:, 0] + 1e-6
            hit = d - radius <= bound[:, None]
            met = np.zeros((len(frame), packs), dtype=bool)
            for c, row in zip(known.tolist(), hit.T):
                met[:, first[c]:first[c] + parts[c]] |= row[:, None]
            yield frame.assign(bound=bound, packs=[np.flatnonzero(row) for row in met])

    # A number stands for a query's vector in what leaves the comparisons. Rows are dealt by their vector, which serves the distinct too.
    rows, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, -(-rows // ROWS_OF_PART)), -(-rows // BLOCK))
    wanted = cut_lineage(queries.select("features").repartition(tasks, "features").distinct().withColumn("key", F.monotonically_increasing_id())
                         .mapInPandas(candidates, "features array<double>, key bigint, bound double, packs array<int>"))
    count = lambda table, key: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), F.col(key)), F.lit(1))
    part = lambda n, *salted: F.pmod(F.xxhash64(*salted), n).cast("int")
    members = cells.select("features", "ids", "cell", (count(first, "cell") + part(count(parts, "cell"), "features", F.lit(2))).alias("pack"))
    place = {int(c): i for i, c in enumerate(known)}

    def best_of_pack(asking: pa.RecordBatch, m: np.ndarray, flat_ids: np.ndarray, begin: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
        q, keys, bounds = _rows_of(asking.column("features")), asking.column("key").to_numpy(), asking.column("bound").to_numpy()
        many, lowest = np.diff(begin), flat_ids[begin[:-1]]
        inside = {int(c): np.flatnonzero(cell == c) for c in np.unique(cell)}
        at = np.array([place[c] for c in inside])
        to_center = _distances(q, centers[known[at]], p)
        found = []
        # Queries of one region go together, so that a cell is skipped for all of them.
        turns = np.argsort(to_center.argmin(axis=1), kind="stable")
        for start in range(0, len(q), TILE // 2):
            mine = turns[start:start + TILE // 2]
            a, gaps = q[mine], to_center[mine]
            kth = np.full(len(mine), np.inf)
            best = (np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0, int))
            for i in np.argsort(gaps.mean(axis=0), kind="stable"):
                rows, origin = inside[known[at[i]]], centers[known[at[i]]]
                for low in range(0, len(rows), TILE):
                    some = np.flatnonzero(gaps[:, i] - radius[at[i]] <= np.minimum(bounds[mine], kth + 1e-6))
                    if not len(some):
                        break
                    tile = rows[low:low + TILE]
                    r, c = _maybe_within(a[some] - origin, m[tile] - origin, kth[some], p, need)
                    r, c = some[r], tile[c]
                    dist = _pair_distances(a, m, r, c, p)
                    close = dist <= kth[r]
                    new = (r[close], dist[close], lowest[c[close]], c[close])
                    # A vector is out once ``need`` others come before its lowest id.
                    best = _first_of_rows(need, *[np.concatenate(v) for v in zip(best, new)])
                    full = np.searchsorted(best[0], np.arange(len(mine)), side="right") - 1
                    enough = np.bincount(best[0], minlength=len(mine)) == need
                    kth[enough] = best[1][full[enough]]
            r, dist, _, c = best
            copies = many[c]
            flat = flat_ids[np.repeat(begin[c] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())]
            found.append([v if i else keys[mine[v]] for i, v in enumerate(_first_of_rows(need, np.repeat(r, copies), np.repeat(dist, copies), flat))])
        key, dist, ids = (np.concatenate(v) for v in zip(*found))
        ends = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] - 1)), len(key))
        near = pa.StructArray.from_arrays([pa.array(dist, pa.float64()), pa.array(ids, pa.int64())], ["dist", "id"])
        return pa.RecordBatch.from_arrays([pa.array(key[ends[:-1]], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)], ["key", "near"])

    def compared(pack: int) -> list[DataFrame]:
        """The best of one pack, which every task gets as a broadcast, for the queries that it may count for."""
        table = members.filter(F.col("pack") == pack).select("features", "ids", "cell").toArrow().combine_chunks()
        if not len(table):
            return []
        held = table.column("ids").combine_chunks()
        begin = np.append(0, np.cumsum(held.value_lengths().to_numpy()))
        sent = queries.sparkSession.sparkContext.broadcast((_rows_of(table.column("features").combine_chunks()), held.flatten().to_numpy(), begin, table.column("cell").to_numpy()))

        def run(batches):
            for batch in batches:
                if len(batch):
                    yield best_of_pack(batch, *sent.value)
        asked = wanted.filter(F.array_contains("packs", pack)).select("key", "features", "bound")
        out = cut_lineage(asked.mapInArrow(run, "key bigint, near array<struct<dist:double,id:bigint>>"))
        sent.destroy()
        return [out]

    def merged_lists(tables: list[DataFrame]) -> DataFrame:
        nearest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, need)
        lists = cut_lineage(reduce(DataFrame.unionByName, tables).groupBy("key").agg(nearest.alias("near")))
        drop_tables(*tables)
        return lists
    # One pack after the other, so that neither packs nor queries are copied to disk for each of them.
    lists: list[DataFrame] = []
    for pack in range(packs):
        lists += compared(pack)
        if len(lists) == MERGED:
            lists = [merged_lists(lists)]
    drop_tables(cells)
    best = merged_lists(lists)
    joined = queries.select(F.col("id").alias("query_id"), "features").join(wanted.select("features", "key").join(best, "key"), "features")
    found = F.col("near")
    if exclude_self:
        found = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)
    near = cut_lineage(joined.select("query_id", found.alias("neighbors")))
    drop_tables(wanted, best)
    return near


def neighbor_rows(neighbors: DataFrame) -> DataFrame:
    """query_id, place (from 0), dist, id."""
    return neighbors.select("query_id", F.posexplode("neighbors").alias("place", "n")).select("query_id", "place", "n.dist", "n.id")


def classify(test: DataFrame, train: DataFrame, k: int = 5, p: int = 1) -> DataFrame:
    """Distance-weighted vote of the k nearest training rows: id, probability, prediction. Exact hits outvote the rest."""
    near = neighbor_rows(nearest_neighbors(test, train, k, p)).join(train.select("id", "type"), "id")
    zero = F.col("dist") == 0
    votes = near.groupBy("query_id").agg(
        F.count_if(zero).alias("_z"), F.count_if(zero & (F.col("type") == 1)).alias("_z1"),
        F.sum(F.when(~zero, 1 / F.col("dist"))).alias("_w"), F.sum(F.when(~zero & (F.col("type") == 1), 1 / F.col("dist")).otherwise(0.0)).alias("_w1"))
    probability = F.when(F.col("_z") > 0, F.col("_z1") / F.col("_z")).otherwise(F.col("_w1") / F.col("_w"))
    return votes.select(F.col("query_id").alias("id"), probability.alias("probability")) \
        .withColumn("prediction", (F.round("probability", 9) > 0.5).cast("int"))
