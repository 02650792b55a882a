"""Steps whose memory or work once grew faster than their input."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafspark import session
from leafspark.operators import blob_texture, images, many_models, neighbors, plane, resample, selection, shape, sweep, tiles
from leafspark.plans import flow
from leafspark.sources import files
from leafspark.streaming import images as image_streams


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_distances_take_little_memory():
    a, b = np.random.default_rng(1).normal(size=(6000, 64)), np.random.default_rng(2).normal(size=(128, 64))
    tracemalloc.start()
    for p in (1, 2):
        d = neighbors._distances(a, b, p)
        assert np.allclose(d[5999], [np.linalg.norm(a[5999] - v, p) for v in b])
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("shift,size", [(0.0, 1.0), (1e7, 1.0), (0.0, 1e-6), (0.0, 1e20)])
def test_single_precision_loses_no_neighbour(p, shift, size):
    rng = np.random.default_rng(3)
    a, b = (shift + size * rng.normal(size=(n, 16)) for n in (50, 700))
    exact = np.round(neighbors._measured(a[:, None] - b[None], p), neighbors.DISTANCE_PLACES)
    for limit in (np.full(50, np.inf), np.sort(exact, axis=1)[:, 3]):
        found = set(zip(*(v.tolist() for v in neighbors._maybe_within(a - b[0], b - b[0], limit, p, 4))))
        least = np.minimum(limit, np.sort(exact, axis=1)[:, 3])
        assert {(int(i), int(j)) for i, j in zip(*np.nonzero(exact <= least[:, None]))} <= found
        if size == 1.0:
            assert len(found) < 50 * 700 / 10


@pytest.mark.parametrize("p", [1, 2])
def test_neighbors_at_equal_distances(spark, p):
    """Vectors that are all equally far from each other: the lowest ids count, in several packs."""
    n = 60
    df = spark.createDataFrame([(i, [float(i == j) for j in range(n)]) for i in range(n)], "id bigint, features array<double>")
    kept, neighbors.BLOCK = neighbors.BLOCK, 8
    try:
        rows = neighbors.nearest_neighbors(df, df, 3, p, exclude_self=True).collect()
    finally:
        neighbors.BLOCK = kept
    assert {r["query_id"]: [n["id"] for n in r["neighbors"]] for r in rows} == {i: [j for j in range(5) if j != i][:3] for i in range(n)}


def test_neighbors_are_found_once(spark):
    """What reads the neighbours reads a table, however often; a vector's query goes to a pack in one row."""
    df = spark.createDataFrame([(i, [float(i), float(i % 7)], i % 2) for i in range(50)], "id bigint, features array<double>, type int")
    near = neighbors.nearest_neighbors(df, df, 2, exclude_self=True)
    assert "CoGroup" not in plan_of(near) and near.count() == 50


@pytest.mark.parametrize("name", ["smote_tomek", "smote_enn"])
def test_made_rows_are_made_once(spark, monkeypatch, name):
    seen = []
    for step in ("remove_tomek", "edited_neighbors"):
        monkeypatch.setattr(resample, step, lambda df, **_: seen.append(df))
    df = spark.createDataFrame([(i, [float(i), float(i % 7)], int(i % 4 == 0)) for i in range(60)], "id bigint, features array<double>, type int")
    getattr(resample, name)(df)
    assert "Join" not in plan_of(seen[0]) and seen[0].groupBy("type").count().select("count").distinct().count() == 1


def test_nearest_blob_broadcasts_nothing(spark, monkeypatch):
    plans, cut = [], plane.cut_lineage
    monkeypatch.setattr(plane, "cut_lineage", lambda df: plans.append(plan_of(df)) or cut(df))
    lids = spark.createDataFrame([(1, i, 40 * i, 900) for i in range(30)], "image_id int, lid_id int, lx int, ly int")
    blobs = spark.createDataFrame([(1, i, 30 * i, 10 * i) for i in range(40)], "image_id int, blob_id int, cx int, cy int")
    near = plane.nearest_blob(lids, blobs)
    assert near.count() == 30 and len(plans) > 4
    assert not any("Broadcast" in p for p in [*plans, plan_of(near)])


def test_row_votes_of_few_centers_leave_as_best_lines(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(x), int(y)) for i, x, y in zip(rng.integers(0, 6, 300), rng.integers(-90, 90, 300), rng.integers(0, 50, 300))]
    rows += [(7, 3, None), (7, None, None), (7, 3, 4), (None, 3, 4), (None, 5, 6)]
    df = spark.createDataFrame(rows, "image_id bigint, cx int, cy int")
    every = plane.row_votes(df)
    want = sorted(map(str, plane.best_lines(every, 3).collect()))
    for few in (0, 50, 4096):
        monkeypatch.setattr(plane, "FEW_CENTERS", few)
        votes = plane.row_votes(df, best=3)
        assert votes.dtypes == every.dtypes and sorted(map(str, plane.best_lines(votes, 3).collect())) == want
    assert votes.filter("image_id < 7").count() == 18


def test_feed_computes_its_rows_once(spark):
    from leafspark.plans import catalog_streams

    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for frame in batches:
            runs.add(len(frame))
            yield frame
    df = spark.range(200, numPartitions=4).selectExpr("id", "timestamp_seconds(id) ts").mapInPandas(counted, "id bigint, ts timestamp")
    folder = catalog_streams.feed(df, "ts")
    assert runs.value == 200 and spark.read.parquet(folder).count() == 200 and len(spark.read.parquet(folder).inputFiles()) == 4


def test_recursive_selection_fits_one_dealt_table(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(selection, "_forest", lambda df, trees, at: seen.append(df) or [float(i) for i in range(len(at))])
    for rows, parts in ((5000, 5), (900, 1)):
        seen.clear()
        df = spark.range(rows, numPartitions=1).selectExpr("id", "array(id * 1D, id % 7 * 1D, id % 3 * 1D) features", "int(id % 2) type")
        ranks = {r["factor"]: r["score"] for r in selection.recursive(df, ["a", "b", "c"]).collect()}
        assert ranks == {"a": 3, "b": 2, "c": 1} and [d.rdd.getNumPartitions() for d in seen] == [parts] * 2
        assert all("Range" not in plan_of(d) and d.count() == rows for d in seen)


def test_small_images_are_counted_in_one_place(spark, monkeypatch):
    """The direct counts and the ones in bands and halves agree, whatever goes which way."""
    rng = np.random.default_rng(6)
    cut = [(int(i), n, *(int(v) for v in rng.integers(0, 40, 2)), *(int(v) for v in rng.integers(0, 15, 2))) for n, i in enumerate(rng.integers(0, 5, 200))]
    rows = [(*b, b[2] + b[4] // 2, b[3] + b[5] // 2) for b in cut]
    rows += [(9, 900, 1, 2, 3, 4, 2, None), (9, 901, 1, 2, 3, 4, 2, 3), (9, 902, None, 2, 3, 4, 2, 3)] + rows[:9]
    df = spark.createDataFrame(rows, "image_id bigint, blob_id bigint, x int, y int, w int, h int, cx int, cy int")
    cover, level = [], []
    for few in (0, 40, 4096):
        monkeypatch.setattr(plane, "FEW_CENTERS", few)
        for kept, found in ((cover, plane.box_cover(df)), (level, plane.level_counts(df))):
            kept.append((found.dtypes, sorted(map(str, found.collect()))))
            assert ("FlatMapGroupsInPandas" in plan_of(found)) and len(kept[0][1]) > 100
    assert cover[0] == cover[1] == cover[2] and level[0] == level[1] == level[2]


def test_sweep_scores_some_rows_at_a_time():
    rng = np.random.default_rng(7)
    x, weights, offsets = rng.normal(size=(10_000, 64)), rng.normal(size=(64, 2000)), rng.normal(size=2000)
    total = np.zeros((2000, sweep.BINS), dtype=np.int64)
    tracemalloc.start()
    sweep._add_bins(total, x, weights, offsets)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert (total.sum(1) == len(x)).all()
    score = 1 / (1 + np.exp(-(x @ weights[:, 7] + offsets[7])))
    assert (total[7] == np.bincount((score * sweep.BINS).astype(int), minlength=sweep.BINS)).all()
    parts = list(many_models.counted(np.stack([total, 2 * total]), 5))
    assert max(len(p) for p in parts) <= 2 * many_models.COMBOS_OUT * sweep.BINS
    assert sum(p.n.sum() for p in parts) == 3 * total.sum() and {i for p in parts for i in p.id} == set(range(5, 2005))


def test_all_indices_compute_what_is_read(spark):
    df = spark.createDataFrame([(1, 0, 0, 9, 200, 30), (1, 1, 0, 90, 20, 130), (None, 1, 0, 1, None, 2)], "image_id int, x int, y int, r int, g int, b int")
    found = images.all_indices(df)
    rows = {(r["image_id"], r["x"], r["index"]): r["value"] for r in found.collect()}
    assert found.dtypes == [("image_id", "int"), ("x", "int"), ("y", "int"), ("index", "string"), ("value", "double")]
    assert found.count() == len(rows) == 3 * len(images.indices.PIXEL_INDICES) and rows[1, 0, "exg"] == 361 and rows[None, 1, "exg"] is None
    counted = found.filter("index = 'exg'").groupBy("image_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in counted and "CASE" not in counted.upper()


def test_contours_are_measured_in_arrays(spark, views):
    rows = [(1, 1, [(0, 0), (3, 0), (3, 4)]), (1, 2, [(5, 5)]), (1, 3, []), (1, 4, None), (1, 5, [(1, None), (2, 2)]), (1, 6, [(i % 7, i * i % 5) for i in range(20)])]
    df = spark.createDataFrame(rows, "image_id int, blob_id int, contour array<struct<x:int,y:int>>")
    found = df.select("blob_id", shape.perimeter(F.col("contour")).alias("p"), shape.area(F.col("contour")).alias("a"), shape.k_curvature(F.col("contour"), 3).alias("k"))
    assert "ArrowEvalPython" in plan_of(found)
    got = {r["blob_id"]: r for r in found.collect()}
    assert (got[1]["p"], got[1]["a"]) == (12.0, 6.0) and (got[2]["p"], got[3]["p"], got[4]["p"], got[5]["p"]) == (0.0, 0.0, None, None)
    assert got[3]["k"] == [] and got[4]["k"] is None and got[5]["k"] == [None, None]
    p = rows[5][2]
    for i, k in enumerate(got[6]["k"]):
        (bx, by), (x, y), (ax, ay) = p[i - 3], p[i], p[(i + 3) % 20]
        f1, f2 = ((ax - bx) / 3, (ay - by) / 3), ((ax - 2 * x + bx) / 9, (ay - 2 * y + by) / 9)
        assert abs(k - (4 * (f2[1] * f1[0] - f2[0] * f1[1]) ** 2 / ((f1[0] ** 2 + f1[1] ** 2) ** 3 + 1.1e-11)) ** 0.5) < 1e-9 * (1 + k)
    dealt = views.spread(spark.range(1000, numPartitions=8).toDF("id"), 50)
    assert dealt.rdd.getNumPartitions() == 20 and dealt.distinct().count() == 1000


def test_trees_walk_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(8)
    combos = np.array([(0, 3), (1, 2), (4, 0)])
    trees = many_models.Trees(combos, rng.integers(-1, 2, (3, 5, 16)), rng.normal(size=(3, 5, 16)), rng.random((3, 5, 16)))
    x = rng.normal(size=(40, 5))
    want = np.ones((40, 3, 5), dtype=int)
    for r, c, t in np.ndindex(want.shape):
        for _ in range(3):
            n = want[r, c, t]
            if trees.factor[c, t, n] >= 0:
                want[r, c, t] = 2 * n + (x[r, combos[c][trees.factor[c, t, n]]] > trees.cut[c, t, n])
    for many in (4, 500):
        monkeypatch.setattr(many_models, "TREES_AT_ONCE", many)
        assert (trees.leaves(x, 3) == want).all()
    share = [[[trees.share[c, t, want[r, c, t]] for t in range(5)] for c in range(3)] for r in range(40)]
    assert np.allclose(trees.scores(x), np.mean(share, axis=2))


def test_learning_queries_read_dealt_tables(spark, monkeypatch):
    from leafspark.plans import catalog_learning

    seen = []
    df = spark.range(5000, numPartitions=1).selectExpr("id", "array(id * 1D, id % 7 * 1D, id % 3 * 1D) features", "int(id % 2) type", "id % 5 < 2 is_train")
    monkeypatch.setattr(catalog_learning.models, "technique", lambda *_: type("T", (), {"fit": lambda self, train: lambda rows: seen.extend((train, rows)) or rows})())
    catalog_learning.trained(df, "ANY")
    assert [d.rdd.getNumPartitions() for d in seen] == [5, 5] and seen[0].count() + seen[1].count() == 5000
    seen.clear()
    kept = many_models.fit_many
    monkeypatch.setattr(many_models, "fit_many", lambda train, *a: seen.append(train) or kept(train, *a))
    found = sweep.technique_sweep(df, ["a", "b", "c"], 2, ["LDA"], ["NONE"])
    assert seen[0].rdd.getNumPartitions() == 2 and seen[0].count() == 2000 and found.count() == 3


def test_stream_rows_are_ordered_and_held_as_arrays():
    from leafspark.streaming import odometry

    rng = np.random.default_rng(9)
    ts = pd.to_datetime(rng.integers(0, 9, 60), unit="s").to_series().reset_index(drop=True)
    ts[7] = pd.NaT
    rows = pd.DataFrame({"ts": ts, "event_id": rng.integers(0, 3, 60).astype(float), "n": np.arange(60), "kind": ["a", None] * 30})
    rows.loc[5:9, "event_id"] = np.nan
    want = rows.sort_values(["ts", "event_id"], kind="stable").reset_index(drop=True)
    pd.testing.assert_frame_equal(odometry._in_order(rows, ["ts", "event_id"]), want)
    assert odometry._in_order(want, ["ts", "event_id"]) is want
    pd.testing.assert_frame_equal(odometry._unpack(odometry._pack(want)), want)


def test_small_images_are_one_tile(spark):
    """No pixel goes to tiles that own nothing, and the arrays of a stack have no empty margin."""
    pixels = spark.range(40 * 64).selectExpr("concat('=', id div 64) image_id", "cast(id % 8 as int) x", "cast(id div 8 % 8 as int) y")

    def work(stack):
        own = int(stack.own.sum())
        yield pd.DataFrame({"tiles": [stack.n], "sent": [len(stack.frame)], "own": [own], "side": [max(stack.shape[1:])]})
    for reach in (1, 9):
        got = tiles.map_tiles(pixels, ["image_id"], [], reach, work, "tiles long, sent long, own long, side long").toPandas()
        assert (got["tiles"].sum(), got["sent"].sum(), got["own"].sum()) == (40, 2560, 2560) and got["side"].max() == 8 + 2 * reach


def test_places_below_zero_have_tiles(spark):
    """Tiles see every neighbour within reach once, wherever the image lies."""
    rows = [("a", x, y) for x in range(-23, 9) for y in range(-3, 30)]

    def work(stack):
        on = stack.grid(np.ones(len(stack.frame), dtype=bool), False)
        at, row, col = stack.at[stack.own], stack.row[stack.own], stack.col[stack.own]
        near = sum(on[at, row + dy, col + dx].astype(int) for dy in range(-2, 3) for dx in range(-2, 3))
        x, y = stack.places(at, row, col)
        yield pd.DataFrame({"x": x, "y": y, "near": near})
    got = tiles.map_tiles(spark.createDataFrame(rows, "image_id string, x int, y int"), ["image_id"], [], 2, work, "x long, y long, near long", tile=7).collect()
    found = {(r["x"], r["y"]): r["near"] for r in got}
    on = {r[1:] for r in rows}
    assert len(got) == len(rows) and found == {(x, y): sum((x + dx, y + dy) in on for dx in range(-2, 3) for dy in range(-2, 3)) for x, y in on}


def test_blobs_of_one_tile_leave_as_factors(spark, monkeypatch):
    """The tile that holds a whole blob works its texture out; only numbers of split blobs leave for a second pass."""
    seen = []
    monkeypatch.setattr(blob_texture, "cut_lineage", lambda df: seen.append(session.cut_lineage(df)) or seen[-1])
    rows = [(1, x, y, 40, 130 if x < 6 else 60, 30 + x * y % 9) for x in range(12) for y in range(9)] + [(2, x, 3, 40, 130 if x < 90 else 60, 30 + x % 7) for x in range(100)]
    flow.image_factors(spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int")).count()
    kept = {(r["image_id"], r["split"]): r for r in seen[0].collect()}
    assert set(kept) == {("=1", False), ("=2", True)}
    assert kept["=1", False]["numbers"] is None and len(kept["=1", False]["lbp_stats"]) == 3 * len(blob_texture.NAMES)
    assert kept["=2", True]["glcm"] is None and len(kept["=2", True]["numbers"]) == blob_texture.GLCM_SIZE + blob_texture.LBP_SIZE


def test_stream_unpacks_images_once(spark, tmp_path):
    """Every step of the flow reads the pixels of a micro-batch from one table, and both tables of factors are written from one."""
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for frame in batches:
            runs.add(len(frame))
            yield frame
    pixels = spark.range(30 * 64).selectExpr("cast(id div 64 as string) image_id", "cast(id % 8 as int) x", "cast(id div 8 % 8 as int) y", "40 r", "cast(90 + id % 3 * 50 as int) g", "30 b")
    files.pack_images(pixels).select("image_id", "height", "width", "nChannels", "data").coalesce(1).write.parquet(str(tmp_path / "packed"))
    packed = spark.readStream.schema(image_streams.PACKED).parquet(str(tmp_path / "packed")).mapInPandas(counted, image_streams.PACKED)
    paths = [str(tmp_path / n) for n in ("scalars", "vectors")]
    image_streams.factor_stream(packed, *paths, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert runs.value == 30
    scalars, vectors = (spark.read.parquet(p).select("name").collect() for p in paths)
    assert sorted(scalars) == sorted(vectors) and len({r["name"].split("-blob")[0] for r in scalars}) == 30


def test_images_of_any_size_are_unpacked_together():
    rng = np.random.default_rng(4)
    sizes = [(2, 3, 3), (1, 1, 1), (4, 2, 4), (3, 3, 1)]
    data = [rng.integers(0, 256, s).astype(np.uint8) for s in sizes]
    rows = files._unpacked(pd.DataFrame({"image_id": list("abcd"), "height": [s[0] for s in sizes], "width": [s[1] for s in sizes],
                                         "nChannels": [s[2] for s in sizes], "data": [d.tobytes() for d in data]}))
    want = [(n, x, y, *(int(d[y, x, min(k, d.shape[2] - 1)]) for k in (2, 1, 0))) for n, d in zip("abcd", data) for y in range(d.shape[0]) for x in range(d.shape[1])]
    assert [tuple(r) for r in rows[["image_id", "x", "y", "r", "g", "b"]].itertuples(index=False)] == want


def test_neighbors_copy_no_vectors_for_packs(spark, monkeypatch):
    """However many packs there are, no vector is shuffled for them, and only tables of the answer stay behind."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "id bigint, features array<double>").cache()
    plans, made, cut, sessions = [], [], neighbors.cut_lineage, neighbors.drop_tables
    monkeypatch.setattr(neighbors, "cut_lineage", lambda d: plans.append(plan_of(d)) or made.append(cut(d)) or made[-1])
    monkeypatch.setattr(neighbors, "drop_tables", lambda *tables: [made.remove(t) for t in tables] and sessions(*tables))
    monkeypatch.setattr(neighbors, "BLOCK", 10)
    monkeypatch.setattr(neighbors, "MERGED", 3)
    near = neighbors.nearest_neighbors(df, df, 2, exclude_self=True)
    compared = [p for p in plans if "MapInArrow" in p]
    assert len(compared) >= 15 and not any("Exchange" in p or "CoGroup" in p for p in compared)
    assert made == [near] and len({f.rpartition("/")[0] for f in near.inputFiles()}) == 1
    x = np.array([r["features"] for r in df.orderBy("id").collect()])
    far = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag(np.full(300, np.inf))
    assert all([n["id"] for n in r["neighbors"]] == far[r["query_id"]].argsort()[:2].tolist() for r in near.collect())


def test_tables_in_between_leave_no_shuffle_files(spark):
    kept = spark.conf.get(session.CLEANUP, None)
    table = session.cut_lineage(spark.range(50).selectExpr("id % 5 k", "id").groupBy("k").count())
    folder = table.inputFiles()[0].rpartition("/")[0]
    assert spark.conf.get(session.CLEANUP, None) == kept and table.count() == 5
    session.drop_tables(table, spark.range(3))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_flow_broadcasts_no_table_that_grows(spark, monkeypatch):
    """Pixels take little room in files, so Spark would send whole tables of them to the driver and to all tasks."""
    pixels = spark.range(30 * 64).selectExpr("id div 64 image_id", "cast(id % 8 as int) x", "cast(id div 8 % 8 as int) y",
                                             "cast(id * 7 % 251 as int) r", "cast(id * 13 % 241 as int) g", "cast(id * 5 % 239 as int) b")
    columns = ["image_id", "blob_id", "area", "number", "red_contrast_avg", "hog_mean", "compactness"]
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    few = rows(flow.image_factors(pixels))
    plans, names = [], ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    for module in (flow, flow.contours, blob_texture):
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=module.cut_lineage: plans.append(plan_of(df.select("*"))) or cut(df))
    monkeypatch.setattr(session, "FEW_ROWS", -1)
    monkeypatch.setattr(flow, "FEW_ROWS", -1)
    many = flow.image_factors(pixels)
    assert len(plans) >= 10 and sum("SortMergeJoin" in p for p in plans) >= 5
    assert not any("BroadcastHashJoin" in p or "BroadcastExchange" in p for p in [*plans, plan_of(many)])
    assert few and rows(many) == few and [spark.conf.get(n, None) for n in names] == before
