"""Hand-computed values and brute force on small inputs."""

import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspark.functions import catalog_of_factors, color, indices, metrics, rules, scalars
from leafspark.operators import (discriminant, evaluation, grouped, images, models, neighbors, odometry, plane, profile, ranking, resample, selection, shape,
                                 stencil, sweep, texture)
from leafspark.plans import flow
from leafspark.sources import documents, files, messages
from leafspark.streaming import images as image_streams
from leafspark.streaming import odometry as streams

GREEN, SOIL = (10, 200, 20), (120, 90, 60)


@pytest.fixture(scope="module")
def toy(spark):
    """4 x 4 image with a 2 x 2 green blob at (1, 1)."""
    rows = [(1, x, y, *(GREEN if x in (1, 2) and y in (1, 2) else SOIL)) for x in range(4) for y in range(4)]
    return spark.createDataFrame(rows, "image_id bigint, x int, y int, r int, g int, b int")


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_index_values(spark):
    r, g, b = (F.lit(c) for c in GREEN)
    assert one(spark, indices.exg(r, g, b)) == 370
    assert one(spark, indices.exr(r, g, b)) == pytest.approx(-187)
    assert one(spark, indices.cive(r, g, b)) == pytest.approx(0.441 * 10 - 0.811 * 200 + 0.385 * 20 + 18.78745)
    assert one(spark, indices.ndi(r, g, b)) == pytest.approx((190 / 210 + 1) * 128)
    zero = F.lit(0)
    assert one(spark, indices.ngrdi(zero, zero, zero)) == 0 and one(spark, indices.veg(zero, F.lit(5), zero)) == 0
    with pytest.raises(ValueError):
        indices.index("none", r, g, b)


def test_color_values(spark):
    hsv = color.hsv(F.lit(0), F.lit(255), F.lit(0))
    assert [one(spark, hsv[k]) for k in ("hsv_hue", "hsv_saturation", "value")] == [60, 255, 255]
    lab = color.cielab(F.lit(255), F.lit(255), F.lit(255))
    assert [one(spark, c) for c in lab.values()] == [255, 128, 128]
    ycc, swapped = color.ycbcr(F.lit(255), F.lit(0), F.lit(0)), color.ycbcr(F.lit(255), F.lit(0), F.lit(0), compat=True)
    assert one(spark, ycc["ycbcr_cr"]) == one(spark, swapped["ycbcr_cb"]) == 255


def test_toy_image_flow(toy):
    mask = flow.vegetation_mask(toy)
    assert mask.filter("v = 1").count() == 4
    blobs = shape.blob_geometry(stencil.find_blobs(mask, 1)).collect()
    assert [(b.area, b.x, b.y, b.w, b.h, b.size_ratio) for b in blobs] == [(4, 1, 1, 2, 2, 1.0)]
    factors = flow.image_factors(toy).collect()
    assert len(factors) == 1 and factors[0]["greyscale_energy_avg"] == pytest.approx(1.0) and factors[0]["reason"] == 0


def test_toy_glcm(spark):
    rows = [(1, x, y, v) for y, line in enumerate([[0, 0, 1], [0, 1, 1]]) for x, v in enumerate(line)]
    counts = texture.glcm(spark.createDataFrame(rows, "image_id int, x int, y int, v int"))
    got = {(r["angle"], r["i"], r["j"]): r["n"] for r in counts.collect()}
    assert got[("0", 0, 0)] == 1 and got[("0", 0, 1)] == 2 and got[("0", 1, 1)] == 1 and got[("90", 0, 1)] == 1
    props = texture.glcm_properties(counts, average=False).filter("angle = '0'").first()
    assert props["ASM"] == pytest.approx((1 + 4 + 1) / 16) and props["contrast"] == pytest.approx(0.5)


def square(n):
    return ([(x, 0) for x in range(n)] + [(n, y) for y in range(n)] + [(x, n) for x in range(n, 0, -1)] + [(0, y) for y in range(n, 0, -1)])


@pytest.fixture(scope="module")
def contours(spark):
    shapes = [(1, 1, [(x + 5, y + 5) for x, y in square(10)]), (1, 2, [(5, 5), (8, 5), (8, 9)])]
    return spark.createDataFrame(shapes, "image_id int, blob_id int, contour array<struct<x:int,y:int>>")


def test_square_and_triangle(contours):
    got = {r["blob_id"]: r for r in shape.shape_factors(contours, 100).collect()}
    assert got[1]["perimeter"] == 40 and got[1]["area"] == 100 and got[1]["compactness"] == pytest.approx(math.pi / 4)
    assert got[1]["shape_index"] == pytest.approx(1.0) and got[1]["elongation"] == 1 and got[1]["eccentricity"] == pytest.approx(1.0)
    assert got[2]["perimeter"] == pytest.approx(12) and got[2]["area"] == pytest.approx(6)
    hulls = {r["blob_id"]: r for r in shape.hull_factors(contours).collect()}
    assert hulls[1]["solidity"] == pytest.approx(1.0) and hulls[1]["convexity"] == pytest.approx(1.0)
    chain = contours.select("blob_id", shape.chain_code(F.col("contour")).alias("c")).filter("blob_id = 1").first()["c"]
    assert chain[:10] == [0] * 10 and chain[10] == 3 - 3 + 1 or len(chain) == 39
    radial = shape.radial(contours).filter("blob_id = 1").first()
    assert 0 < radial["radial_avg"] <= 1 and 0 <= radial["radial_crossings_pct"] <= 1


def hull_of(points):
    """Corners by testing every directed edge."""
    points = sorted(set(points))
    corners = set()
    for a, b in itertools.permutations(points, 2):
        sides = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in points]
        ahead = [(p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]) for p, s in zip(points, sides) if s == 0]
        length = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        if min(sides) >= 0 and min(ahead) >= 0 and max(ahead) <= length:
            corners |= {a, b}
    return corners


def test_hull_brute_force(spark):
    random.seed(3)
    shapes = [(1, i, [(random.randrange(12), random.randrange(12)) for _ in range(random.randrange(1, 15))]) for i in range(60)]
    shapes += [(1, 100, [(0, 0), (1, 1), (2, 2)]), (1, 101, [(4, 4)])]
    df = spark.createDataFrame(shapes, "image_id int, blob_id int, contour array<struct<x:int,y:int>>")
    got = {r["blob_id"]: {(p["x"], p["y"]) for p in r["h"]} for r in df.select("blob_id", shape.convex_hull(F.col("contour")).alias("h")).collect()}
    for _, blob, points in shapes:
        flat = len({(p[0], p[1]) for p in points}) < 2
        assert got[blob] == (set(points) if flat else hull_of(points)), blob


def flood(cells):
    cells, found = set(cells), []
    while cells:
        todo, part = [cells.pop()], set()
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & cells
            cells -= near
            todo += near
        found.append(frozenset(part))
    return set(found)


@pytest.mark.parametrize("density", [0.3, 0.5, 0.7])
def test_components_brute_force(spark, density):
    random.seed(int(density * 10))
    masks = {i: [(x, y) for x in range(24) for y in range(24) if random.random() < density] for i in (1, 2)}
    masks[3] = [(x, y) for y in range(0, 24, 2) for x in range(24)] + [(23 if y % 4 == 1 else 0, y) for y in range(1, 24, 2)]
    rows = [(i, x, y, 1) for i, cells in masks.items() for x, y in cells]
    labels = stencil.components(spark.createDataFrame(rows, "image_id int, x int, y int, v int")).collect()
    for image, cells in masks.items():
        groups = {}
        for r in labels:
            if r["image_id"] == image:
                groups.setdefault(r["label"], set()).add((r["x"], r["y"]))
        assert {frozenset(g) for g in groups.values()} == flood(cells)


def test_level_counts_brute_force(spark):
    random.seed(5)
    points = [(1, i, random.randrange(60), random.randrange(12)) for i in range(150)] + [(1, 500 + i, 7, 7) for i in range(40)] + [(2, 1, 3, 3)]
    df = spark.createDataFrame(points, "image_id int, blob_id int, cx int, cy int")
    got = {(r["image_id"], r["blob_id"]): (r["level"], r["off_level"]) for r in plane.level_counts(df).collect()}

    def level(a, b):
        dx, dy = abs(a[2] - b[2]), abs(a[3] - b[3])
        return (dx == dy == 0) or (dx > 0 and math.degrees(math.atan(dy / dx)) <= 5)
    for p in points:
        same = [q for q in points if q[0] == p[0]]
        n = sum(level(p, q) for q in same)
        assert got[p[:2]] == (n, len(same) - n)
    plane.WINDOW_LEVELS, kept = 2, plane.WINDOW_LEVELS
    try:
        again = {(r["image_id"], r["blob_id"]): (r["level"], r["off_level"]) for r in plane.level_counts(df).collect()}
    finally:
        plane.WINDOW_LEVELS = kept
    assert again == got


def test_nearest_blob_and_cover(spark):
    random.seed(6)
    lids = [(1, i, random.randrange(3000), random.randrange(3000)) for i in range(30)]
    spots = [(1, i, random.randrange(2000), random.randrange(2000)) for i in range(40)]
    got = plane.nearest_blob(spark.createDataFrame(lids, "image_id int, lid_id int, lx int, ly int"),
                             spark.createDataFrame(spots, "image_id int, blob_id int, cx int, cy int"))
    for r in got.collect():
        lid = lids[r["lid_id"]]
        best = min(((lid[2] - s[2]) ** 2 + (lid[3] - s[3]) ** 2, s[1]) for s in spots)
        assert r["blob_id"] == (best[1] if best[0] < 999 ** 2 else None)
    boxes = [(1, i, random.randrange(50), random.randrange(50), random.randrange(1, 40), random.randrange(1, 40)) for i in range(80)]
    df = spark.createDataFrame([(*b, b[2] + b[4] // 2, b[3] + b[5] // 2, 4) for b in boxes], "image_id int, blob_id int, x int, y int, w int, h int, cx int, cy int, type int")
    for r in plane.box_cover(df).collect():
        assert r["cover"] == sum(b[2] <= r["cx"] < b[2] + b[4] and b[3] <= r["cy"] < b[3] + b[5] for b in boxes)


@pytest.mark.parametrize("p,copies", [(1, 0), (2, 0), (2, 300)])
def test_neighbors_brute_force(spark, p, copies):
    """Also with a third of all rows being copies of one vector, and with blocks far smaller than the table."""
    rng = np.random.default_rng(4)
    points = [(i, [float(v) for v in rng.integers(0, 6, 3)]) for i in range(400)] + [(1000 + i, [1.0, 2.0, 3.0]) for i in range(copies)]
    df = spark.createDataFrame(points, "id bigint, features array<double>")
    neighbors.BLOCK, kept = 40, neighbors.BLOCK
    try:
        got = {r["query_id"]: [(n["dist"], n["id"]) for n in r["neighbors"]] for r in neighbors.nearest_neighbors(df, df, 4, p, exclude_self=True, pivots=7).collect()}
    finally:
        neighbors.BLOCK = kept
    x, ids = np.array([q[1] for q in points]), np.array([q[0] for q in points])
    assert len(got) == len(points)
    for i in range(0, len(points), 7):
        gap = np.abs(x - x[i])
        d = np.round(gap.sum(1) if p == 1 else np.sqrt((gap ** 2).sum(1)), 9)
        want = sorted((float(a), int(b)) for a, b in zip(d, ids) if b != ids[i])[:4]
        assert got[int(ids[i])] == want


def test_ordered_scan_with_a_hot_key(spark):
    random.seed(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, random.randrange(100), i if i % 5 == 0 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i int, v int, s int")
    got = grouped.ordered_scan(df, ["k"], ["i"], F.floor(F.col("i") / 16), lags={"before": F.col("v")}, sums={"total": F.col("v")},
                               last={"seen": F.col("s")}, rank="n").collect()
    state = {}
    for k, i, v, s in rows:
        n, total, before, seen = state.get(k, (0, 0, None, None))
        seen = s if s is not None else seen
        state[k] = (n + 1, total + v, v, seen)
        r = next(g for g in got if g["k"] == k and g["i"] == i)
        assert (r["n"], r["total"], r["before"], r["seen"]) == (n + 1, total + v, before, seen)


def test_golden_confusion(spark):
    """Predicted and actual pairs of a published classification: 26, 3, 5 and 201 rows."""
    rows = [(t, a) for (t, a), n in {(0, 0): 26, (0, 1): 3, (1, 0): 5, (1, 1): 201}.items() for _ in range(n)]
    table = evaluation.confusion_table(spark.createDataFrame(rows, "type int, actual int"), [])
    r = evaluation.with_metrics(table, metrics.scores, metrics.rates, metrics.agreement, metrics.field_rates).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (201, 5, 26, 3)
    assert r["accuracy"] == pytest.approx(227 / 235) and r["precision"] == pytest.approx(201 / 206) and r["fpr"] == pytest.approx(5 / 31)
    assert r["miss_rate"] == pytest.approx(500 / 31) and r["prevalence"] == pytest.approx(204 / 235)


def test_auc_equals_rank_form(spark):
    random.seed(2)
    rows = [(round(random.random(), 2), random.randrange(2)) for _ in range(300)]
    got = evaluation.auc(spark.createDataFrame(rows, "score double, actual int"), []).first()["auc"]
    pos, neg = [s for s, a in rows if a], [s for s, a in rows if not a]
    assert got == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))


def test_otsu_and_triangle_brute_force(spark):
    random.seed(9)
    images_ = {i: [min(255, max(0, int(random.gauss(m, 12)))) for m in ([40] * 150 + [180] * 60)] for i in range(3)}
    rows = [(i, x, 0, v) for i, vs in images_.items() for x, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "image_id int, x int, y int, v int")
    got = {r["image_id"]: r["threshold"] for r in stencil.otsu(df, F.col("v")).collect()}
    for i, vs in images_.items():
        a = np.array(vs)
        spread = {t: (a <= t).mean() * (a > t).mean() * (a[a <= t].mean() - a[a > t].mean()) ** 2 for t in range(255) if 0 < (a <= t).sum() < len(a)}
        assert spread[got[i]] == pytest.approx(max(spread.values()))
    assert all(0 <= r["threshold"] <= 255 for r in stencil.triangle(df, F.col("v")).collect())


def test_blur_keeps_a_flat_image(spark):
    df = spark.createDataFrame([(1, x, y, 77) for x in range(9) for y in range(8)], "image_id int, x int, y int, v int")
    assert {r["v"] for r in stencil.blur(df, 9, 8).collect()} == {77}


def test_lbp_tiles_agree_with_one_tile(spark):
    random.seed(8)
    df = spark.createDataFrame([(1, x, y, random.randrange(256)) for x in range(40) for y in range(30)], "image_id int, x int, y int, v int")
    whole, tiled = (sorted(tuple(r) for r in texture.lbp_codes(df, points=8, radius=2.0, tile=t).collect()) for t in (64, 8))
    assert whole == tiled and len(whole) == 1200


def test_classes_after_correction(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(0 if i % 5 else 2, 1, 3)], 0 if i % 5 == 0 else 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, type int")
    for name in ("SMOTE", "ADASYN", "BORDERLINE", "KMEANS", "SVM"):
        out = resample.correct(df, name)
        sizes = resample.class_sizes(out)
        assert sizes[1] == 160 and 120 <= sizes[0] <= 200, (name, sizes)
        assert out.select("id").distinct().count() == out.count()
    made = resample.smote(df).filter("id < 0").collect()
    low, high = np.array([r[1] for r in rows if r[2] == 0]).min(0), np.array([r[1] for r in rows if r[2] == 0]).max(0)
    assert len(made) == 120 and all((np.array(m["features"]) >= low - 1e-9).all() and (np.array(m["features"]) <= high + 1e-9).all() for m in made)
    assert resample.class_sizes(resample.create_imbalance(df, 2, 1))[1] < 60
    halves = resample.split_stratified(df).groupBy("type", "is_train").count().collect()
    assert {(r["type"], r["is_train"]): r["count"] for r in halves} == {(0, True): 16, (0, False): 24, (1, True): 64, (1, False): 96}


def test_models_separate_easy_classes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(3 * (i % 2), 1, 2)], i % 2) for i in range(300)]
    df = resample.split(spark.createDataFrame(rows, "id bigint, features array<double>, type int")).cache()
    train, test = df.filter("is_train"), df.filter("not is_train")
    for name in ("LOGISTIC", "DECISIONTREE", "RANDOMFOREST", "GRADIENT", "EXTRA", "SVM", "MLP", "LDA", "KNN"):
        options = {"RANDOMFOREST": {"trees": 10}, "EXTRA": {"trees": 10}, "GRADIENT": {"rounds": 3}}.get(name, {})
        r = models.assess(models.technique(name, 2, **options).fit(train)(test)).first()
        assert r["accuracy"] > 0.9 and r["auc"] > 0.9, name
    odd = models.technique("OCC", 2).fit(train)(test).first()
    assert 0 <= odd["score"] <= 1
    with pytest.raises(ValueError):
        models.technique("NONE", 2)
    folds = models.cross_validate(df.drop("is_train"), models.technique("LDA", 2)).collect()
    assert len(folds) == 5 and all(f["accuracy"] > 0.9 for f in folds)
    none = test.withColumns({"prediction": F.lit(0), "score": F.lit(0.1)})
    assert models.assess(none, compat=True).select(F.col("tp") + F.col("fp")).first()[0] == 1


def test_sweep_matches_single_fits(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal([i % 2, 0, 2 * (i % 2), 0], 1)], i % 2) for i in range(400)]
    df = resample.split(spark.createDataFrame(rows, "id bigint, features array<double>, type int"))
    train, test, names = df.filter("is_train"), df.filter("not is_train"), list("abcd")
    got = {tuple(r["parameters"]): r for r in sweep.discriminant_sweep(train, test, names, 2).collect()}
    assert set(got) == set(itertools.combinations(names, 2))
    for at in itertools.combinations(range(4), 2):
        weights, offset = discriminant.ClassSums(train, 4).solve(at)
        r = models.assess(test.withColumn("score", discriminant.score_column(weights, offset, at)).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))).first()
        assert got[tuple(names[i] for i in at)]["accuracy"] == pytest.approx(r["accuracy"])
        assert got[tuple(names[i] for i in at)]["auc"] == pytest.approx(r["auc"], abs=5e-3)


def test_selectors(spark):
    rows = [(i, [float(i % 2), float(i % 7), 3.0], i % 2) for i in range(70)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, type int")
    table = selection.all_selectors(df, ["a", "b", "c"], {"Recursive": {"trees": 3}, "Importance": {"trees": 3}})
    got = {r["factor"]: r for r in table.collect()}
    assert got["a"]["Recursive"] == 1 and got["a"]["Importance"] > got["c"]["Importance"] and got["c"]["Variance"] == 0


def test_factor_catalogue():
    rows = catalog_of_factors.factor_rows()
    assert len({r[2] for r in rows}) == len(rows)
    assert len(catalog_of_factors.select_factors(subtypes=("GLCM",))) == 114
    assert len(catalog_of_factors.select_factors(kind="VECTOR")) == 19
    assert catalog_of_factors.select_factors(types=("COLOR",)) == ["hue", "saturation_mean", "in_phase", "cb_mean"]


def test_quantiles_and_profile(spark):
    random.seed(4)
    rows = [(i % 2, float(random.randrange(20))) for i in range(101)]
    got = profile.exact_quantiles(spark.createDataFrame(rows, "k int, value double"), ["k"], [0.1, 0.5, 0.9], chunks=4).collect()
    for r in got:
        assert r["quantile"] == pytest.approx(np.quantile([v for k, v in rows if k == r["k"]], r["p"]))


def test_ranking_ties_and_combinations(spark):
    rows = [(i, "LDA", "NONE", s, s, s, s, s, s, ["hue", "bending"], 2) for i, s in enumerate([0.5, 0.9, 0.9, 0.1])]
    df = spark.createDataFrame(rows, "id bigint, technique string, correction string, accuracy double, auc double, precision double, recall double, f1 double, map double, parameters array<string>, status int")
    assert ranking.best_rows(df, "auc").first()["id"] == 1
    top = {r["id"]: (r["place"], r["winner"]) for r in ranking.top_with_equals(df, "auc", 2).collect()}
    assert top == {1: (1, True), 2: (1, False), 0: (2, True)}
    combos = ranking.combinations_of(spark.createDataFrame([(f,) for f in "abcde"], "factor string"), 3).collect()
    assert {tuple(r["factors"]) for r in combos} == set(itertools.combinations("abcde", 3))
    assert one(spark, scalars.bag_cosine(F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "abc")))) == pytest.approx(3 / math.sqrt(15))


READINGS = "device bigint, ts timestamp, event_id bigint, angle double, sequence bigint"


@pytest.fixture(scope="module")
def readings(spark):
    random.seed(7)
    rows = [(i % 3, i, i, float(random.randrange(-50, 90)), random.choice([-1, i // 9, i // 9 + 1])) for i in range(240)]
    raw = spark.createDataFrame(rows, "device bigint, s bigint, event_id bigint, angle double, sequence bigint")
    return raw.select("device", F.timestamp_seconds((F.col("s") + 1) * 400).alias("ts"), "event_id", "angle", "sequence")  # after 1970-01-01: a new watermark takes that moment for late


def test_sequence_labels(spark):
    rows = [(1, i, i, s) for i, s in enumerate([-1, 1, 2, 2, 4])]
    df = spark.createDataFrame(rows, "device bigint, s bigint, event_id bigint, sequence bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = [r["state"] for r in odometry.check_sequence(df).orderBy("event_id").collect()]
    assert got == ["reset", "ok", "ok", "duplicate", "gap"]


def drain(spark, stream, folder):
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_streams_equal_folds(spark, readings, tmp_path):
    """The stream sees the readings in three ordered files, one micro-batch each."""
    for k in range(3):
        part = readings.filter((F.col("event_id") >= 80 * k) & (F.col("event_id") < 80 * k + 80))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    scan = odometry.travel(readings, 0.5, 1000)
    batch = streams.travel(readings, 0.5, 1000)
    keep = ["event_id", "mm", "total_mm", "pulses"]
    near = lambda d: [tuple(round(v, 6) for v in r) for r in rows(d.select(*keep))]
    assert near(scan) == near(batch) == near(drain(spark, streams.travel(source, 0.5, 1000), tmp_path / "travel"))

    moves = batch.select("device", "ts", "event_id", "mm")
    said = {r["event_id"]: r for r in streams.announce(moves, 20.0).collect()}
    since, total = {}, 0
    for r in sorted(moves.collect(), key=lambda m: (m["ts"], m["event_id"])):
        since[r["device"]] = since.get(r["device"], 0.0) + r["mm"]
        hit = abs(since[r["device"]]) >= 20
        assert (r["event_id"] in said) == hit
        if hit:
            assert said[r["event_id"]]["distance"] == pytest.approx(since[r["device"]])
            since[r["device"]], total = 0.0, total + 1
    assert total == len(said) > 0

    feed = scan.select("device", "ts", "event_id", "sequence", "total_mm", F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), "kph")
    for k in range(3):
        feed.filter((F.col("event_id") >= 80 * k) & (F.col("event_id") < 80 * k + 80)).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    live = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    gsd = {"color": 10.0, "depth": 30.0}
    assert rows(streams.captures(feed, gsd)) == rows(drain(spark, streams.captures(live, gsd), tmp_path / "captures"))


def png(path, pixels):
    """Write rows of (r, g, b) as a PNG file."""
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files_and_stream(spark, tmp_path):
    folder = tmp_path / "pictures"
    folder.mkdir()
    picture = [[GREEN if x in (3, 4) and y in (2, 3) else SOIL for x in range(8)] for y in range(6)]
    png(folder / "a.png", picture)
    png(folder / "b.png", picture)
    pixels = files.read_pixels(spark, str(folder)).collect()
    assert len(pixels) == 96
    assert all((p["r"], p["g"], p["b"]) == picture[p["y"]][p["x"]] for p in pixels)
    run = image_streams.factor_stream(image_streams.image_stream(spark, str(folder)), str(tmp_path / "s"), str(tmp_path / "v"), str(tmp_path / "c"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert len(spark.read.parquet(str(tmp_path / "v")).first()["greyscale_lbp"]) == 26


def test_sinks(spark, views, tmp_path):
    files.save_results(views.results, str(tmp_path / "r"))
    assert files.load_results(spark, str(tmp_path / "r")).filter("technique = 'KNN'").count() == views.results.filter("technique = 'KNN'").count()
    files.append_performance(views.perf_log, str(tmp_path / "p"))
    files.append_performance(views.perf_log, str(tmp_path / "p"))
    assert files.read_performance(spark, str(tmp_path / "p")).count() == 2 * views.perf_log.count()
    files.organise(views.images.withColumn("agl", scalars.nearest_bucket(F.col("altitude"), [100, 500])), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).filter("agl = 100").count() > 0
    views.factors.select("hue", "type").coalesce(1).write.option("header", True).csv(str(tmp_path / "f"))
    assert files.read_factors(spark, str(tmp_path / "f"), ["hue"]).agg(F.sum("hue")).first()[0] == pytest.approx(views.factors.agg(F.sum("hue")).first()[0])
    (tmp_path / "imu.csv").write_text("x,y,z\n0.1,0.2,0.3\n")
    assert tuple(files.read_imu_log(spark, str(tmp_path / "imu.csv")).first()) == (0.1, 0.2, 0.3)


def test_document_rules(spark, views):
    with pytest.raises(TypeError):
        documents.find_images(views.images, "corn", begin_agl=1)
    with pytest.raises(TypeError):
        documents.find_blobs(views.blobs, parent=1)
    df = spark.createDataFrame([(1, 7), (2, 8), (3, 8)], "image_id int, hash int")
    assert documents.find_image_by_hash(df, 7).count() == 1
    with pytest.raises(Exception, match="more than one"):
        documents.find_image_by_hash(df, 8).collect()
    stored = spark.createDataFrame([(1, {"ndi": "old", "exg": "kept"}), (2, {})], "image_id int, processed map<string,string>")
    fresh = spark.createDataFrame([(1, {"ndi": "new"}), (3, {"tgi": "t"})], "image_id int, processed map<string,string>")
    got = {r["image_id"]: r["processed"] for r in documents.upsert_images(stored, fresh).collect()}
    assert got == {1: {"exg": "kept", "ndi": "new"}, 2: {}, 3: {"tgi": "t"}}


def test_message_defaults(spark):
    got = messages.parse(spark.createDataFrame([('{"distance": 4.5}',), ("{}",)], "value string"), "odometry").collect()
    assert [(r["type"], r["distance"], r["gyro"], r["sequence"]) for r in got] == [("UNKNOWN", 4.5, [], 0), ("UNKNOWN", 0.0, [], 0)]


def test_rules(spark):
    assert one(spark, scalars.nearest_bucket(F.lit(58.0), [10, 60, 100])) == 60
    assert one(spark, scalars.emitter_line(F.lit("RIGHT"), F.lit(4), F.lit(3))) == "line23"
    assert one(spark, scalars.from_dms(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("W"))) == -10.5
    assert one(spark, scalars.from_dms(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("W"), compat=True)) == 10.5
    assert one(spark, rules.label(F.lit(3))) == "Ignored"
    assert one(spark, scalars.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111195, rel=1e-3)


def test_no_pair_products_in_plans(views):
    """The plane and evaluation operators plan without cartesian products or nested-loop joins of tables."""
    for df in (plane.level_counts(views.blobs.select("image_id", "blob_id", "cx", "cy")), plane.ignore_overlaps(views.blobs),
               evaluation.roc_points(views.predictions, ["technique"]), odometry.travel(views.odometry, 0.5, 1000), images.hv(views.pixels)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_null_keys_and_order_values_stay(spark):
    from leafspark.operators import grouped
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), (1, 1, 5.0), (1, None, 7.0), (None, None, 1.0)], "device long, ts long, v double")
    with_n = grouped.with_group_stats(df, ["device"], n=F.count(F.lit(1)), total=F.sum("v")).collect()
    assert sorted((str(r["device"]), r["n"], r["total"]) for r in with_n) == [("1", 2, 12.0)] * 2 + [("None", 3, 6.0)] * 3
    for chunk in (F.col("ts"), grouped.quantile_chunk(df, "ts", 4), F.lit(0)):
        rows = grouped.ordered_scan(df, ["device"], ["ts"], chunk, lags={"before": F.col("v")}, sums={"so_far": F.col("v")}, rank="n").collect()
        got = sorted((str(r["device"]), r["n"], r["v"], r["before"], r["so_far"]) for r in rows)
        assert got == [("1", 1, 7.0, None, 7.0), ("1", 2, 5.0, 7.0, 12.0), ("None", 1, 1.0, None, 1.0), ("None", 2, 2.0, 1.0, 3.0), ("None", 3, 3.0, 2.0, 6.0)]


def test_rows_without_a_score_take_no_part(spark):
    from leafspark.operators import evaluation
    df = spark.createDataFrame([("a", 0.9, 1), ("a", None, 0), ("a", 0.2, 0), ("a", None, 1), (None, 0.5, 1), (None, 0.4, 0)], "k string, score double, actual int")
    points = {(r["k"], r["threshold"]): (r["fpr"], r["tpr"]) for r in evaluation.roc_points(df, ["k"]).collect()}
    assert points == {("a", 0.9): (0.0, 1.0), ("a", 0.2): (1.0, 1.0), (None, 0.5): (0.0, 1.0), (None, 0.4): (1.0, 1.0)}
    assert {r["k"]: r["without_score"] for r in evaluation.without_score(df, ["k"]).collect()} == {"a": 2, None: 0}


def test_large_identifiers_hash_evenly(spark):
    from leafspark.operators import resample
    df = spark.range(5_000_000_000_000_000, 5_000_000_000_004_000)
    shares = [r[0] for r in df.select(resample.hash_share(F.col("id"))).collect()]
    assert 0.47 < sum(shares) / len(shares) < 0.53 and len(set(shares)) > 3990
    assert 0.37 < sum(s < 0.4 for s in shares) / len(shares) < 0.43


def test_targets_have_one_layout(spark):
    from leafspark.sources import messages
    df = spark.createDataFrame([(1, x, y, 1.0) for x in range(0, 600, 20) for y in (3, 300)], "image_id int, x int, y int, distance double")
    coded = messages.encode_targets(df, ["image_id"])
    assert coded.count() == 6 and messages.decode_targets(coded).drop("part").exceptAll(df).count() == 0


def test_unreadable_pictures_are_listed(spark, tmp_path):
    from leafspark.sources import files
    (tmp_path / "bad.png").write_bytes(b"no picture")
    folder = f"file://{tmp_path}"
    assert files.read_pixels(spark, folder).count() == 0
    assert [r["image_id"].rsplit("/", 1)[-1] for r in files.rejected_images(spark, folder).collect()] == ["bad.png"]


def device_rows(n):
    return [(d, f"2024-01-01 00:00:{i:02d}", i + 100 * d, float((i * 37) % 90), i, float(i * 30)) for d in (1, 2) for i in range(n)]


@pytest.mark.parametrize("kind", ["travel", "announce", "captures"])
def test_streams_fold_in_event_order(spark, tmp_path, kind):
    """Files that come out of order give what one sorted batch gives."""
    from leafspark.streaming import odometry
    df = spark.createDataFrame(device_rows(30), "device long, t string, event_id long, angle double, sequence long, total_mm double").select(
        "device", F.to_timestamp("t").alias("ts"), "event_id", "angle", "sequence", "total_mm", (F.col("angle") - 40).alias("mm"),
        F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit(3.0).alias("kph"))
    run = {"travel": lambda d: odometry.travel(d, 0.5, 1000, delay="20 seconds"), "announce": lambda d: odometry.announce(d, 50.0, delay="20 seconds"),
           "captures": lambda d: odometry.captures(d, {"color": 40.0}, delay="20 seconds")}[kind]
    second = F.second("ts")
    closing = df.filter("event_id = 100").withColumns({"device": F.lit(9).cast("long"), "ts": F.to_timestamp(F.lit("2024-01-01 01:00:00"))})
    for part in (df.filter((second >= 6) & (second < 12)), df.filter(second < 6), df.filter((second >= 18)), df.filter((second >= 12) & (second < 18)), closing):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = run(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"file://{tmp_path}/out").filter("device < 9").orderBy("device", "event_id").collect()
    want = run(df).orderBy("device", "event_id").collect()
    assert len(want) > 3 and got == want


def test_rerun_best_fits_every_technique(spark):
    from leafspark.operators import resample, sweep
    rows = [(i, [float(i % 7), float((i * 13) % 11) + (4.0 if i % 3 == 0 else 0.0), float(i % 5)], int(i % 3 == 0)) for i in range(240)]
    df = resample.split(spark.createDataFrame(rows, "id long, features array<double>, type int"))
    runs = [(0, "LDA", "NONE", 0.8, ["a", "b"]), (1, "DECISIONTREE", "SMOTE", 0.9, ["b"]), (2, "DECISIONTREE", "NONE", 0.1, ["a"])]
    results = spark.createDataFrame(runs, "id long, technique string, correction string, auc double, parameters array<string>")
    got = {r["technique"]: r for r in sweep.rerun_best(df, results, ["a", "b", "c"]).collect()}
    assert set(got) == {"LDA", "DECISIONTREE"} and all(r["auc"] > 0.6 for r in got.values())


def test_class_sums_with_large_means(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) + 1e8
    y = (x[:, 0] - 1e8 + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(i, list(map(float, x[i])), int(y[i])) for i in range(300)], "id long, features array<double>, type int").repartition(3)
    sums = discriminant.ClassSums(df, 5)
    want = sum((x[y == t] - x[y == t].mean(0)).T @ (x[y == t] - x[y == t].mean(0)) for t in (0, 1)) / 298
    assert np.allclose(sums.covariance, want, rtol=1e-6, atol=1e-6) and sums.n == [int((y == 0).sum()), int((y == 1).sum())]
    with pytest.raises(ValueError):
        discriminant.ClassSums(df.filter("type = 0"), 5)
