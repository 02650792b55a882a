"""Components and ordered contours by tiles against plain border following."""

import random

import pytest

from leafspark.operators import contours

AROUND = [(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)]  # clockwise from the left, (dx, dy), y downwards


def plain_components(on):
    """{pixel: first pixel of its component in reading order}"""
    label = {}
    for start in sorted(on, key=lambda p: (p[1], p[0])):
        if start in label:
            continue
        todo = [start]
        label[start] = start
        while todo:
            x, y = todo.pop()
            for dx, dy in AROUND:
                q = (x + dx, y + dy)
                if q in on and q not in label:
                    label[q] = start
                    todo.append(q)
    return label


def plain_contour(on, start):
    """Border following: from the first pixel counter-clockwise, looking round from where the walk came from."""
    around = lambda p, k: (p[0] + AROUND[k % 8][0], p[1] + AROUND[k % 8][1])
    k = next((k for k in range(8) if around(start, k) in on), None)  # clockwise from the left
    if k is None:
        return [start]
    last, points, here, came = around(start, k), [], start, around(start, k)
    while True:
        points.append(here)
        at = next(k for k in range(8) if around(here, k) == came)
        step = next(n for n in range(1, 9) if around(here, at - n) in on)  # counter-clockwise
        there = around(here, at - step)
        if there == start and here == last:
            return points
        came, here = here, there


def shapes():
    rng = random.Random(1)
    ring = {(x, y) for x in range(3, 9) for y in range(2, 8) if x in (3, 8) or y in (2, 7)}
    out = {0: {(5, 5)}, 1: {(x, 0) for x in range(6)}, 2: ring | {(5, 5)}, 3: {(1, 1), (2, 2), (3, 3), (3, 1)}, 4: {(0, 0), (1, 0), (0, 1), (1, 1), (4, 0)},
           5: {(x, y) for x in range(20) for y in range(3, 17)} - {(x, y) for x in range(4, 15) for y in range(6, 12)},
           6: {(x, y) for x in range(30) for y in range(30) if (x // 2 + y) % 4 == 0 or x == 3}, 7: {(x, 2 * y) for x in range(12) for y in range(4)} | {(11 * (y // 2 % 2 == 0), y) for y in range(1, 7, 2)}}
    for k in range(8, 24):
        out[k] = {(x, y) for x in range(23) for y in range(19) if rng.random() < (k % 4 + 2) / 6.5}
    return out


@pytest.mark.parametrize("tile", [64, 5])
def test_components_and_contours(spark, tile):
    images = shapes()
    mask = spark.createDataFrame([(i, x, y, int((x, y) in on)) for i, on in images.items() for x in range(31) for y in range(31)], "image_id int, x int, y int, v int")
    got = {(r["image_id"], r["x"], r["y"]): r["label"] for r in contours.components(mask, tile).collect()}
    labels = {i: plain_components(on) for i, on in images.items()}
    assert got == {(i, *p): (q[1] << 31) + q[0] for i, label in labels.items() for p, q in label.items()}
    blobs = contours.find_blobs(mask, 2, tile)
    sizes = {}
    for i, label in labels.items():
        for q in label.values():
            sizes[i, q] = sizes.get((i, q), 0) + 1
    rows = contours.contour_points(blobs, tile).collect()
    lines = {}
    for r in rows:
        lines.setdefault((r["image_id"], (r["blob_id"] & (1 << 31) - 1, r["blob_id"] >> 31)), []).append((r["i"], r["x"], r["y"]))
    want = {key: plain_contour(images[key[0]], key[1]) for key, n in sizes.items() if n > 2}
    assert {k: [p[1:] for p in sorted(v)] for k, v in lines.items()} == want
    assert all([p[0] for p in sorted(v)] == list(range(len(v))) for v in lines.values())
    arrays = {(r["image_id"], (r["blob_id"] & (1 << 31) - 1, r["blob_id"] >> 31)): [tuple(p) for p in r["contour"]] for r in contours.contours(blobs, tile).collect()}
    assert arrays == want


def test_contour_of_one_pixel_and_of_nothing(spark):
    mask = spark.createDataFrame([(1, 7, 9, 1), (2, 0, 0, 0)], "image_id int, x int, y int, v int")
    assert [tuple(r) for r in contours.contour_points(contours.find_blobs(mask)).collect()] == [(1, (9 << 31) + 7, 0, 7, 9)]
    assert contours.contour_points(contours.find_blobs(mask.filter("v = 2"))).count() == 0


def test_long_contour_across_tiles(spark):
    """A comb of 60 teeth over many tiles: one ring of some thousand points."""
    on = {(x, y) for x in range(120) for y in range(60) if y == 0 or x % 2 == 0}
    mask = spark.createDataFrame([(1, x, y, 1) for x, y in on], "image_id int, x int, y int, v int")
    rows = contours.contour_points(contours.find_blobs(mask, 0, 16), 16).collect()
    assert [(r["x"], r["y"]) for r in sorted(rows, key=lambda r: r["i"])] == plain_contour(on, (0, 0))


def test_pixels_without_an_image(spark):
    mask = spark.createDataFrame([(None, 1, 1, 1), (None, 2, 2, 1), (None, 9, 9, 1), (3, 1, 1, 1)], "image_id long, x int, y int, v int")
    blobs = contours.find_blobs(mask, 0, 4)
    assert sorted((r["image_id"] or 0, r["x"], r["blob_id"] >> 31) for r in blobs.collect()) == [(0, 1, 1), (0, 2, 1), (0, 9, 9), (3, 1, 1)]
    points = contours.contour_points(blobs, 4).collect()
    assert sorted((r["image_id"] or 0, r["i"], r["x"], r["y"]) for r in points) == [(0, 0, 1, 1), (0, 0, 9, 9), (0, 1, 2, 2), (3, 0, 1, 1)]
