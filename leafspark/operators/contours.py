"""Components of masks and their ordered outer contours, by tiles.

A side of a blob pixel that faces the background is an edge. Walking with the blob to the left, every edge has one next
edge, which the surrounding pixels decide (pixels that touch at a corner are connected), so the edges of a blob form
rings: one around it, one around each hole. The outer ring is cut open at the left side of the blob's first pixel and
put in order by list ranking: tiles add up their stretches with doubling pointers, then the few edges at which a ring
enters a tile are ranked by doubling pointers across tiles. No task holds a blob or an image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.operators import tiles
from leafspark.operators.grouped import with_group_stats
from leafspark.session import cut_lineage

#: Sides in walking order (left, bottom, right, top): outward step (row, column); the walk along a side goes the way the next side faces.
SIDES = ((0, -1), (1, 0), (0, 1), (-1, 0))
_ROW = 1 << 31


def _labels(mask: np.ndarray) -> np.ndarray:
    """Flat index of the first cell of each cell's component, eight neighbours, for a stack of masks; -1 outside."""
    flat = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    parent = np.append(flat.ravel(), mask.size)
    on = np.flatnonzero(mask)
    while True:
        view = parent[:-1].reshape(mask.shape)
        low = view.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                src = view[:, max(0, -dy):view.shape[1] - max(0, dy), max(0, -dx):view.shape[2] - max(0, dx)]
                dst = low[:, max(0, dy):view.shape[1] - max(0, -dy), max(0, dx):view.shape[2] - max(0, -dx)]
                np.minimum(dst, src, out=dst)
        low = np.where(mask, low, mask.size).ravel()
        after = parent.copy()
        np.minimum.at(after, parent[on], low[on])  # the root of a cell goes to the least label next to the cell
        after[on] = np.minimum(after[on], low[on])
        while True:
            jumped = after[after]
            if (jumped == after).all():
                break
            after = jumped
        if (after == parent).all():
            return np.where(mask, parent[:-1].reshape(mask.shape), -1)
        parent = after


def _spread_min(edges: DataFrame, above: bool) -> DataFrame:
    """One star step on edges (image, a, b): link neighbours of each node to the least of them.

    ``above``: neighbours over the node go to the least node around it; otherwise the lower ones do, and the node too.
    """
    ends = edges if not above else edges.unionByName(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
    if not above:
        ends = edges.select("image_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ends.groupBy("image_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = ends.join(least, ["image_id", "a"])
    if above:
        out = linked.filter("b > a").select("image_id", F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select("image_id", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("image_id", "a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def name_images(df: DataFrame) -> DataFrame:
    """image_id as a text that is never null, so that joins and Python keep pixels without an image together."""
    return df.withColumn("image_id", F.coalesce(F.concat(F.lit("="), F.col("image_id").cast("string")), F.lit("")))


def restore_images(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("image_id", F.when(F.col("image_id") != "", F.substr(F.col("image_id"), F.lit(2)).cast(kind)))


def components(mask: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """Eight-neighbour components of a mask (image_id, x, y, v): image_id, x, y, label = y * 2^31 + x of the first pixel.

    Tiles label their own pixels; labels that touch across tiles are then contracted by alternating star steps. A mask
    that fits in single tiles needs no step.
    """
    kind = mask.schema["image_id"].dataType.simpleString()

    def work(stack: tiles.Stack):
        on = stack.grid(np.ones(len(stack.frame), dtype=bool), False)
        inside = on & stack.inside()
        label = _labels(inside)
        at, row, col = np.nonzero(inside)
        first = label[at, row, col]
        x, y = stack.places(at, row, col)
        fx, fy = stack.places(*np.unravel_index(first, inside.shape))
        code = fy.astype(np.int64) * _ROW + fx
        yield pd.DataFrame({"image_id": stack.heads["image_id"].to_numpy()[at], "x": x, "y": y, "label": code, "touch": False})
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                # Pixels of the border that this tile's pixels touch: they hear of its label.
                there = on[at, row + dy, col + dx] & ~inside[at, row + dy, col + dx]
                if there.any():
                    tx, ty = stack.places(at[there], row[there] + dy, col[there] + dx)
                    yield pd.DataFrame({"image_id": stack.heads["image_id"].to_numpy()[at[there]], "x": tx, "y": ty, "label": code[there], "touch": True})

    on = name_images(mask.filter("v > 0")).select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    found = cut_lineage(tiles.map_tiles(on, ["image_id"], [], 1, work, "image_id string, x int, y int, label long, touch boolean", tile))
    own = found.filter("not touch").drop("touch")
    heard = found.filter("touch").select("image_id", "x", "y", F.col("label").alias("a")).distinct()
    if heard.isEmpty():
        return restore_images(own, kind)
    edges = heard.join(own, ["image_id", "x", "y"]).select("image_id", "a", F.col("label").alias("b")).distinct()
    before = None
    while True:
        edges = cut_lineage(_spread_min(_spread_min(edges, above=True), above=False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("image_id", "a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("image_id", F.greatest("a", "b").alias("label")).agg(F.min(F.least("a", "b")).alias("root"))
    own = own.join(roots, ["image_id", "label"], "left").select("image_id", "x", "y", F.coalesce("root", "label").alias("label"))
    return restore_images(own, kind)


def find_blobs(mask: DataFrame, min_area: int = 0, tile: int = tiles.TILE) -> DataFrame:
    """Blobs of a mask as pixel rows: image_id, blob_id, x, y. Blobs need more than ``min_area`` pixels."""
    sized = with_group_stats(components(mask, tile), ["image_id", "label"], _area=F.count(F.lit(1)))
    return sized.filter(F.col("_area") > min_area).select("image_id", F.col("label").alias("blob_id"), "x", "y")


def _edges(stack: tiles.Stack) -> dict[str, np.ndarray]:
    """The edges that the tiles own: cell, side, the next edge's cell and side, whether a visit of the pixel begins with
    it, and whether the edge before it belongs to another tile."""
    on = stack.grid(np.ones(len(stack.frame), dtype=bool), False)
    inside = stack.inside()
    own = on & inside
    parts: dict[str, list] = {n: [] for n in ("at", "row", "col", "side", "row2", "col2", "side2", "head", "enters")}
    for side, (oy, ox) in enumerate(SIDES):
        dy, dx = SIDES[(side + 1) % 4]
        by, bx = SIDES[(side + 3) % 4]  # the side that comes before
        at, row, col = np.nonzero(own & ~np.roll(on, (-oy, -ox), (1, 2)))
        corner = on[at, row + dy + oy, col + dx + ox]
        ahead = on[at, row + dy, col + dx]
        # Same pixel before: that side is open and so is the corner between.
        over = on[at, row + by + oy, col + bx + ox]
        head = on[at, row + by, col + bx] | over
        enters = head & ~inside[row + by + np.where(over, oy, 0), col + bx + np.where(over, ox, 0)]
        parts["at"].append(at)
        parts["row"].append(row)
        parts["col"].append(col)
        parts["side"].append(np.full(len(at), side))
        parts["row2"].append(row + np.where(corner, dy + oy, np.where(ahead, dy, 0)))
        parts["col2"].append(col + np.where(corner, dx + ox, np.where(ahead, dx, 0)))
        parts["side2"].append(np.where(corner, (side + 3) % 4, np.where(ahead, side, (side + 1) % 4)))
        parts["head"].append(head)
        parts["enters"].append(enters)
    return {n: np.concatenate(p) for n, p in parts.items()}


def _ranked(stack: tiles.Stack) -> pd.DataFrame:
    """One row an edge: its code, the points from it to where its ring leaves the tile, and the edge at which it does
    (null at the end of the ring). Rings that close inside a tile are holes and left out."""
    e = _edges(stack)
    blob = stack.grid("blob_id", -1)[e["at"], e["row"], e["col"]]
    x, y = stack.places(e["at"], e["row"], e["col"])
    x2, y2 = stack.places(e["at"], e["row2"], e["col2"])
    first = (y.astype(np.int64) * _ROW + x) == blob
    to_first = (y2.astype(np.int64) * _ROW + x2 == blob) & (e["side2"] == 0)
    # The first pixel's visit begins before the cut: it counts at the cut and not again at the end.
    same = (e["row2"] == e["row"]) & (e["col2"] == e["col"])
    cell = np.ravel_multi_index((e["at"], e["row"], e["col"]), stack.shape)
    ends = np.zeros((4, stack.n * stack.shape[1] * stack.shape[2]), dtype=bool)  # visits that run into the cut, by side
    ends[3, cell[first & (e["side"] == 3)]] = True
    for side in (2, 1):
        runs = first & same & (e["side"] == side)
        ends[side, cell[runs & ends[side + 1, cell]]] = True
    head = (e["head"] & ~(first & ends[e["side"], cell])) | (first & (e["side"] == 0))
    # Pointers inside the tile; size means away.
    size = len(x)
    index = np.full((stack.n * stack.shape[1] * stack.shape[2], 4), size)
    index[cell, e["side"]] = np.arange(size)
    inside = stack.inside()[e["row2"], e["col2"]]
    cell2 = np.ravel_multi_index((e["at"], e["row2"], e["col2"]), stack.shape)
    leap = np.append(np.where(inside & ~to_first, index[cell2, e["side2"]], size), size)
    weight = np.append(head.astype(np.int64), 0)
    last = np.append(np.arange(size), size)  # the last edge of the stretch
    total, onward = weight.copy(), leap.copy()
    for _ in range(max(1, int(size).bit_length())):
        live = onward < size
        if not live.any():
            break
        last[live] = last[onward[live]]
        total[live] += total[onward[live]]
        onward[live] = onward[onward[live]]
    done = onward[:-1] == size
    out = last[:-1]
    codes = lambda px, py, s: (py.astype(np.int64) * _ROW + px) * 4 + s
    leaves = ~to_first[out]
    target = pd.array(codes(x2[out], y2[out], e["side2"][out]), dtype="Int64")
    target[~leaves] = pd.NA
    return pd.DataFrame({"image_id": stack.heads["image_id"].to_numpy()[e["at"]], "blob_id": blob, "code": codes(x, y, e["side"]), "x": x, "y": y,
                         "head": head, "enters": e["enters"] & ~(first & (e["side"] == 0)), "points": total[:-1], "onward": target})[done]


def contour_points(blobs: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """image_id, blob_id, i, x, y: the outer contour of each blob, every border pixel in order.

    blobs: pixel rows as from :func:`find_blobs`. A contour starts at the first pixel of the topmost row and goes down its
    left side first; a pixel is listed as often as the walk comes by, a blob of one pixel has one point.
    """
    kinds = {c: blobs.schema[c].dataType.simpleString() for c in ("image_id", "blob_id")}
    schema = f"image_id string, blob_id {kinds['blob_id']}, code long, x int, y int, head boolean, enters boolean, points long, onward long"
    pixels = name_images(blobs).select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "blob_id")
    edges = cut_lineage(tiles.map_tiles(pixels, ["image_id"], ["blob_id"], 1, lambda stack: iter([_ranked(stack)]), schema, tile))
    # Edges that enter a tile are the nodes of the ranking; each round doubles how far a node sees.
    nodes = edges.filter("enters").select("image_id", "code", F.col("points").alias("sum"), "onward")
    ranked = None
    finished = -1
    while True:
        now = nodes.filter("onward is null").count()
        if now == finished or not nodes.filter("onward is not null").limit(1).count():
            break  # what is not at an end by now goes round a hole
        finished = now
        far = nodes.select("image_id", F.col("code").alias("onward"), F.col("sum").alias("more"), F.col("onward").alias("after"))
        nodes = cut_lineage(nodes.join(far, ["image_id", "onward"], "left").select(
            "image_id", "code", (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum"), F.col("after").alias("onward")))
    ranked = nodes.filter("onward is null").select("image_id", F.col("code").alias("onward"), F.col("sum").alias("rest"))
    points = edges.filter("head").join(ranked, ["image_id", "onward"], "left").filter("onward is null or rest is not null")
    points = points.select("image_id", "blob_id", "x", "y", (F.col("points") + F.coalesce("rest", F.lit(0))).alias("left"))
    lengths = points.groupBy("image_id", "blob_id").agg(F.max("left").alias("length"))
    placed = points.join(lengths, ["image_id", "blob_id"]).select("image_id", "blob_id", (F.col("length") - F.col("left")).cast("int").alias("i"), "x", "y")
    return restore_images(placed, kinds["image_id"])


def contours(blobs: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """image_id, blob_id, contour: the points of :func:`contour_points` as one array a blob, for the shape factors."""
    packed = contour_points(blobs, tile).groupBy("image_id", "blob_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    return packed.select("image_id", "blob_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("contour"))
