"""Square tiles of images with a border, for work that needs a pixel's surroundings as arrays.

Pixels go to the tile that owns them and to the tiles whose border they lie in, so a task holds a few tiles and never an
image. Tiles arrive sorted and are worked on in stacks of dense arrays. The first tile begins a border's width before 0,
so that the pixels of an image's first rows and columns are no border of tiles that own nothing: a small image is one tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a tile, and cells of a stack.
TILE, STACK_CELLS = 64, 1_500_000


def tile_of(place: Column, reach: int, tile: int = TILE) -> Column:
    """The number of the tile, along one axis, that owns a place."""
    return F.floor((place + reach) / tile)


class Stack:
    """Some tiles as arrays [tile, row, column]; rows and columns that hold no pixel of any of them are left out, but for
    ``reach`` on every side."""

    def __init__(self, frame: pd.DataFrame, first: np.ndarray, keys: Sequence[str], tile: int, reach: int):
        self.tile, self.reach, self.n = tile, reach, len(first)
        self.heads = frame.iloc[first].reset_index(drop=True)[[*keys, "tx", "ty"]]
        self.at = np.repeat(np.arange(self.n), np.diff([*first, len(frame)]))
        row, col = ((frame[c] - frame[f"t{c}"] * tile).to_numpy() + 2 * reach for c in "yx")
        self.skip = max(0, int(row.min()) - reach), max(0, int(col.min()) - reach)
        self.row, self.col = row - self.skip[0], col - self.skip[1]
        self.shape = (self.n, int(self.row.max()) + 1 + reach, int(self.col.max()) + 1 + reach)
        self.frame = frame

    def grid(self, values, fill=0) -> np.ndarray:
        """A dense array of a column (or of given values), ``fill`` where there is no pixel."""
        values = self.frame[values].to_numpy() if isinstance(values, str) else np.asarray(values)
        out = np.full((*self.shape, *values.shape[1:]), fill, dtype=values.dtype)
        out[self.at, self.row, self.col] = values
        return out

    @property
    def own(self) -> np.ndarray:
        """Which rows of the frame belong to their tile and not to its border."""
        return self.inside()[self.row, self.col]

    def inside(self) -> np.ndarray:
        """The cells [row, column] that tiles own."""
        out = np.zeros(self.shape[1:], dtype=bool)
        rows, cols = (slice(max(0, self.reach - skip), self.reach + self.tile - skip) for skip in self.skip)
        out[rows, cols] = True
        return out

    def places(self, at: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and y in the image of cells."""
        corner = self.heads[["tx", "ty"]].to_numpy()[at] * self.tile - 2 * self.reach
        return col + corner[:, 0] + self.skip[1], row + corner[:, 1] + self.skip[0]


def map_tiles(pixels: DataFrame, keys: Sequence[str], values: Sequence[str], reach: int, work: Callable[[Stack], Iterator[pd.DataFrame]], schema: str,
              tile: int = TILE, made: dict[str, Column] | None = None, stack_cells: int = STACK_CELLS) -> DataFrame:
    """``work`` on every stack of tiles. pixels: keys, x, y and the columns of values, none of the keys null.

    ``made`` are columns that follow from the others; they are computed after the shuffle, so they do not travel.
    """
    cells = lambda c: F.explode(F.sequence(tile_of(F.col(c) - reach, reach, tile), tile_of(F.col(c) + reach, reach, tile)))
    sent = pixels.select(*keys, "x", "y", *values, cells("x").alias("tx")).select("*", cells("y").alias("ty"))
    group = [*keys, "tx", "ty"]

    def run(batches):
        rest = None
        for frame in batches:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            first = _firsts(frame, group)
            whole = len(first) - 1  # the last tile may go on in the next batch
            rest = frame.iloc[first[whole]:].reset_index(drop=True)
            yield from _stacks(frame.iloc[:first[whole]], first[:whole], keys, tile, reach, work, stack_cells)
        if rest is not None and len(rest):
            yield from _stacks(rest, np.zeros(1, dtype=int), keys, tile, reach, work, stack_cells)

    # A stated number of partitions: the rows are small, and adaptive execution would put the work into few tasks.
    many = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(many, *group).sortWithinPartitions(*group)
    return dealt.select("*", *[c.alias(n) for n, c in (made or {}).items()]).mapInPandas(run, schema)


def _firsts(frame: pd.DataFrame, group: list[str]) -> np.ndarray:
    changes = np.zeros(len(frame), dtype=bool)
    changes[0] = True
    for name in group:
        column = frame[name].to_numpy()
        changes[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(changes)


def _stacks(frame, first, keys, tile, reach, work, stack_cells):
    side = tile + 2 * reach
    if not len(first):
        return
    # Tiles of small images fill few cells; a stack may then hold more of them.
    spread = lambda place: min(side, int(place.max() - place.min()) + 1 + 2 * reach)
    many = max(1, stack_cells // (spread(frame["y"] - frame["ty"] * tile) * spread(frame["x"] - frame["tx"] * tile)))
    ends = [*first, len(frame)]
    for k in range(0, len(first), many):
        last = min(k + many, len(first))
        part = frame.iloc[ends[k]:ends[last]].reset_index(drop=True)
        yield from work(Stack(part, np.asarray(first[k:last]) - ends[k], keys, tile, reach))
