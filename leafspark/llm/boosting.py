"""Small histogram boosting for two classes: trees are lists of leaf paths, so they can be read as rules."""

from __future__ import annotations

import numpy as np

#: A path: conditions (feature, above, limit) that all hold.
Path = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, bins: int = 32, rate: float = 0.3, least: int = 10):
    """(start, trees): the log odds of the share of ones, and for each tree its leaves (path, step) and inner paths."""
    limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    codes = [np.searchsorted(limits[j], x[:, j], side="left") for j in range(x.shape[1])]  # code <= k: value <= limit k
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p) + 1e-9
        leaves: list[tuple[Path, float]] = []
        inner: list[Path] = []
        todo: list[tuple[np.ndarray, Path, int]] = [(np.arange(len(y)), (), 0)]
        while todo:
            rows, path, level = todo.pop()
            best = (1e-6, None, None)
            for j, code in enumerate(codes if level < depth and len(rows) >= 2 * least else []):
                if not len(limits[j]):
                    continue
                g, h, n = (np.bincount(code[rows], w, len(limits[j]) + 1).cumsum() for w in (slope[rows], curve[rows], None))
                gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
                gain[(n[:-1] < least) | (n[-1] - n[:-1] < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] is None:
                step = rate * float(slope[rows].sum() / (curve[rows].sum() + 1))
                margin[rows] += step
                leaves.append((path, step))
                continue
            _, j, k = best
            low = codes[j][rows] <= k
            for above, part in ((False, rows[low]), (True, rows[~low])):
                longer = path + ((j, above, float(limits[j][k])),)
                inner.append(longer)
                todo.append((part, longer, level + 1))
        trees.append((leaves, inner))
    return start, trees


def holds(x: np.ndarray, path: Path) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, limit in path:
        out &= (x[:, j] > limit) if above else (x[:, j] <= limit)
    return out


def margins(x: np.ndarray, start: float, trees) -> np.ndarray:
    total = np.full(len(x), start)
    for leaves, _ in trees:
        for path, step in leaves:
            total[holds(x, path)] += step
    return total
