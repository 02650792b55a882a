"""Whitening of embeddings by spectrum slicing.

Vectors become whole numbers, sums and the centred covariance of the distinct ones are gathered by tasks, and the leading
eigenpairs of that one square matrix are found on the driver: the signs of the pivots of an LDL' factorisation of V - sI
count the eigenvalues above s, halving by such counts leaves one eigenvalue (or one tight bunch) in an interval, Rayleigh
quotient iteration started there converges cubically, and two more counts around each result certify its number. Only
sums, dim x dim numbers and the components pass through the driver, however many vectors there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafspark.llm.shared import pick, write_table

STEP, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Whole numbers from here on are not exact as doubles.
LARGEST = 2 ** 52
#: Components with less than this part of the first eigenvalue are noise of the sums and not returned.
RANK = 1e-11


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric matrix above shift: positive pivots of LDL', complete pivoting, pivots of one or two rows."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        size = np.abs(a)
        largest, on = size.max(), int(size.diagonal().argmax())
        if largest == 0:
            break
        if size[on, on] >= 0.64 * largest:
            pivot, rest = a[on, on], np.delete(a[:, on], on)
            above += pivot > 0
            a = np.delete(np.delete(a, on, 0), on, 1) - np.outer(rest, rest / pivot)
        else:  # one eigenvalue of such a pair is positive, one negative
            pair = list(np.unravel_index(size.argmax(), size.shape))
            rest = np.delete(a[:, pair], pair, 0)
            above += 1
            a = np.delete(np.delete(a, pair, 0), pair, 1) - rest @ np.linalg.solve(a[np.ix_(pair, pair)], rest.T)
        a = (a + a.T) / 2
    return int(above)


def _quotient(matrix: np.ndarray, shift: float, found: np.ndarray, scale: float, rng) -> tuple[float, np.ndarray, float]:
    """(eigenvalue, unit vector, residual) by Rayleigh quotient iteration from shift, orthogonal to the found vectors."""
    def step(v, at):
        for nudge in (0.0, 1e-15, 1e-13):
            try:
                w = np.linalg.solve(matrix - (at + nudge * scale) * np.eye(len(matrix)), v)
                if np.isfinite(w).all():
                    break
            except np.linalg.LinAlgError:
                continue
        else:
            w = v
        w = w / np.abs(w).max()
        for _ in range(2):
            w = w - found.T @ (found @ w)
        return w / np.linalg.norm(w)
    v = step(step(rng.standard_normal(len(matrix)), shift), shift)
    best = None
    for _ in range(12):
        value = float(v @ matrix @ v)
        error = float(np.linalg.norm(matrix @ v - value * v))
        if best is not None and error >= best[2]:
            break
        best = (value, v, error)
        v = step(v, value)
    return best


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows) of the k largest eigenvalues, falling. A number that the counts do not confirm is an error."""
    scale, rng = float(np.abs(matrix).sum(1).max()), np.random.default_rng(0)
    k = min(k, len(matrix))
    values, vectors = np.zeros(0), np.zeros((0, len(matrix)))
    if not scale:
        return values, vectors
    tiny = 64 * np.finfo(float).eps * scale
    marks = {-1.01 * scale: len(matrix), 1.01 * scale: 0}

    def narrow(number: int) -> tuple[float, float]:
        return max(s for s, c in marks.items() if c >= number), min(s for s, c in marks.items() if c < number)

    def halve(number: int) -> None:
        low, high = narrow(number)
        marks[(low + high) / 2] = count_above(matrix, (low + high) / 2)
    for number in range(1, k + 1):
        low, high = narrow(number)
        while marks[low] - marks[high] > 1 and high - low > tiny:
            halve(number)
            low, high = narrow(number)
        while True:
            value, vector, _ = _quotient(matrix, (low + high) / 2, vectors, scale, rng)
            if low - tiny <= value <= high + tiny or high - low <= tiny:
                break
            halve(number)
            low, high = narrow(number)
        values, vectors = np.append(values, value), np.vstack([vectors, vector])
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[order]
    for number, value in enumerate(values, 1):
        if count_above(matrix, value + 4 * tiny) >= number or count_above(matrix, value - 4 * tiny) < number:
            raise ArithmeticError(f"eigenvalue {number} is not confirmed by counts")
    return values, vectors


@dataclass
class Whitening:
    n: int
    #: Per-dimension sums, whole numbers.
    sums: list[int]
    values: np.ndarray
    #: Unit eigenvectors as rows.
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the whole part taken off exactly."""
        return (x - self._whole()) - np.array([s % self.n for s in self.sums], np.float64) / self.n

    def _whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    def deviation(self, x: np.ndarray) -> np.ma.MaskedArray:
        """Sum of (n x - S)^2, exact; masked where it does not fit in 64 bits."""
        off = self.n * (x - self._whole()) - np.array([s % self.n for s in self.sums], np.int64)
        rough = np.square(self.n * self.centre(x)).sum(1)
        return np.ma.array(np.square(off).sum(1), mask=rough >= 9.2e18)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(rows that stay, their entries as whole numbers): null vectors and those with a null, non-finite or far too large
    entry go."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(STEP * flat) + SHIFT
        bad = ~(np.abs(x) < LARGEST)
    stays = column.is_valid().to_numpy(zero_copy_only=False).copy()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    stays[owner[bad]] = False
    kept = x[stays[owner]].astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths[stays])))
    return np.flatnonzero(stays), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(kept)).cast(pa.list_(pa.int64()))


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that stay, as a written table."""
    src = pick(vectors, vec_id=id_col, vector=vector_col)

    def run(batches):
        for batch in batches:
            rows, x = whole_numbers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), x], ["vec_id", "x"])
    return write_table(src.mapInArrow(run, f"vec_id {src.schema['vec_id'].dataType.simpleString()}, x array<bigint>"), "vectors")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _summed(rows: DataFrame, dim: int, width: int, product) -> np.ndarray:
    """Sum over all x matrices of product(x), width x width numbers: by tasks first, then by place."""
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                z = product(_matrix(batch.column(0), dim))
                total += z.T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])
    out = np.zeros((width, width))
    for i, j, v in rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect():  # width x width numbers
        out[i, j] = v
    return (out + out.T) / 2


def fit(quantised_rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct x vectors. Vectors of another length than the most common one (the shorter of equally
    common ones) are left out; None without vectors."""
    distinct = write_table(quantised_rows.select("x").distinct(), "fit-list")
    common = distinct.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None or not common["dim"]:
        return None
    dim, n = common["dim"], common["count"]
    rows = distinct.where(F.size("x") == dim)

    def halves(batches):  # high and low parts, so that no sum overflows
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            high, low = high + (x >> 24).sum(0), low + (x & 0xFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(high), pa.array(low)], ["i", "high", "low"])
    parts = rows.mapInArrow(halves, "i long, high long, low long").groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")) for c in ("high", "low")]).collect()
    sums = [(int(h) << 24) + int(low) for _, h, low in sorted(parts)]
    model = Whitening(n, sums, np.zeros(0), np.zeros((0, dim)), 0.0)
    covariance = _summed(rows, dim, dim, model.centre) / n
    values, vectors = leading(covariance, components)
    keep = values > RANK * values[0] if len(values) else np.zeros(0, bool)
    model.values, model.vectors, model.trace = values[keep], vectors[keep], float(np.trace(covariance))
    if len(model.values):
        k = len(model.values)
        model.identity_error = float(np.abs(_summed(rows, dim, k, model.project) / n - np.eye(k)).max())
    return model


def apply(quantised_rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    dim, k = model.dim, len(model.values)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 1_000) for i in range(0, batch.num_rows, 1_000)):
                x, m = _matrix(part.column(1), dim), part.num_rows
                deviation = model.deviation(x)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array(np.repeat(deviation.data, k), mask=np.repeat(np.ma.getmaskarray(deviation), k)), pa.array(model.project(x).ravel()),
                    pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, model.identity_error))], names)
    rows = quantised_rows.where(F.size("x") == dim).select("vec_id", "x")
    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit and apply. Rows whose vector is null, or holds a null, a non-finite entry or one of 2^52 / 64 or more, are
    dropped, and so are vectors of another length than most; repeated rows and ids, null ids included, each keep theirs.
    Components whose eigenvalue is nothing beside the first (equal vectors, too few of them) are not returned; a
    deviation that does not fit in 64 bits is null. Empty tables, or tables of empty vectors, give an empty table."""
    rows = quantised(vectors, id_col, vector_col)
    model = fit(rows, components)
    if model is None or not len(model.values):
        model = Whitening(1, [0], np.zeros(0), np.zeros((0, 1)), 1.0)
        rows = rows.limit(0)
    return apply(rows, model)
