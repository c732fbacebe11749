"""Whitening of embeddings from an exact scatter matrix.

Each entry becomes an integer. In a task, every dimension is shifted by its least value, and
each bit of the shifted values is packed over the rows into words: a bit plane. The number of
rows in which two bits are both set is a population count of the two planes' words ANDed, and
the cross-products of two dimensions are these counts weighted by the bits' values: integers,
exact. They are summed over all tasks as decimals and centred as integers; only then do they
become doubles, for the eigenvectors.

What passes the driver is one matrix of dimensions by dimensions, however many rows there are.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, ORIGIN = 64.0, 1_000_000
COMPONENTS = 32
#: Rows packed at a time; a multiple of 64.
ROWS = 4096
#: Entries beyond this count as not finite, so that all sums stay exact.
LARGEST = float(1 << 40)


def usable(vector: str) -> Column:
    """Not null, not empty, and each entry finite, not null and within ``LARGEST``."""
    x = F.col(vector)
    return x.isNotNull() & (F.size(x) > 0) & ~F.exists(
        x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) > LARGEST))


def _entries(column) -> np.ndarray:
    """The vectors as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def integers(entries: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * entries).astype(np.int64) + ORIGIN


def planes(shifted: np.ndarray) -> np.ndarray:
    """(bit, dimension, word): bit planes of rows of integers that aren't negative."""
    bits = max(int(shifted.max(initial=0)).bit_length(), 1)
    rows = -(-len(shifted) // 64) * 64
    padded = np.zeros((rows, shifted.shape[1]), np.int64)
    padded[:len(shifted)] = shifted
    turned = np.ascontiguousarray(padded.T)
    return np.stack([np.packbits((turned >> k & 1).astype(np.uint8), axis=1).view(np.uint64) for k in range(bits)])


def cross_products(shifted: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of the products of all pairs of dimensions, as Python integers."""
    bit = planes(shifted)
    n, d, _ = bit.shape
    # the weighted counts of few bits fit in 64 of them
    kind = np.int64 if 2 * n + (2 * len(shifted)).bit_length() < 62 else object
    out = np.zeros((d, d), kind)
    for k in range(n):
        weight = np.array([1 << (k + other) for other in range(k, n)], kind)[:, None]
        for row in range(d):
            both = np.bitwise_count(bit[k:] & bit[k, row]).sum(axis=2, dtype=np.int64).astype(kind) * weight
            out[row] += both[0]
            # a pair of two bits stands for both of its orders
            higher = both[1:].sum(axis=0)
            out[row] += higher
            out[:, row] += higher
    return out.astype(object)


@dataclass
class Scatter:
    """Exact sums over rows: of each dimension, and of the products of each pair."""
    n: int
    total: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> "Scatter":
        n, low = len(x), x.min(axis=0)
        shifted, low = x - low, low.astype(object)
        part = shifted.sum(axis=0).astype(object)
        cross = cross_products(shifted) + np.outer(low, part) + np.outer(part, low) + n * np.outer(low, low)
        return cls(n, part + n * low, cross)

    def __add__(self, other: "Scatter") -> "Scatter":
        return Scatter(self.n + other.n, self.total + other.total, self.cross + other.cross)


@dataclass
class Whitener:
    """A fit on ``n`` vectors of ``size`` entries: the integers' exact sums, and components by falling
    eigenvalue: unit eigenvectors as columns, eigenvalues, and their shares of all variance."""
    n: int
    size: int
    total: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, vector) of all usable vectors of the most frequent size (of equally frequent
    ones the greatest), and that size."""
    rows = table.where(usable(vector)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    size = F.size("vector").alias("size")
    most = rows.groupBy(size).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = most["size"] if most else 0
    return rows.where(F.size("vector") == size), size


def scatter(rows: DataFrame) -> DataFrame:
    """(i, j, value): exact sums of the products of dimensions i <= j; with j = -1 of dimension i
    alone, with i = j = -1 the number of rows."""
    kind = pa.decimal128(38, 0)

    def run(batches) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            x = integers(_entries(batch.column("vector")))
            for a in range(0, len(x), ROWS):
                part = Scatter.of(x[a:a + ROWS])
                whole = part if whole is None else whole + part
        if whole is not None:
            i, j = np.triu_indices(len(whole.total))
            d = np.arange(len(whole.total))
            value = [*whole.cross[i, j], *whole.total, whole.n]
            yield pa.record_batch({"i": pa.array(np.r_[i, d, -1], pa.int32()), "j": pa.array(np.r_[j, d * 0 - 1, -1], pa.int32()),
                                   "value": pa.array([Decimal(int(v)) for v in value], kind)})

    parts = rows.select("vector").mapInArrow(run, "i int, j int, value decimal(38,0)")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitener:
    """The whitening of rows of ``vectors``. Components without variance (at the rounding of
    doubles) are left out; one vector alone, or none, has no components. Eigenvalues in doubles
    are right to some 1e-15 of the greatest, so a component with a variance of 1e-11 of it or
    less is whitened to fewer digits (``identity_error`` tells)."""
    d = size
    n, total, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
    # d * (d + 3) / 2 + 1 rows, whatever the table holds
    for i, j, value in scatter(rows).collect():
        if i < 0:
            n = int(value)
        elif j < 0:
            total[i] = int(value)
        else:
            cross[i, j] = cross[j, i] = int(value)
    if not n:
        return Whitener(0, d, total, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    centred = n * cross - np.outer(total, total)
    variance = (centred / n ** 2).astype(np.float64)
    values, axes = np.linalg.eigh(variance)
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    kept = (values > values[0] * d * np.finfo(np.float64).eps * 4) & (np.arange(d) < components)
    trace = int(np.trace(centred)) / n ** 2
    return Whitener(n, d, total, axes[:, kept], values[kept], values[kept] / trace if trace else values[kept])


def deviations(x: np.ndarray, w: Whitener) -> tuple[np.ndarray, list]:
    """x - S / n as doubles, and the exact sums of (n x - S)^2; None where they exceed a long."""
    reach = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), *(abs(t) // w.n for t in w.total)) + 1
    if 2 * w.n * reach < 1 << 62:
        centred = w.n * x - w.total.astype(np.int64)
    else:
        centred = w.n * x.astype(object) - w.total
    furthest = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
    squares = centred if furthest ** 2 * max(w.size, 1) < 1 << 62 else centred.astype(object)
    sums = [int(v) if v < 1 << 63 else None for v in (squares ** 2).sum(axis=1).tolist()]
    return (centred / w.n).astype(np.float64), sums


def whiten(rows: DataFrame, w: Whitener) -> DataFrame:
    """Per row of ``vectors``: vec_id, deviation (exact sum over dimensions of (n x - S)^2,
    null where it exceeds a long) and whitened (a value for each component)."""
    turn = w.axes / np.sqrt(w.values)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred, sums = deviations(integers(_entries(batch.column("vector"))), w)
            values = centred @ turn
            ends = np.arange(len(values) + 1) * values.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sums, pa.int64()), lists],
                                             names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame) -> float:
    """Largest absolute entry of the covariance of ``whiten``'s values minus the identity,
    0 without rows. The values are centred already; what rounding left of their means goes too."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        n, total, cross = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = _entries(batch.column("whitened"))
                n, total, cross = n + len(x), total + x.sum(axis=0), cross + x.T @ x
        if n:
            i, j = np.triu_indices(len(total))
            d = np.arange(len(total))
            yield pa.record_batch({"i": pa.array(np.r_[i, d, -1], pa.int32()), "j": pa.array(np.r_[j, d * 0 - 1, -1], pa.int32()),
                                   "value": pa.array(np.r_[cross[i, j], total, n])})

    parts = whitened.where(F.size("whitened") > 0).select("whitened").mapInArrow(run, "i int, j int, value double")
    sums = {(i, j): v for i, j, v in parts.groupBy("i", "j").agg(F.sum("value")).collect()}
    if not sums:
        return 0.0
    n = sums[-1, -1]
    mean = {i: v / n for (i, j), v in sums.items() if j < 0 <= i}
    return max(abs(v / n - mean[i] * mean[j] - (i == j)) for (i, j), v in sums.items() if j >= 0)
