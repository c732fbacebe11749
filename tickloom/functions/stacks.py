"""Windows over the stacked histories of many symbols, as numpy arrays.

A window stage of Spark copies its input row and visits every bar of a frame, for each bar and
each column anew. A panel of fifty columns costs some 0.25 ms a bar that way. Here Spark
shuffles and sorts the bars by symbol and date, and a task takes whole symbols, some 65,000 bars at
a time, as Arrow tables: a window of n bars is then a few operations on whole arrays.

A missing value is NaN inside the arrays, and NaN counts as missing.
"""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import share_code
from .windows import by_symbol

#: Bars that a task takes at a time; a symbol with more bars is taken whole.
ROWS = 1 << 16
# weights below this change no digit of a sum
NOTHING = 1e-30


def known(x: np.ndarray) -> np.ndarray:
    return ~np.isnan(x)


class Stack:
    """Rows of whole symbols one after the other, by date. ``at``: a row's position in its symbol's
    rows."""

    def __init__(self, symbols: np.ndarray):
        rows = np.arange(len(symbols))
        first = np.ones(len(symbols), bool)
        first[1:] = symbols[1:] != symbols[:-1]
        self.first = np.maximum.accumulate(np.where(first, rows, 0))
        self.rows, self.at = rows, rows - self.first
        self.last = np.append(first[1:], True)
        size = self.at[self.last] + 1
        self.size = np.repeat(size, size)
        self.longest = int(size.max(initial=0))

    def part(self, keep: np.ndarray) -> "Stack":
        """Of whole symbols."""
        return Stack(self.first[keep])

    def lag(self, x: np.ndarray, n: int = 1, nothing=np.nan) -> np.ndarray:
        """The value ``n`` rows earlier in the symbol."""
        if n == 0:
            return x
        out = np.full(len(x), nothing, x.dtype)
        if n < len(x):
            out[n:] = np.where(self.at[n:] >= n, x[:-n], nothing)
        return out

    def lead(self, x: np.ndarray, n: int = 1, nothing=np.nan) -> np.ndarray:
        """The value ``n`` rows later in the symbol."""
        out = np.full(len(x), nothing, x.dtype)
        if n < len(x):
            out[:-n] = np.where(self.at[n:] >= n, x[n:], nothing)
        return out

    def sum(self, x: np.ndarray, n: int) -> np.ndarray:
        """Of the last ``n`` values, the oldest first; missing until there are ``n``."""
        total = self.lag(x, n - 1)
        for i in range(n - 2, -1, -1):
            total = total + self.lag(x, i)
        return total

    def mean(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.sum(x, n) / n

    def long_mean(self, x: np.ndarray, n: int, base: int = 10) -> np.ndarray:
        """Like ``rolling.mean_steps``: from sums of ``base`` values."""
        short, rest = self.sum(x, base), n % base
        total = short
        for distance in range(base, n - rest, base):
            total = total + self.lag(short, distance)
        if rest:
            total = total + self.lag(self.sum(x, rest), n - rest)
        return total / n

    def deviation(self, x: np.ndarray, n: int) -> np.ndarray:
        """Sample standard deviation of the last ``n`` values."""
        mean, m2 = np.zeros(len(x)), np.zeros(len(x))
        for seen, i in enumerate(range(n - 1, -1, -1), 1):
            delta = self.lag(x, i) - mean
            step = delta / seen
            mean, m2 = mean + step, m2 + delta * (delta - step)
        return np.sqrt(m2 / (n - 1))

    def extreme(self, x: np.ndarray, n: int, pick: Callable = np.fmax) -> np.ndarray:
        """Largest (``np.fmax``) or smallest (``np.fmin``) of the known among the last ``n`` values."""
        width = 1
        while 2 * width <= n:
            x, width = pick(x, self.lag(x, width)), 2 * width
        return pick(x, self.lag(x, n - width)) if width < n else x

    def whole_extreme(self, x: np.ndarray, n: int, pick: Callable = np.fmax) -> np.ndarray:
        """Missing until there are ``n`` values."""
        return np.where(self.count(known(x), n) == n, self.extreme(x, n, pick), np.nan)

    def seen(self, flags: np.ndarray) -> np.ndarray:
        """How many rows of the symbol held so far."""
        total = np.cumsum(flags)
        return total - (total - flags)[self.first]

    def count(self, flags: np.ndarray, n: int) -> np.ndarray:
        """How many of the last ``n`` rows held."""
        seen = self.seen(flags)
        return seen - self.lag(seen, n, 0)

    def latest(self, flags: np.ndarray) -> np.ndarray:
        """The row of the symbol that held last, -1 before the first one."""
        row = np.maximum.accumulate(np.where(flags, self.rows, -1))
        return np.where(row >= self.first, row, -1)

    def median(self, x: np.ndarray, n: int) -> np.ndarray:
        """Missing until there are ``n`` values."""
        held = np.stack([self.lag(x, i) for i in range(n)], axis=1)
        held = np.sort(held, axis=1)  # missing values last
        return np.where(known(held[:, -1]), 0.5 * held[:, (n - 1) // 2] + 0.5 * held[:, n // 2], np.nan)


class Smoothing:
    """Exponential smoothing (see ``functions.ewm``): ``y`` (its state, whatever the number of inputs),
    ``at`` (position ``index`` of the last input) and ``seen`` (inputs so far).

    A bar is a map y -> keep y + add; the maps of 1, 2, 4, ... bars are put together until they
    reach over the longest symbol. Without gaps between inputs ``keep`` is one number.
    ``seed``: position, state, last input and number of inputs to go on from, per row."""

    def __init__(self, stack: Stack, x: np.ndarray, alpha: float, index: np.ndarray, seed: dict[str, np.ndarray] | None = None):
        start = stop = np.full(len(x), np.nan)
        before = 0
        if seed is not None:
            x = np.where(known(seed["pos"]) & ~(index > seed["pos"]), np.nan, x)
            start, stop = seed["y"], seed["at"]
            before = np.where(known(seed["seen"]), seed["seen"], 0).astype(np.int64)
        given = known(x)
        last = stack.latest(given)
        earlier = stack.lag(last, 1, -1)
        stands = np.where(earlier >= 0, index[earlier], stop)
        gap = index - stands
        b = 1.0 - alpha
        left = np.power(b, gap)
        one = gap == 1
        share = np.where(known(gap), np.where(one, alpha, alpha / (left + alpha)), 1.0)
        keep = np.where(one, b, left / (left + alpha))
        first = given & (earlier < 0)
        # what a symbol starts with goes into its first input
        carried = np.where(first & known(gap) & known(start), keep * start, 0.0)
        y = np.where(given, share * x + carried, 0.0)
        inner = given & ~first
        width = 1
        if np.all(one[inner]):
            factor = b
            while width < stack.longest and factor > NOTHING:
                y, factor, width = y + factor * stack.lag(y, width, 0.0), factor * factor, 2 * width
        else:
            keep = np.where(inner, keep, np.where(given, 0.0, 1.0))
            while width < stack.longest:
                y, keep, width = y + keep * stack.lag(y, width, 0.0), keep * stack.lag(keep, width, 1.0), 2 * width
        self.y = np.where(last >= 0, y[last], start)
        self.at = np.where(last >= 0, index[last], stop)
        self.seen = stack.seen(given) + before

    def after(self, min_inputs: int) -> np.ndarray:
        return np.where(self.seen >= min_inputs, self.y, np.nan)


# ---------------------------------------------------------------- tables
def doubles(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy()


def as_arrow(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    if x.dtype.kind == "f":
        return pa.array(x, mask=np.isnan(x)).cast(kind)
    return pa.array(x).cast(kind)


def whole_symbols(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by symbol as tables of whole symbols, with a number per row that changes with
    the symbol."""
    held, count = [], 0

    def told(tables):
        table = pa.concat_tables(tables).combine_chunks()
        codes = table.column("symbol").combine_chunks().dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices
        return table, codes.fill_null(-1).to_numpy(zero_copy_only=False)

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count < rows:
            continue
        table, codes = told(held)
        cut = int(np.argmax(codes == codes[-1]))
        held, count = [table.slice(cut)], table.num_rows - cut
        if cut:
            yield table.slice(0, cut), codes[:cut]
        else:  # one long symbol: look again when there is twice as much
            rows = max(rows, 2 * count)
    if count:
        yield told(held)


def map_symbols(df: DataFrame, compute: Callable[[pa.Table, Stack], tuple[pa.Table, dict[str, np.ndarray]]],
                added: dict[str, str], dropped: Iterable[str] = ()) -> DataFrame:
    """``df`` by symbol and date with the columns ``added`` (name -> type): ``compute`` takes the rows
    of whole symbols and returns those that stay with the arrays to add."""
    keep = [f for f in df.schema.fields if f.name not in set(dropped)]
    schema = T.StructType([*keep, *[T.StructField(n, T.DoubleType() if t == "double" else T.LongType()
                                                  if t == "bigint" else T.IntegerType() if t == "int" else T.BooleanType())
                                    for n, t in added.items()]])
    names = [f.name for f in keep]
    kinds = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, codes in whole_symbols(batches):
            # missing and doubtful values are told by NaN
            with np.errstate(all="ignore"):
                rows, made = compute(table, Stack(codes))
            if not rows.num_rows:
                continue
            arrays = [rows.column(n).combine_chunks() for n in names]
            arrays += [as_arrow(made[n], kinds[t]) for n, t in added.items()]
            yield from pa.table(arrays, names=[*names, *added]).to_batches(max_chunksize=10_000)

    share_code(df.sparkSession)
    return by_symbol(df).sortWithinPartitions("symbol", "date").mapInArrow(run, schema)
