"""Rolling helpers over one symbol's ordered history.

Every window of a plan is partitioned by ``symbol`` and ordered by
``(_blk, date)``. ``_blk`` numbers runs of ``BLOCK`` bars; it never changes the
order (it grows with the date) but lets the block-partitioned windows of
``ewm`` share the very same sort.

A window group is one symbol's history with at most one row per calendar day
(``unique_bars`` makes sure of it before anything else), that is at most 366
rows a year: the size of a group is bounded by the calendar, not by the table.
"""

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BLOCK = 4096


def by_symbol(df: DataFrame) -> DataFrame:
    """Shuffle by symbol into the session's number of shuffle partitions.

    The window stages behind it need far more work per byte than the size-based
    merging of small partitions expects, so the number is given explicitly."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "symbol")


def number_bars(df: DataFrame, min_bars: int = 0) -> DataFrame:
    """Add ``bar_idx`` (0-based position in the symbol's history), ``n_bars``
    and ``_blk``; drop symbols with fewer than ``min_bars`` bars. A stored panel
    already has the first two."""
    if "bar_idx" in df.columns and "n_bars" in df.columns:  # a stored panel
        df = df.filter(F.col("n_bars") >= min_bars) if min_bars else df
        return df.withColumn("_blk", F.floor(F.col("bar_idx") / BLOCK))
    df = df.drop("bar_idx", "n_bars")
    by_date = Window.partitionBy("symbol").orderBy("date")
    whole = by_date.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.select(
        "*",
        (F.row_number().over(by_date) - 1).alias("bar_idx"),
        F.count(F.lit(1)).over(whole).cast("int").alias("n_bars"),
    )
    if min_bars:
        df = df.filter(F.col("n_bars") >= min_bars)
    return df.withColumn("_blk", F.floor(F.col("bar_idx") / BLOCK))


_noted: ContextVar[list[int | None] | None] = ContextVar("_noted", default=None)


def note_reach(bars: int | None) -> None:
    """The column being built looks so many bars back; None: at all of them."""
    notes = _noted.get()
    if notes is not None:
        notes.append(bars)


def own_reach(build: Callable[[], Column]) -> int | None:
    """How many bars before its own the windows of a column look at, None for all."""
    token = _noted.set([])
    try:
        build()
        notes = _noted.get()
    finally:
        _noted.reset(token)
    return None if None in notes else max(notes, default=0)


def _ordered() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("_blk", "date")


def history() -> WindowSpec:
    note_reach(None)
    return _ordered()


def between(first: int, last: int) -> WindowSpec:
    """Bars from ``first`` to ``last``, counted from a bar's own."""
    note_reach(max(-first, 0))
    return _ordered().rowsBetween(first, last)


def trailing(n: int) -> WindowSpec:
    return between(-(n - 1), 0)


def so_far() -> WindowSpec:
    return history().rowsBetween(Window.unboundedPreceding, 0)


def lag(col: str, n: int = 1) -> Column:
    note_reach(n)
    return F.lag(col, n).over(_ordered())


def lead(col: str, n: int = 1) -> Column:
    return F.lead(col, n).over(_ordered())


def rolling(agg: Callable, col: str, n: int, min_periods: int | None = None) -> Column:
    """``agg(col)`` over the last ``n`` bars, null until ``min_periods`` values."""
    w = trailing(n)
    enough = F.count(col).over(w) >= (n if min_periods is None else min_periods)
    return F.when(enough, agg(col).over(w))


def any_in_last(flag: str, n: int) -> Column:
    """True when ``flag`` held on any of the last ``n`` bars (fewer at the start)."""
    if n == 1:
        return F.coalesce(F.col(flag), F.lit(False))
    return F.coalesce(F.bool_or(flag).over(trailing(n)), F.lit(False))


def all_in_last(flag: str, n: int, partial: bool = False) -> Column:
    """True when ``flag`` (null counts as false) held on all of the last ``n``
    bars; a short history fails unless ``partial``."""
    w = trailing(n)
    held = F.sum(F.when(F.col(flag), 1).otherwise(0)).over(w)
    rows = F.count(F.lit(1)).over(w)
    return held == (rows if partial else F.lit(n))
