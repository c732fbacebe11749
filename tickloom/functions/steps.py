"""Named column steps, added to a frame level by level.

A step is a column with the names of the columns it reads. ``add_steps`` puts
all steps whose inputs are ready into one ``select``, so Spark sees one window
stage per nesting level, all with the same partitioning and sort order: a
frame of fifty indicators costs one shuffle by symbol.

Window stages copy their whole input row. Columns that no later level reads are
therefore carried through the remaining stages inside one struct per level and
unpacked at the end; intermediate columns are dropped after their last reader.
"""

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import own_reach

# read by the windows and smoothing of any step
POSITION = ("symbol", "date", "bar_idx", "n_bars", "_blk")
# fewer columns than this are not worth a struct
PACK_FROM = 4


@dataclass(frozen=True)
class Step:
    """``reach``: bars before its own that the value depends on, for steps whose windows say
    more than they need; else it is taken from the windows."""

    reads: tuple[str, ...]
    build: Callable[[], Column]
    reach: int | None = None


def reach(book: Mapping[str, Step], wanted: Iterable[str], have: Iterable[str]) -> int | None:
    """How many bars before its own a bar needs for the ``wanted`` columns when a table has
    the columns ``have`` already; None if it needs them all."""
    known: dict[str, int | None] = dict.fromkeys(have, 0)

    def of(name: str) -> int | None:
        if name not in known:
            step = book[name]
            own = own_reach(step.build) if step.reach is None else step.reach
            below = [of(r) for r in step.reads]
            known[name] = None if own is None or None in below else own + max(below, default=0)
        return known[name]

    every = [of(name) for name in wanted]
    return None if None in every else max(every, default=0)


def add_steps(df: DataFrame, book: dict[str, Step], wanted: Iterable[str]) -> DataFrame:
    """``df`` with the ``wanted`` columns added."""
    wanted = list(dict.fromkeys(wanted))
    have = list(df.columns)
    level: dict[str, int] = dict.fromkeys(have, 0)

    def depth(name: str) -> int:
        if name not in level:
            if name not in book:
                raise KeyError(f"unknown column {name!r}")
            level[name] = 1 + max((depth(r) for r in book[name].reads), default=0)
        return level[name]

    last = max((depth(name) for name in wanted), default=0)
    steps = {n: k for n, k in level.items() if k > 0}
    outputs = list(dict.fromkeys([*have, *wanted]))
    last_read: dict[str, int] = {}
    for n, k in steps.items():
        for r in book[n].reads:
            last_read[r] = max(last_read.get(r, 0), k)

    loose, packed = list(have), {}
    for d in range(1, last + 1):
        new = sorted(n for n, k in steps.items() if k == d)
        df = df.select(*loose, *packed, *[book[n].build().alias(n) for n in new])
        alive = [*loose, *new]
        still = [c for c in alive if last_read.get(c, 0) > d or c in POSITION]
        done = [c for c in alive if c not in still and c in outputs]
        if d < last and len(done) >= PACK_FROM:
            df = df.select(*still, *packed, F.struct(*done).alias(f"_level{d}"))
            packed[f"_level{d}"] = done
            loose = still
        else:
            loose = still + done
    where = {c: F.col(f"{p}.{c}").alias(c) for p, cols in packed.items() for c in cols}
    return df.select(*[where.get(c, F.col(c)) for c in outputs])
