"""Long rolling windows in two short steps.

Spark evaluates a sliding frame of n rows with n updates per row. A long frame is
therefore put together from short ones: the aggregate of the last few bars,
looked up at the distances that tile the long frame. For 252 bars that is 16
updates and 16 look-ups per bar instead of 252 updates, on the same sort.
"""

from functools import reduce

from pyspark.sql import functions as F

from .steps import Step
from .windows import lag, rolling, so_far, trailing


def _back(name: str, distance: int) -> tuple[str, dict[str, Step]]:
    if distance == 0:
        return name, {}
    back = f"{name}_back{distance}"
    return back, {back: Step((name,), lambda: lag(name, distance))}


def mean_steps(out: str, col: str, n: int, base: int = 10) -> dict[str, Step]:
    """Mean of the last ``n`` values, null until there are ``n``."""
    short, rest = f"_{col}_sum{base}", n % base
    book = {short: Step((col,), lambda: rolling(F.sum, col, base))}
    parts = []
    for distance in range(0, n - rest, base):
        name, step = _back(short, distance)
        parts.append(name)
        book |= step
    if rest:  # the oldest values, fewer than ``base``
        oldest = f"_{col}_sum{rest}"
        book[oldest] = Step((col,), lambda: rolling(F.sum, col, rest))
        name, step = _back(oldest, n - rest)
        parts.append(name)
        book |= step
    book[out] = Step(tuple(parts), lambda: reduce(
        lambda a, b: a + b, [F.col(p) for p in parts]) / n)
    return book


def extreme_steps(out: str, col: str, agg: str, n: int, min_periods: int,
                  base: int = 16) -> dict[str, Step]:
    """Largest (``agg`` "max") or smallest ("min") of the last ``n`` values, null
    until there are ``min_periods`` of them."""
    pick, widest = (F.max, F.greatest) if agg == "max" else (F.min, F.least)
    short = f"_{col}_{agg}{base}"
    seen = f"_{col}_seen"
    book = {short: Step((col,), lambda: pick(col).over(trailing(base))),
            # only differences of it are used
            seen: Step((col,), lambda: F.count(col).over(so_far()), 0)}
    parts = []
    for distance in [*range(0, n - base, base), n - base]:
        name, step = _back(short, distance)
        parts.append(name)
        book |= step
    earlier, step = _back(seen, n)
    book |= step

    def value():
        known = F.col(seen) - F.coalesce(F.col(earlier), F.lit(0))
        return F.when(known >= min_periods, widest(*[F.col(p) for p in parts]))

    book[out] = Step((*parts, seen, earlier), value)
    return book


def gather_steps(out: str, flags: dict[str, str], first: int, last: int,
                 base: int = 16) -> dict[str, Step]:
    """Array of the values of the bars ``first`` to ``last`` back (both included)
    where their flag holds; ``flags`` maps value column to flag column. The
    order inside the array is not defined."""
    short, single = f"_{out}_{base}", f"_{out}_1"
    reads = (*flags, *flags.values())

    def gathered():
        lists = [F.collect_list(F.when(F.col(flag), F.col(col))).over(trailing(base))
                 for col, flag in flags.items()]
        return F.concat(*lists)

    def own():
        return F.array_compact(F.array(*[F.when(F.col(flag), F.col(col))
                                         for col, flag in flags.items()]))

    book = {short: Step(reads, gathered), single: Step(reads, own)}
    parts, at = [], first
    while at <= last:
        width = base if at + base - 1 <= last else 1
        name, step = _back(short if width == base else single, at)
        parts.append(name)
        book |= step
        at += width
    book[out] = Step(tuple(parts), lambda: F.flatten(F.array(*[
        F.coalesce(F.col(p), F.array().cast("array<double>")) for p in parts])))
    return book
