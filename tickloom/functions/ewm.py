"""Exponential smoothing as plain window sums.

``y[t] = (b^g y[s] + a x[t]) / (b^g + a)`` with ``b = 1 - a``, where ``s`` is the last bar
before ``t`` with an input and ``g = t - s``; without gaps that is ``b y[t-1] + a x[t]``.
It starts at the first input, stays as it is on bars without one, and is null until
``min_periods`` inputs were seen.

Each input i has a share ``d[i]``: 1 for the first, else ``a / (b^g + a)``. What went before
it keeps ``b^g exp(e[i])`` with ``e[i] = -log(b^g + a)``, which is 0 where ``g`` is 1. So::

    y[t] = sum(d[i] x[i] b^(s-i) exp(E[s] - E[i]))          E = running sum of e

The sum is taken inside blocks of ``BLOCK`` bars with exponents centred on the block, so
powers stay inside the double range as long as a <= 0.25. Results of closed blocks, one
per ``BLOCK`` bars, are folded in order and carried over.

A larger a forgets so fast that the bars of a short window decide all digits of a double:
there the steps of that window's bars are joined, four at a time.

A smoothing may go on from where an earlier one stopped: a column ``_seed`` holds, per symbol,
the bar ``pos`` and what was known there of each smoothing (``y_<out>``) and each input
(``at_<x>``, the last bar with one, and ``seen_<x>``). Inputs up to ``pos`` are then left out.
"""

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .steps import Step
from .windows import BLOCK, history, lag, note_reach, so_far

MAX_ALPHA = 0.25
# the windows of ``functions.windows`` in SQL
IN_BLOCK = "over (partition by symbol, _blk order by date rows between unbounded preceding and current row)"
SO_FAR = "over (partition by symbol order by _blk, date rows between unbounded preceding and current row)"
EARLIER = "over (partition by symbol order by _blk, date rows between unbounded preceding and 1 preceding)"


def span_alpha(n: int) -> float:
    return 2.0 / (n + 1)


def wilder_alpha(n: int) -> float:
    return 1.0 / n


def _short_memory_steps(out: str, x: str, alpha: float, min_periods: int) -> dict[str, Step]:
    """A bar ``k`` back weighs b^k at most, which is nothing from ``k`` on.

    A bar is a map y -> keep y + add (the identity without an input). The maps of one bar, then of
    4, 16, ... bars are put together by look-ups, until they reach over ``k`` bars."""
    b = 1.0 - alpha
    k = 1 if b == 0 else min(BLOCK, math.ceil(60 * math.log(2) / -math.log(b)))
    prev, raw = f"_{x}_prev", f"_{out}_at_inputs"

    def bar(plain: float, other: str, first: float, idle: float) -> Callable[[], Column]:
        gap = f"(bar_idx - `{prev}`)"
        left = f"power({b!r}D, {gap})"
        return lambda: F.expr(
            f"case when `{x}` is null then {idle!r}D when `{prev}` is null then {first!r}D when {gap} = 1 then {plain!r}D "
            f"else {other.format(left=left)} / ({left} + {alpha!r}D) end")

    def before(name: str, bars: int, nothing: float) -> Column:
        return F.coalesce(lag(name, bars), F.lit(nothing))

    def joined(keep: str, add: str, width: int, times: int) -> tuple[Callable[[], Column], Callable[[], Column]]:
        def keeps() -> Column:
            return reduce(lambda total, i: total * before(keep, i * width, 1.0), range(1, times), F.col(keep))

        def adds() -> Column:
            total = before(add, (times - 1) * width, 0.0)
            for i in range(times - 2, -1, -1):
                kept, added = (F.col(keep), F.col(add)) if i == 0 else (
                    before(keep, i * width, 1.0), before(add, i * width, 0.0))
                total = added + kept * total
            return total
        return keeps, adds

    keep, add, share = f"_{out}_keep1", f"_{out}_add1", f"_{out}_share"
    book = {
        prev: Step((x,), lambda: F.last(F.when(F.col(x).isNotNull(), F.col("bar_idx")), ignorenulls=True).over(
            history().rowsBetween(Window.unboundedPreceding, -1))),
        share: Step((x, prev), bar(alpha, f"{alpha!r}D", 1.0, 0.0)),
        keep: Step((x, prev), bar(b, "{left}", 0.0, 1.0)),
        add: Step((x, share), lambda: F.when(F.col(x).isNull(), F.lit(0.0)).otherwise(F.col(share) * F.col(x))),
    }
    width = 1
    while width <= k:
        times = min(4, -(-(k + 1) // width))
        wide = width * times
        keeps, adds = joined(keep, add, width, times)
        book[f"_{out}_keep{wide}"] = Step((keep,), keeps)
        book[f"_{out}_add{wide}"] = Step((keep, add), adds)
        keep, add, width = f"_{out}_keep{wide}", f"_{out}_add{wide}", wide
    return book | {
        f"_{x}_seen": Step((x,), lambda: F.count(x).over(so_far())),
        raw: Step((x, add), lambda: F.when(F.col(x).isNotNull(), F.col(add))),
        out: Step((raw, f"_{x}_seen"), lambda: F.when(
            F.col(f"_{x}_seen") >= min_periods, F.last(raw, ignorenulls=True).over(so_far()))),
    }


def ewm_steps(out: str, x: str, alpha: float, min_periods: int, seeded: bool = False) -> dict[str, Step]:
    """Steps that add ``out``, the smoothing of column ``x``. ``seeded``: it goes on from the
    column ``_seed``; further columns ``_<out>_y`` and ``_<x>_at`` are what a seed needs."""
    if not 0 < alpha <= 1:
        raise ValueError(f"smoothing factor {alpha} outside (0, 1]")
    if alpha > MAX_ALPHA + 1e-12:
        if seeded:
            raise ValueError(f"smoothing factor {alpha} needs no seed")
        return _short_memory_steps(out, x, alpha, min_periods)
    b, log_b = (f"{v!r}D" for v in (1.0 - alpha, math.log(1.0 - alpha)))
    a = f"{alpha!r}D"
    given = f"_{x}_given" if seeded else x  # the inputs that count
    local, carry, excess = (f"`_{out}_{what}`" for what in ("local", "carry", "excess"))
    prev, first_here = f"`_{x}_prev`", f"`_{x}_from`"

    # where the last input is: before this bar, or of this bar or before
    before = f"coalesce({prev}, _seed.`at_{x}`)" if seeded else prev
    at = f"if(`{given}` is not null, bar_idx, {before})"
    middle = f"(_blk * {BLOCK} + {BLOCK // 2})"

    def whole(text: str) -> Callable[[], Column]:
        """A column whose windows look at all bars before it, written as SQL: a smoothing has
        hundreds of operations, and each would be a call to the JVM."""
        def build() -> Column:
            note_reach(None)
            return F.expr(text)
        return build

    def excess_of(gap: str) -> str:
        return f"if({gap} > 1, -ln(power({b}, {gap}) + {a}), 0D)"

    def power(steps: str, sign: int) -> str:
        """b^(sign steps) exp(sign E), plain where E is 0."""
        return f"if({excess} = 0, power({b}, {sign} * ({steps})), exp({sign} * (({steps}) * {log_b} + {excess})))"

    def onto(y: str, stands: str, local: str, at: str, first: str, e: str) -> str:
        """A block's result with what came before it, which stands at ``stands``."""
        return f"{local} + {y} * exp(({at} - {stands}) * {log_b} + {e} + {excess_of(f'({first} - {stands})')})"

    gap = f"(bar_idx - {before})"
    share = f"case when {gap} is null then 1D when {gap} = 1 then {a} else {a} / (power({b}, {gap}) + {a}) end"
    inner = f"if(`{given}` is not null and {prev} >= _blk * {BLOCK}, {excess_of(f'(bar_idx - {prev})')}, null)"
    total = f"sum(`{given}` * ({share}) * {power(f'bar_idx - {middle}', -1)}) {IN_BLOCK}"
    closed = (f"if(bar_idx % {BLOCK} = {BLOCK - 1} and {local} is not null, named_struct('y', {local}, 'at', {at}, "
              f"'first', {first_here}, 'e', {excess}), null)")

    start, later, nothing = f"named_struct('y', get({carry}, 0).y, 'at', get({carry}, 0).at)", f"slice({carry}, 2, {BLOCK})", \
        f"size({carry}) = 0"
    if seeded:
        told = f"_seed.`y_{out}` is not null"
        start = f"if({told}, named_struct('y', _seed.`y_{out}`, 'at', _seed.`at_{x}`), {start})"
        later, nothing = f"if({told}, {carry}, {later})", f"({nothing} and not {told})"
    past = (f"aggregate({later}, {start}, (acc, k) -> named_struct('y', "
            f"{onto('acc.y', 'acc.at', 'k.y', 'k.at', 'k.first', 'k.e')}, 'at', k.at))")
    joined = (f"transform(array({past}), p -> if({local} is null, p.y, "
              f"{onto('p.y', 'p.at', local, at, first_here, excess)}))[0]")
    value = f"if({nothing}, {local}, {joined})"
    seen = f"count(`{given}`) {SO_FAR}" + (f" + coalesce(_seed.`seen_{x}`, 0)" if seeded else "")

    # with a seed no bar before it counts
    bars = 0 if seeded else None
    inputs = (given, f"_{x}_prev", *(["_seed"] if seeded else []))
    book = {
        f"_{x}_seen": Step((given, *inputs[2:]), whole(seen), bars),
        f"_{x}_prev": Step((given,), whole(f"last(if(`{given}` is not null, bar_idx, null), true) {EARLIER}"), bars),
        f"_{x}_from": Step((given,), whole(f"min(if(`{given}` is not null, bar_idx, null)) {IN_BLOCK}"), bars),
        f"_{out}_excess": Step(inputs, whole(f"coalesce(sum({inner}) {IN_BLOCK}, 0D)"), bars),
        f"_{out}_local": Step((*inputs, f"_{out}_excess"), whole(f"{total} * {power(f'{at} - {middle}', 1)}"), bars),
        f"_{out}_carry": Step((*inputs, f"_{out}_local", f"_{out}_excess", f"_{x}_from"),
                              whole(f"collect_list({closed}) {EARLIER}"), bars),
    }
    reads = (*inputs, f"_{out}_local", f"_{out}_carry", f"_{out}_excess", f"_{x}_from")
    enough = f"`_{x}_seen` >= {min_periods}"
    if not seeded:
        return book | {out: Step((*reads, f"_{x}_seen"), whole(f"if({enough}, {value}, null)"))}
    return book | {
        given: Step((x, "_seed"), lambda: F.expr(f"if(_seed is null or bar_idx > _seed.pos, `{x}`, null)")),
        f"_{x}_at": Step(inputs, lambda: F.expr(at)),
        f"_{out}_y": Step(reads, whole(value), 0),
        out: Step((f"_{out}_y", f"_{x}_seen"), lambda: F.expr(f"if({enough}, `_{out}_y`, null)")),
    }
