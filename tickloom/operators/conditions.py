"""The condition library.

A condition is a boolean column over every bar of the panel; a screen filters
it to the as-of row, a backtest uses all of them. Missing input makes a
condition false. ``Condition.steps`` yields the columns to add; ``needs`` names
what must be joined to the panel first (see ``screen.panel_for``).
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.steps import Step
from ..functions.ties import COLUMN_OPS, exceeds
from ..functions.windows import all_in_last, any_in_last, between, lag, rolling, trailing
from ..schema import DAILY_FIELDS, WEEKLY_FIELDS
from .indicators import pct_change
from .levels import divergence_steps, level_steps

OPS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}

# The step by which each numeric threshold is varied in a
# sensitivity grid.
SENSITIVITY_STEPS = {
    "tolerance_pct": 0.5,
    "min_ratio": 0.1,
    "value_pct": 2.0,
    "max_range_pct": 2.0,
    "buffer_pct": 0.5,
    "min_gap_pct": 0.5,
    "value": 5.0,
    "percentile": 5.0,
    "min": 2.0,
    "max": 2.0,
}


@dataclass(frozen=True)
class Condition:
    """``kind`` and arguments of one predicate."""

    kind: str
    args: tuple[tuple[str, object], ...]
    weekly: bool = False
    needs: frozenset[str] = field(default=frozenset(), compare=False)

    def __getitem__(self, key: str):
        return dict(self.args).get(key)

    @property
    def name(self) -> str:
        # equal arguments give equal names: 3 and 3.0 are the same threshold
        shown = [(k, float(v) if isinstance(v, (int, float)) else v) for k, v in self.args]
        words = [self.kind] + [f"{k}_{v}" for k, v in shown] + ["weekly"] * self.weekly
        text = "_".join(words).replace("-", "neg").replace(">", "gt").replace("<", "lt")
        return "c_" + re.sub(r"[^A-Za-z0-9]+", "_", text.replace("=", "e"))

    def with_arg(self, key: str, value) -> "Condition":
        args = {**dict(self.args), key: value}
        return BUILDERS[self.kind](**args, **({"timeframe": "weekly"} if self.weekly else {}))

    def thresholds(self) -> list[tuple[str, float]]:
        return [(k, float(v)) for k, v in self.args
                if k in SENSITIVITY_STEPS and isinstance(v, (int, float))]

    def steps(self) -> dict[str, Step]:
        return _STEPS[self.kind](self)


def _make(kind: str, *, needs=(), timeframe: str = "daily", **args) -> Condition:
    if timeframe not in ("daily", "weekly"):
        raise ValueError(f"timeframe {timeframe!r}")
    given = tuple((k, v) for k, v in args.items() if v is not None)
    return Condition(kind, given, timeframe == "weekly", frozenset(needs))


def _check_op(op: str) -> None:
    if op not in OPS:
        raise ValueError(f"operator {op!r}")


def _check_choice(value, *allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{value!r} is not one of {allowed}")


def _check_field(name, timeframe: str = "daily") -> None:
    known = WEEKLY_FIELDS if timeframe == "weekly" else DAILY_FIELDS
    if name not in known:
        raise ValueError(f"unknown {timeframe} field {name!r}")


def _check_bars(**values) -> None:
    for key, value in values.items():
        if int(value) != value or value < 1:
            raise ValueError(f"{key} must be a positive whole number, got {value!r}")


# ---------------------------------------------------------------- constructors
def compare(left, op, right, timeframe="daily") -> Condition:
    _check_op(op)
    _check_field(left, timeframe)
    if isinstance(right, str):
        _check_field(right, timeframe)
    return _make("compare", timeframe=timeframe, left=left, op=op, right=right)


def proximity(target, ref, tolerance_pct, lookback=3) -> Condition:
    _check_field(target), _check_field(ref), _check_bars(lookback=lookback)
    return _make("proximity", target=target, ref=ref, tolerance_pct=tolerance_pct,
                 lookback=lookback)


def trend(direction, timeframe="daily") -> Condition:
    _check_choice(direction, "up", "down")
    return _make("trend", timeframe=timeframe, direction=direction)


def support_at_ma(ma, tolerance_pct=1.5, lookback=3) -> Condition:
    _check_field(ma), _check_bars(lookback=lookback)
    return _make("support_at_ma", ma=ma, tolerance_pct=tolerance_pct, lookback=lookback)


def cross(fast, slow, direction, lookback=3, timeframe="daily") -> Condition:
    _check_choice(direction, "above", "below")
    _check_field(fast, timeframe), _check_field(slow, timeframe)
    _check_bars(lookback=lookback)
    return _make("cross", timeframe=timeframe, fast=fast, slow=slow, direction=direction,
                 lookback=lookback)


def volume_spike(min_ratio) -> Condition:
    return _make("volume_spike", min_ratio=min_ratio)


def within(field, min=None, max=None, timeframe="daily") -> Condition:
    _check_field(field, timeframe)
    if min is None and max is None:
        raise ValueError("give a minimum, a maximum or both")
    return _make("within", timeframe=timeframe, field=field, min=min, max=max)


def change(field, window, op, value_pct, timeframe="daily") -> Condition:
    _check_op(op), _check_field(field, timeframe), _check_bars(window=window)
    return _make("change", timeframe=timeframe, field=field, window=window, op=op,
                 value_pct=value_pct)


def near_support(tolerance_pct) -> Condition:
    return _make("near_support", tolerance_pct=tolerance_pct)


def near_resistance(tolerance_pct) -> Condition:
    return _make("near_resistance", tolerance_pct=tolerance_pct)


def breakout_resistance(lookback=5, buffer_pct=0.0) -> Condition:
    _check_bars(lookback=lookback)
    return _make("breakout_resistance", lookback=lookback, buffer_pct=buffer_pct)


def rel_strength(window, op, value_pct) -> Condition:
    _check_op(op), _check_bars(window=window)
    return _make("rel_strength", needs=["benchmark"], window=window, op=op,
                 value_pct=value_pct)


def candle(pattern, lookback=1) -> Condition:
    _check_choice(pattern, *PATTERNS), _check_bars(lookback=lookback)
    return _make("candle", pattern=pattern, lookback=lookback)


def tight_range(max_range_pct, bars=10) -> Condition:
    _check_bars(bars=bars)
    return _make("tight_range", max_range_pct=max_range_pct, bars=bars)


def bb_squeeze(percentile=20, lookback=252) -> Condition:
    _check_bars(lookback=lookback)
    return _make("bb_squeeze", percentile=percentile, lookback=lookback)


def flat_base(bars=20, max_range_pct=12, max_from_52w_high_pct=15) -> Condition:
    _check_bars(bars=bars)
    return _make("flat_base", bars=bars, max_range_pct=max_range_pct,
                 max_from_52w_high_pct=max_from_52w_high_pct)


def gap(direction, min_gap_pct=2.0, lookback=3) -> Condition:
    _check_choice(direction, "up", "down"), _check_bars(lookback=lookback)
    return _make("gap", direction=direction, min_gap_pct=min_gap_pct, lookback=lookback)


def sector(names) -> Condition:
    if not names:
        raise ValueError("name at least one sector")
    return _make("sector", needs=["universe"], names=tuple(names))


def rs_percentile(op, value, window=63, basis="return") -> Condition:
    _check_op(op), _check_choice(basis, "return", "mom_12_1"), _check_bars(window=window)
    rank = "mom_12_1" if basis == "mom_12_1" else f"ret_{window}"
    return _make("rs_percentile", needs=[f"rank:{rank}"], op=op, value=value, window=window,
                 basis=basis)


def atr_pct_percentile(op, value) -> Condition:
    _check_op(op)
    return _make("atr_pct_percentile", needs=["rank:atr_pct"], op=op, value=value)


def sector_rank(window=63, top=None, bottom=None) -> Condition:
    if (top is None) == (bottom is None):
        raise ValueError("give exactly one of top and bottom")
    _check_bars(window=window)
    return _make("sector_rank", needs=["universe", f"sector_rank:{window}"], window=window,
                 top=top, bottom=bottom)


def breadth(direction) -> Condition:
    _check_choice(direction, "positive", "negative")
    return _make("breadth", needs=["breadth"], direction=direction)


def threshold_cross(field, level, direction, lookback=3) -> Condition:
    _check_choice(direction, "above", "below")
    _check_field(field), _check_bars(lookback=lookback)
    return _make("threshold_cross", field=field, level=level, direction=direction,
                 lookback=lookback)


def persistence(field, op, value, bars) -> Condition:
    _check_op(op), _check_field(field), _check_bars(bars=bars)
    return _make("persistence", field=field, op=op, value=value, bars=bars)


def divergence(kind, oscillator="rsi", lookback=40) -> Condition:
    _check_choice(kind, "bullish", "bearish"), _check_choice(oscillator, "rsi", "stoch_k")
    _check_bars(lookback=lookback)
    return _make("divergence", direction=kind, oscillator=oscillator, lookback=lookback)


# ---------------------------------------------------------------- column steps
def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _operand(x) -> tuple[tuple[str, ...], Column]:
    return ((x,), F.col(x)) if isinstance(x, str) else ((), F.lit(float(x)))


def _compare_steps(c: Condition) -> dict[str, Step]:
    reads, _ = _operand(c["right"])
    ops = COLUMN_OPS if reads else OPS
    return {c.name: Step((c["left"], *reads), lambda: _true(
        ops[c["op"]](F.col(c["left"]), _operand(c["right"])[1])))}


def _hit_any(c: Condition, reads: tuple[str, ...], hit, lookback: int) -> dict[str, Step]:
    flag = f"_{c.name}_hit"
    return {flag: Step(reads, lambda: _true(hit())),
            c.name: Step((flag,), lambda: any_in_last(flag, lookback))}


def distance_pct(target: str, ref: str) -> Column:
    return F.abs(F.col(target) - F.col(ref)) / F.nullif(F.col(ref), F.lit(0.0)) * 100


def _proximity_steps(c: Condition) -> dict[str, Step]:
    return _hit_any(c, (c["target"], c["ref"]),
                    lambda: distance_pct(c["target"], c["ref"]) <= c["tolerance_pct"],
                    c["lookback"])


def _trend_steps(c: Condition) -> dict[str, Step]:
    fast, slow = ("ema_20", "ema_40") if c.weekly else ("ema_50", "ema_200")
    slope = f"{fast}_slope"

    def holds() -> Column:
        close, f, s, m = (F.col(x) for x in ("close", fast, slow, slope))
        return _true((close > f) & (f > s) & (m > 0) if c["direction"] == "up"
                     else (close < f) & (f < s) & (m < 0))

    return {c.name: Step(("close", fast, slow, slope), holds)}


def _support_at_ma_steps(c: Condition) -> dict[str, Step]:
    ma, tol, n = c["ma"], float(c["tolerance_pct"]), c["lookback"]
    touched, held, known = (f"_{c.name}_{x}" for x in ("touched", "held", "known"))

    def holds() -> Column:
        return (any_in_last(touched, n) & all_in_last(held, n, partial=True)
                & all_in_last(known, n, partial=True)
                & _true(F.col("close") > F.col(ma)))

    return {
        touched: Step((ma, "low"), lambda: _true(
            (distance_pct("low", ma) <= tol) | (F.col("low") < F.col(ma)))),
        held: Step((ma, "close"),
                   lambda: _true(F.col("close") >= F.col(ma) * (1 - tol / 100))),
        known: Step((ma,), lambda: F.col(ma).isNotNull()),
        c.name: Step((touched, held, known, "close", ma), holds),
    }


def _cross_steps(c: Condition) -> dict[str, Step]:
    diff, before = f"_diff_{c['fast']}_{c['slow']}", f"_diff_{c['fast']}_{c['slow']}_before"

    def hit() -> Column:
        if c["direction"] == "above":
            return (F.col(before) <= 0) & (F.col(diff) > 0)
        return (F.col(before) >= 0) & (F.col(diff) < 0)

    return {
        diff: Step((c["fast"], c["slow"]), lambda: F.col(c["fast"]) - F.col(c["slow"])),
        before: Step((diff,), lambda: lag(diff)),
        **_hit_any(c, (diff, before), hit, c["lookback"]),
    }


def _volume_spike_steps(c: Condition) -> dict[str, Step]:
    return {c.name: Step(("vol_ratio",),
                         lambda: _true(F.col("vol_ratio") >= float(c["min_ratio"])))}


def _within_steps(c: Condition) -> dict[str, Step]:
    def holds() -> Column:
        x = F.col(c["field"])
        ok = x.isNotNull()
        if c["min"] is not None:
            ok = ok & (x >= float(c["min"]))
        if c["max"] is not None:
            ok = ok & (x <= float(c["max"]))
        return _true(ok)

    return {c.name: Step((c["field"],), holds)}


def _change_steps(c: Condition) -> dict[str, Step]:
    moved = f"_change_{c['field']}_{c['window']}"
    return {
        moved: Step((c["field"],), lambda: pct_change(
            F.col(c["field"]), lag(c["field"], c["window"]))),
        c.name: Step((moved,), lambda: _true(OPS[c["op"]](F.col(moved), float(c["value_pct"])))),
    }


def _near_support_steps(c: Condition) -> dict[str, Step]:
    return {**level_steps(), c.name: Step(("close", "support"), lambda: _true(
        100 * (F.col("close") - F.col("support")) / F.col("support")
        <= float(c["tolerance_pct"])))}


def _near_resistance_steps(c: Condition) -> dict[str, Step]:
    return {**level_steps(), c.name: Step(("close", "resistance"), lambda: _true(
        100 * (F.col("resistance") - F.col("close")) / F.col("close")
        <= float(c["tolerance_pct"])))}


def _breakout_steps(c: Condition) -> dict[str, Step]:
    n, then = c["lookback"], f"_resistance_{c['lookback']}_ago"
    return {
        **level_steps(),
        # a level needs 30 bars of history at the bar it is read from
        then: Step(("resistance",), lambda: F.when(
            F.col("bar_idx") - n >= 30, lag("resistance", n))),
        c.name: Step((then, "close"), lambda: _true(
            F.col("close") > F.col(then) * (1 + float(c["buffer_pct"]) / 100))),
    }


def _rel_strength_steps(c: Condition) -> dict[str, Step]:
    n, excess = c["window"], f"_rel_strength_{c['window']}"

    def ratio(col: str) -> Column:
        return F.col(col) / F.nullif(lag(col, n), F.lit(0.0))

    return {
        excess: Step(("close", "benchmark"),
                     lambda: 100 * (ratio("close") - ratio("benchmark"))),
        c.name: Step((excess,), lambda: _true(OPS[c["op"]](F.col(excess), float(c["value_pct"])))),
    }


def _prev(col: str) -> Column:
    return F.col(f"_prev_{col}")


def _inside_bar() -> Column:
    return (F.col("high") < _prev("high")) & (F.col("low") > _prev("low"))


def _nr7() -> Column:
    return F.col("_bar_range") < F.col("_range_min_before")


def _bullish_engulfing() -> Column:
    o, c, po, pc = F.col("open"), F.col("close"), _prev("open"), _prev("close")
    return (pc < po) & (c > o) & (o <= pc) & (c >= po)


def _bearish_engulfing() -> Column:
    o, c, po, pc = F.col("open"), F.col("close"), _prev("open"), _prev("close")
    return (pc > po) & (c < o) & (o >= pc) & (c <= po)


def _wicks() -> tuple[Column, Column, Column, Column]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return h - lo, F.abs(c - o), F.least(o, c) - lo, h - F.greatest(o, c)


def _hammer() -> Column:
    span, body, lower, upper = _wicks()
    return (span > 0) & (lower >= 2 * body) & (upper <= 0.3 * span)


def _shooting_star() -> Column:
    span, body, lower, upper = _wicks()
    return (span > 0) & (upper >= 2 * body) & (lower <= 0.3 * span)


_TWO_BARS = ("open", "close", "_prev_open", "_prev_close")
PATTERNS = {
    "inside_bar": (("high", "low", "_prev_high", "_prev_low"), _inside_bar),
    "nr7": (("_bar_range", "_range_min_before"), _nr7),
    "bullish_engulfing": (_TWO_BARS, _bullish_engulfing),
    "bearish_engulfing": (_TWO_BARS, _bearish_engulfing),
    "hammer": (("open", "high", "low", "close"), _hammer),
    "shooting_star": (("open", "high", "low", "close"), _shooting_star),
}


def _range_min_before() -> Column:
    six = between(-6, -1)
    return F.when(F.count("_bar_range").over(six) == 6, F.min("_bar_range").over(six))


def _candle_steps(c: Condition) -> dict[str, Step]:
    reads, pattern = PATTERNS[c["pattern"]]
    return {
        "_bar_range": Step(("high", "low"), lambda: F.col("high") - F.col("low")),
        "_range_min_before": Step(("_bar_range",), _range_min_before),
        **_hit_any(c, reads, pattern, c["lookback"]),
    }


def _span_step(n: int) -> Step:
    def span() -> Column:
        top, bottom = rolling(F.max, "high", n), rolling(F.min, "low", n)
        return F.when(bottom > 0, 100 * (top - bottom) / bottom)

    return Step(("high", "low"), span)


def _tight_range_steps(c: Condition) -> dict[str, Step]:
    span = f"_span_pct_{c['bars']}"
    return {span: _span_step(c["bars"]), c.name: Step((span,), lambda: _true(
        F.col(span) <= float(c["max_range_pct"])))}


def _flat_base_steps(c: Condition) -> dict[str, Step]:
    span = f"_span_pct_{c['bars']}"
    return {span: _span_step(c["bars"]), c.name: Step((span, "pct_from_52w_high"), lambda: _true(
        (F.col(span) <= float(c["max_range_pct"]))
        & (F.col("pct_from_52w_high") >= -float(c["max_from_52w_high_pct"]))))}


def width_below_steps(lookback: int) -> dict[str, Step]:
    """Number of band widths in the window, and how many lie below today's."""
    n, below, past = (f"_width_{x}_{lookback}" for x in ("n", "below", "past"))
    return {
        past: Step(("bb_width_pct",),
                   lambda: F.collect_list("bb_width_pct").over(trailing(lookback))),
        n: Step((past,), lambda: F.size(past)),
        below: Step((past, "bb_width_pct"), lambda: F.when(
            F.col("bb_width_pct").isNotNull(),
            F.size(F.filter(past, lambda x: exceeds(F.col("bb_width_pct"), x))))),
    }


def _bb_squeeze_steps(c: Condition) -> dict[str, Step]:
    """Today's width is at or below the linearly interpolated percentile of its
    window exactly when no more than floor((n-1) p) widths lie below it, since
    today's own width is one of the window's."""
    n, below = (f"_width_{x}_{c['lookback']}" for x in ("n", "below"))
    return {**width_below_steps(c["lookback"]), c.name: Step((n, below), lambda: _true(
        (F.col(n) >= 60)
        & (F.col(below) <= F.floor((F.col(n) - 1) * float(c["percentile"]) / 100))))}


def _gap_steps(c: Condition) -> dict[str, Step]:
    limit = float(c["min_gap_pct"])

    def hit() -> Column:
        return (F.col("_gap_pct") >= limit if c["direction"] == "up"
                else F.col("_gap_pct") <= -limit)

    return {"_gap_pct": Step(("open", "_prev_close"),
                             lambda: pct_change(F.col("open"), F.col("_prev_close"))),
            **_hit_any(c, ("_gap_pct",), hit, c["lookback"])}


def _sector_steps(c: Condition) -> dict[str, Step]:
    return {c.name: Step(("industry",), lambda: _true(F.col("industry").isin(*c["names"])))}


def _rs_percentile_steps(c: Condition) -> dict[str, Step]:
    rank = "mom_12_1" if c["basis"] == "mom_12_1" else f"ret_{c['window']}"
    return {c.name: Step((f"{rank}_pctl",), lambda: _true(
        OPS[c["op"]](F.col(f"{rank}_pctl"), float(c["value"]))))}


def _atr_percentile_steps(c: Condition) -> dict[str, Step]:
    return {c.name: Step(("atr_pct_pctl",), lambda: _true(
        OPS[c["op"]](F.col("atr_pct_pctl"), float(c["value"]))))}


def _sector_rank_steps(c: Condition) -> dict[str, Step]:
    rank, n = f"sector_rank_{c['window']}", f"n_sectors_{c['window']}"

    def holds() -> Column:
        if c["top"] is not None:
            return _true(F.col(rank) <= c["top"])
        return _true(F.col(rank) > F.col(n) - c["bottom"])

    return {c.name: Step((rank, n), holds)}


def _breadth_steps(c: Condition) -> dict[str, Step]:
    def holds() -> Column:
        x = F.col("pct_above_200dma")
        return _true(x >= 50 if c["direction"] == "positive" else x < 50)

    return {c.name: Step(("pct_above_200dma",), holds)}


def _threshold_cross_steps(c: Condition) -> dict[str, Step]:
    x, level, before = c["field"], float(c["level"]), f"_before_{c['field']}"

    def hit() -> Column:
        if c["direction"] == "above":
            return (F.col(before) <= level) & (F.col(x) > level)
        return (F.col(before) >= level) & (F.col(x) < level)

    return {before: Step((x,), lambda: lag(x)),
            **_hit_any(c, (x, before), hit, c["lookback"])}


def _persistence_steps(c: Condition) -> dict[str, Step]:
    flag = f"_{c.name}_ok"
    return {
        flag: Step((c["field"],), lambda: _true(OPS[c["op"]](F.col(c["field"]), float(c["value"])))),
        c.name: Step((flag,), lambda: all_in_last(flag, c["bars"])),
    }


def _divergence_steps(c: Condition) -> dict[str, Step]:
    return divergence_steps(c.name, c["direction"], c["oscillator"], c["lookback"])


_STEPS = {
    "compare": _compare_steps,
    "proximity": _proximity_steps,
    "trend": _trend_steps,
    "support_at_ma": _support_at_ma_steps,
    "cross": _cross_steps,
    "volume_spike": _volume_spike_steps,
    "within": _within_steps,
    "change": _change_steps,
    "near_support": _near_support_steps,
    "near_resistance": _near_resistance_steps,
    "breakout_resistance": _breakout_steps,
    "rel_strength": _rel_strength_steps,
    "candle": _candle_steps,
    "tight_range": _tight_range_steps,
    "bb_squeeze": _bb_squeeze_steps,
    "flat_base": _flat_base_steps,
    "gap": _gap_steps,
    "sector": _sector_steps,
    "rs_percentile": _rs_percentile_steps,
    "atr_pct_percentile": _atr_percentile_steps,
    "sector_rank": _sector_rank_steps,
    "breadth": _breadth_steps,
    "threshold_cross": _threshold_cross_steps,
    "persistence": _persistence_steps,
    "divergence": _divergence_steps,
}


def _divergence_again(direction, oscillator, lookback) -> Condition:
    return divergence(direction, oscillator, lookback)


BUILDERS = {
    "compare": compare, "proximity": proximity, "trend": trend,
    "support_at_ma": support_at_ma, "cross": cross, "volume_spike": volume_spike,
    "within": within, "change": change, "near_support": near_support,
    "near_resistance": near_resistance, "breakout_resistance": breakout_resistance,
    "rel_strength": rel_strength, "candle": candle, "tight_range": tight_range,
    "bb_squeeze": bb_squeeze, "flat_base": flat_base, "gap": gap, "sector": sector,
    "rs_percentile": rs_percentile, "atr_pct_percentile": atr_pct_percentile,
    "sector_rank": sector_rank, "breadth": breadth, "threshold_cross": threshold_cross,
    "persistence": persistence, "divergence": _divergence_again,
}
