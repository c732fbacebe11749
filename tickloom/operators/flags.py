"""Conditions on the last bar of each symbol, in numpy: what the steps of ``conditions`` say, with the same
comparisons, over stacked symbols (``functions.stacks``). One row a symbol leaves a task."""

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.stacks import Stack, doubles, known, map_symbols
from ..schema import OHLCV
from .conditions import OPS, Condition
from .fields import KNOWN, Fields, exceeds, pct_change, ratio
from .levels import LOOKBACK, MIN_TOUCHES, PIVOT_K, TOLERANCE_PCT

#: Columns of a screen's context that conditions read.
CONTEXT = ("benchmark", "_breadth", "_breadth_high")


class Bars(Fields):
    """Fields with the rows on which conditions are asked, and the table they come from."""

    def __init__(self, stack: Stack, table: pa.Table):
        names = [c for c in table.column_names if c in OHLCV or c in KNOWN or c in CONTEXT]
        super().__init__(stack, {c: doubles(table, c) for c in names})
        self.table, self.asked = table, stack.rows[stack.last]
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.columns and name.startswith("ret_"):
            self.columns[name] = pct_change(self["close"], self.back("close", int(name.removeprefix("ret_"))))
        if name not in self.columns and name in GAUGES:
            x = self[GAUGES[name]]
            row = self.stack.latest(known(x))
            self.columns[name] = np.where(row >= 0, x[row], np.nan)
        return super().__getitem__(name)

    def on_asked(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.stack.rows), bool)
        out[self.asked] = flags
        return out

    def pivots(self, x: np.ndarray, pick) -> np.ndarray:
        """Bars that are the extreme of their own and the bars on each side."""
        s, span = self.stack, 2 * PIVOT_K + 1
        full = s.lead(s.count(known(x), span), PIVOT_K, 0) == span
        return full & (x == s.lead(s.extreme(x, span, pick), PIVOT_K))

    def pivot(self, which: str) -> np.ndarray:
        name = f"pivot_{which}"
        if name not in self.columns:
            self.columns[name] = self.pivots(self[which], np.fmax if which == "high" else np.fmin)
        return self.columns[name]

    def level(self, back: int) -> tuple[np.ndarray, np.ndarray]:
        """Support and resistance as they stood ``back`` bars before those asked for."""
        if back not in self.levels:
            high, low = self.pivot("high"), self.pivot("low")
            found = [self._nearest(row - back, high, low) if self.stack.at[row] >= back else (np.nan, np.nan)
                     for row in self.asked]
            self.levels[back] = tuple(np.array(found, float).reshape(-1, 2).T)
        return self.levels[back]

    def _nearest(self, row: int, high: np.ndarray, low: np.ndarray) -> tuple[float, float]:
        """See ``levels.fold_levels``."""
        frame = slice(max(row - (LOOKBACK - PIVOT_K), self.stack.first[row]), max(row - PIVOT_K + 1, self.stack.first[row]))
        prices = np.sort(np.concatenate([self["high"][frame][high[frame]], self["low"][frame][low[frame]]]))
        if len(prices) < MIN_TOUCHES:
            return np.nan, np.nan
        apart = ~(100 * (prices[1:] - prices[:-1]) / prices[:-1] <= TOLERANCE_PCT)
        starts = np.append(0, np.flatnonzero(apart) + 1)
        touches = np.diff(np.append(starts, len(prices)))
        total = np.add.reduceat(np.floor(prices * 1e6 + 0.5).astype(np.int64), starts)
        levels = (total / 1e6 / touches)[touches >= MIN_TOUCHES]
        close = self["close"][row]
        below, above = levels[levels <= close], levels[levels > close]
        return below.max(initial=-np.inf) if len(below) else np.nan, above.min(initial=np.inf) if len(above) else np.nan


GAUGES = {"pct_above_200dma": "_breadth", "pct_at_20d_high": "_breadth_high"}
Flags = Callable[[Bars, Condition], np.ndarray]


def any_in_last(f: Bars, flags: np.ndarray, n: int) -> np.ndarray:
    return f.stack.count(flags, n) > 0


def all_in_last(f: Bars, flags: np.ndarray, n: int, partial: bool = False) -> np.ndarray:
    return f.stack.count(flags, n) == (np.minimum(f.stack.at + 1, n) if partial else n)


def _compare(f: Bars, c: Condition) -> np.ndarray:
    a, op = f[c["left"]], c["op"]
    if not isinstance(c["right"], str):
        return OPS[op](a, float(c["right"]))
    b = f[c["right"]]
    held = {">": exceeds(a, b), "<": exceeds(b, a), ">=": ~exceeds(b, a), "<=": ~exceeds(a, b)}[op]
    return held & known(a) & known(b)


def _distance_pct(target: np.ndarray, ref: np.ndarray) -> np.ndarray:
    return ratio(np.abs(target - ref), ref) * 100


def _proximity(f: Bars, c: Condition) -> np.ndarray:
    return any_in_last(f, _distance_pct(f[c["target"]], f[c["ref"]]) <= c["tolerance_pct"], c["lookback"])


def _trend(f: Bars, c: Condition) -> np.ndarray:
    close, fast, slow, slope = f["close"], f["ema_50"], f["ema_200"], f["ema_50_slope"]
    if c["direction"] == "up":
        return (close > fast) & (fast > slow) & (slope > 0)
    return (close < fast) & (fast < slow) & (slope < 0)


def _support_at_ma(f: Bars, c: Condition) -> np.ndarray:
    ma, tol, n = f[c["ma"]], float(c["tolerance_pct"]), c["lookback"]
    touched = (_distance_pct(f["low"], ma) <= tol) | (f["low"] < ma)
    return (any_in_last(f, touched, n) & all_in_last(f, f["close"] >= ma * (1 - tol / 100), n, partial=True)
            & all_in_last(f, known(ma), n, partial=True) & (f["close"] > ma))


def _crossed(f: Bars, x: np.ndarray, level: float, direction: str, lookback: int) -> np.ndarray:
    before = f.stack.lag(x)
    hit = (before <= level) & (x > level) if direction == "above" else (before >= level) & (x < level)
    return any_in_last(f, hit, lookback)


def _cross(f: Bars, c: Condition) -> np.ndarray:
    return _crossed(f, f[c["fast"]] - f[c["slow"]], 0.0, c["direction"], c["lookback"])


def _threshold_cross(f: Bars, c: Condition) -> np.ndarray:
    return _crossed(f, f[c["field"]], float(c["level"]), c["direction"], c["lookback"])


def _within(f: Bars, c: Condition) -> np.ndarray:
    x = f[c["field"]]
    held = known(x)
    if c["min"] is not None:
        held = held & (x >= float(c["min"]))
    return held & (x <= float(c["max"])) if c["max"] is not None else held


def _change(f: Bars, c: Condition) -> np.ndarray:
    return OPS[c["op"]](pct_change(f[c["field"]], f.back(c["field"], c["window"])), float(c["value_pct"]))


def _near_support(f: Bars, c: Condition) -> np.ndarray:
    support, close = f.level(0)[0], f["close"][f.asked]
    return f.on_asked(100 * (close - support) / support <= float(c["tolerance_pct"]))


def _near_resistance(f: Bars, c: Condition) -> np.ndarray:
    resistance, close = f.level(0)[1], f["close"][f.asked]
    return f.on_asked(100 * (resistance - close) / close <= float(c["tolerance_pct"]))


def _breakout(f: Bars, c: Condition) -> np.ndarray:
    n = c["lookback"]
    then = np.where(f.index[f.asked] - n >= 30, f.level(n)[1], np.nan)
    return f.on_asked(f["close"][f.asked] > then * (1 + float(c["buffer_pct"]) / 100))


def _rel_strength(f: Bars, c: Condition) -> np.ndarray:
    moved = [ratio(f[x], f.back(x, c["window"])) for x in ("close", "benchmark")]
    return OPS[c["op"]](100 * (moved[0] - moved[1]), float(c["value_pct"]))


def _wicks(f: Bars) -> tuple[np.ndarray, ...]:
    o, h, lo, c = (f[x] for x in ("open", "high", "low", "close"))
    return h - lo, np.abs(c - o), np.fmin(o, c) - lo, h - np.fmax(o, c)


def _nr7(f: Bars) -> np.ndarray:
    span = f["high"] - f["low"]
    return span < f.stack.lag(f.stack.whole_extreme(span, 6, np.fmin))


def _hammer(f: Bars) -> np.ndarray:
    span, body, lower, upper = _wicks(f)
    return (span > 0) & (lower >= 2 * body) & (upper <= 0.3 * span)


def _shooting_star(f: Bars) -> np.ndarray:
    span, body, lower, upper = _wicks(f)
    return (span > 0) & (upper >= 2 * body) & (lower <= 0.3 * span)


def _two_bars(f: Bars) -> tuple[np.ndarray, ...]:
    return f["open"], f["close"], f["_prev_open"], f["_prev_close"]


def _bullish_engulfing(f: Bars) -> np.ndarray:
    o, c, po, pc_ = _two_bars(f)
    return (pc_ < po) & (c > o) & (o <= pc_) & (c >= po)


def _bearish_engulfing(f: Bars) -> np.ndarray:
    o, c, po, pc_ = _two_bars(f)
    return (pc_ > po) & (c < o) & (o >= pc_) & (c <= po)


PATTERNS: dict[str, Callable[[Bars], np.ndarray]] = {
    "inside_bar": lambda f: (f["high"] < f["_prev_high"]) & (f["low"] > f["_prev_low"]),
    "nr7": _nr7, "bullish_engulfing": _bullish_engulfing, "bearish_engulfing": _bearish_engulfing,
    "hammer": _hammer, "shooting_star": _shooting_star,
}


def _span_pct(f: Bars, n: int) -> np.ndarray:
    top, bottom = f.stack.whole_extreme(f["high"], n), f.stack.whole_extreme(f["low"], n, np.fmin)
    return np.where(bottom > 0, 100 * (top - bottom) / bottom, np.nan)


def _flat_base(f: Bars, c: Condition) -> np.ndarray:
    return ((_span_pct(f, c["bars"]) <= float(c["max_range_pct"]))
            & (f["pct_from_52w_high"] >= -float(c["max_from_52w_high_pct"])))


def _bb_squeeze(f: Bars, c: Condition) -> np.ndarray:
    width, rows, at = f["bb_width_pct"], f.asked, f.stack.at[f.asked]
    now = width[rows]
    below = np.zeros(len(rows), np.int64)
    for i in range(1, c["lookback"]):
        then = width[np.maximum(rows - i, 0)]
        below += (at >= i) & exceeds(now, then)
    n = f.stack.count(known(width), c["lookback"])[rows]
    return f.on_asked(known(now) & (n >= 60) & (below <= np.floor((n - 1) * float(c["percentile"]) / 100)))


def _gap(f: Bars, c: Condition) -> np.ndarray:
    moved, limit = pct_change(f["open"], f["_prev_close"]), float(c["min_gap_pct"])
    return any_in_last(f, moved >= limit if c["direction"] == "up" else moved <= -limit, c["lookback"])


def _sector(f: Bars, c: Condition) -> np.ndarray:
    return pc.is_in(f.table.column("industry").combine_chunks(), value_set=pa.array(c["names"])).to_numpy(zero_copy_only=False)


def _breadth(f: Bars, c: Condition) -> np.ndarray:
    x = f["pct_above_200dma"]
    return x >= 50 if c["direction"] == "positive" else x < 50


def _persistence(f: Bars, c: Condition) -> np.ndarray:
    return all_in_last(f, OPS[c["op"]](f[c["field"]], float(c["value"])), c["bars"])


def _divergence(f: Bars, c: Condition) -> np.ndarray:
    bullish = c["direction"] == "bullish"
    price, osc, stack = f["low" if bullish else "high"], f[c["oscillator"]], f.stack
    upto = stack.latest(f.pivot("low" if bullish else "high"))
    second = stack.lag(upto, PIVOT_K, -1)
    first = np.where(second >= 0, stack.lag(upto, 1, -1)[second], -1)
    found = (first >= 0) & (first >= stack.rows - (c["lookback"] - 1 - PIVOT_K)) & (second - first >= PIVOT_K)
    a, b = np.maximum(first, 0), np.maximum(second, 0)
    if bullish:
        return found & (price[b] < price[a]) & (osc[b] > osc[a])
    return found & (price[b] > price[a]) & (osc[b] < osc[a])


KINDS: dict[str, Flags] = {
    "compare": _compare, "proximity": _proximity, "trend": _trend, "support_at_ma": _support_at_ma, "cross": _cross,
    "volume_spike": lambda f, c: f["vol_ratio"] >= float(c["min_ratio"]), "within": _within, "change": _change,
    "near_support": _near_support, "near_resistance": _near_resistance, "breakout_resistance": _breakout,
    "rel_strength": _rel_strength, "candle": lambda f, c: any_in_last(f, PATTERNS[c["pattern"]](f), c["lookback"]),
    "tight_range": lambda f, c: _span_pct(f, c["bars"]) <= float(c["max_range_pct"]), "flat_base": _flat_base,
    "bb_squeeze": _bb_squeeze, "gap": _gap, "sector": _sector, "breadth": _breadth, "threshold_cross": _threshold_cross,
    "persistence": _persistence, "divergence": _divergence,
}


def can_tell(conditions: Iterable[Condition], values: Iterable[str]) -> bool:
    return all(c.kind in KINDS and not c.weekly for c in conditions) and all(
        v in KNOWN or v in OHLCV or v in GAUGES or v.startswith("ret_") for v in values)


def last_bars(df: DataFrame, conditions: Sequence[Condition], values: Sequence[str], min_bars: int = 0,
              dropped: Iterable[str] = ()) -> DataFrame:
    """The last bar of each symbol with ``bar_idx``, ``n_bars``, a flag per condition and ``values``; symbols
    with fewer than ``min_bars`` bars are left out. ``df``: bars with what conditions read beside them."""
    wanted = [v for v in dict.fromkeys(values) if v not in df.columns]

    def compute(table: pa.Table, stack: Stack):
        deep = stack.size >= min_bars
        if not deep.any():
            return table.slice(0, 0), {}
        f = Bars(stack, table)
        rows = f.asked[deep[f.asked]]
        made = {"bar_idx": stack.at, "n_bars": stack.size, **{v: f[v] for v in wanted},
                **{c.name: KINDS[c.kind](f, c) for c in conditions}}
        return table.take(pa.array(rows)), {n: x[rows] for n, x in made.items()}

    added = {"bar_idx": "int", "n_bars": "int", **dict.fromkeys(wanted, "double"),
             **dict.fromkeys([c.name for c in conditions], "boolean")}
    return map_symbols(df, compute, added, dropped)
