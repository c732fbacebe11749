"""The fields of the daily panel in numpy: each column of ``indicators.daily_book``, with the same
arithmetic in the same order, over stacked symbols (``functions.stacks``)."""

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ewm import span_alpha, wilder_alpha
from ..functions.stacks import Smoothing, Stack, doubles, known, map_symbols
from ..functions.ties import RELATIVE
from ..schema import EMA_PERIODS, OHLCV, ROC_PERIODS, SMA_PERIODS

#: Smoothings: input, factor and the number of inputs before the first value.
SMOOTHINGS: dict[str, tuple[str, float, int]] = {
    **{f"ema_{n}": ("close", span_alpha(n), n) for n in EMA_PERIODS},
    "_ema_12": ("close", span_alpha(12), 12), "_ema_26": ("close", span_alpha(26), 26),
    **{out: (x, wilder_alpha(14), 14) for out, x in (
        ("_avg_gain", "_gain"), ("_avg_loss", "_loss"), ("atr", "_true_range"),
        ("_plus_dm_avg", "_plus_dm"), ("_minus_dm_avg", "_minus_dm"), ("adx", "_dx"))},
    "macd_signal": ("macd", span_alpha(9), 9),
}


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Missing for a zero divisor."""
    return a / np.where(b == 0, np.nan, b)


def pct_change(now: np.ndarray, base: np.ndarray) -> np.ndarray:
    return 100 * (ratio(now, base) - 1)


def exceeds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """See ``functions.ties``."""
    return a - b > np.abs(b) * RELATIVE


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(known(a - b) & ~exceeds(a, b) & ~exceeds(b, a), 0.0, a - b)


class Fields:
    """Columns by name, each computed when it is asked for and kept until the rows are done.
    ``index``: a bar's position in the whole history, of which the rows may be a part; ``seeds``:
    what smoothings knew there (``y_``, ``at_``, ``seen_`` and ``pos``)."""

    def __init__(self, stack: Stack, columns: dict[str, np.ndarray], index: np.ndarray | None = None,
                 seeds: dict[str, np.ndarray] | None = None):
        self.stack, self.columns, self.seeds = stack, dict(columns), seeds
        self.index = stack.at if index is None else index
        self.smoothings: dict[str, Smoothing] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.columns:
            self.columns[name] = (self.smoothing(name).after(SMOOTHINGS[name][2]) if name in SMOOTHINGS
                                  else RULES[name](self))
        return self.columns[name]

    def smoothing(self, out: str) -> Smoothing:
        if out not in self.smoothings:
            x, alpha, _ = SMOOTHINGS[out]
            s = self.seeds
            seed = None if s is None else {"pos": s["pos"], "y": s[f"y_{out}"], "at": s[f"at_{x}"], "seen": s[f"seen_{x}"]}
            self.smoothings[out] = Smoothing(self.stack, self[x], alpha, self.index, seed)
        return self.smoothings[out]

    def back(self, name: str, n: int) -> np.ndarray:
        return self.stack.lag(self[name], n)


Rule = Callable[[Fields], np.ndarray]


def _slope(name: str) -> Rule:
    return lambda f: f[name] - f.back(name, 5)


def _mean_slope(name: str) -> Rule:
    return lambda f: difference(f[name], f.back(name, 5))


def _sma(n: int) -> Rule:
    return lambda f: f.stack.long_mean(f["close"], n)


def _roc(n: int) -> Rule:
    return lambda f: pct_change(f["close"], f.back("close", n))


def _moved(f: Fields, mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.where((mine > other) & (mine > 0), mine, 0.0)


def _up(f: Fields) -> np.ndarray:
    return f["high"] - f["_prev_high"]


def _down(f: Fields) -> np.ndarray:
    return f["_prev_low"] - f["low"]


def _true_range(f: Fields) -> np.ndarray:
    return np.fmax(np.fmax(f["high"] - f["low"], np.abs(f["high"] - f["_prev_close"])), np.abs(f["low"] - f["_prev_close"]))


def _raw_k(f: Fields) -> np.ndarray:
    top, bottom = f.stack.whole_extreme(f["high"], 14), f.stack.whole_extreme(f["low"], 14, np.fmin)
    return ratio(100 * (f["close"] - bottom), top - bottom)


def _yearly(name: str, pick) -> Rule:
    return lambda f: np.where(f.stack.count(known(f[name]), 252) >= 60, f.stack.extreme(f[name], 252, pick), np.nan)


RULES: dict[str, Rule] = {
    **{f"_prev_{x}": (lambda f, x=x: f.back(x, 1)) for x in ("open", "high", "low", "close")},
    **{f"ema_{n}_slope": _slope(f"ema_{n}") for n in EMA_PERIODS},
    **{f"sma_{n}": _sma(n) for n in SMA_PERIODS},
    **{f"sma_{n}_slope": _mean_slope(f"sma_{n}") for n in SMA_PERIODS},
    **{f"roc_{n}": _roc(n) for n in ROC_PERIODS},
    "_gain": lambda f: np.maximum(f["close"] - f["_prev_close"], 0.0),
    "_loss": lambda f: np.maximum(-(f["close"] - f["_prev_close"]), 0.0),
    "rsi": lambda f: 100 - 100 / (1 + ratio(f["_avg_gain"], f["_avg_loss"])),
    "_true_range": _true_range,
    "atr_pct": lambda f: ratio(100 * f["atr"], f["close"]),
    "_plus_dm": lambda f: _moved(f, _up(f), _down(f)),
    "_minus_dm": lambda f: _moved(f, _down(f), _up(f)),
    "plus_di": lambda f: ratio(100 * f["_plus_dm_avg"], f["atr"]),
    "minus_di": lambda f: ratio(100 * f["_minus_dm_avg"], f["atr"]),
    "_dx": lambda f: ratio(100 * np.abs(f["plus_di"] - f["minus_di"]), f["plus_di"] + f["minus_di"]),
    "adx_slope": _slope("adx"),
    "_raw_k": _raw_k,
    "stoch_k": lambda f: f.stack.mean(f["_raw_k"], 3),
    "stoch_d": lambda f: f.stack.mean(f["stoch_k"], 3),
    "macd": lambda f: f["_ema_12"] - f["_ema_26"],
    "macd_hist": lambda f: f["macd"] - f["macd_signal"],
    "_band_sd": lambda f: f.stack.deviation(f["close"], 20),
    "bb_upper": lambda f: f["sma_20"] + 2.0 * f["_band_sd"],
    "bb_lower": lambda f: f["sma_20"] - 2.0 * f["_band_sd"],
    "bb_width_pct": lambda f: ratio(100 * (f["bb_upper"] - f["bb_lower"]), f["sma_20"]),
    "vol_avg_20": lambda f: f.stack.mean(f["volume"], 20),
    "vol_ratio": lambda f: ratio(f["volume"], f["vol_avg_20"]),
    "turnover_cr": lambda f: f["close"] * f["volume"] / 1e7,
    "median_turnover": lambda f: f.stack.median(f["turnover_cr"], 20),
    "high_52w": _yearly("high", np.fmax),
    "low_52w": _yearly("low", np.fmin),
    "pct_from_52w_high": lambda f: pct_change(f["close"], f["high_52w"]),
    "pct_from_52w_low": lambda f: pct_change(f["close"], f["low_52w"]),
    "mom_12_1": lambda f: pct_change(f.back("close", 21), f.back("close", 252)),
}

#: What can be computed here.
KNOWN = frozenset(RULES) | frozenset(SMOOTHINGS)


#: The state of all smoothings at a bar: a seed's field -> the column that tells it.
STATES = {**{f"y_{out}": f"_{out}_y" for out in SMOOTHINGS},
          **{f"{kind}_{x}": f"_{x}_{kind}" for x in dict.fromkeys(x for x, _, _ in SMOOTHINGS.values()) for kind in ("at", "seen")}}


def _state(f: Fields, name: str) -> np.ndarray:
    kind, _, what = name.partition("_")
    if kind == "y":
        return f.smoothing(what).y
    out = next(out for out, (x, _, _) in SMOOTHINGS.items() if x == what)
    return f.smoothing(out).at if kind == "at" else f.smoothing(out).seen


def _inputs(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: doubles(table, c) for c in table.column_names if c in OHLCV or c in KNOWN}


def with_fields(bars: DataFrame, fields: Iterable[str], min_bars: int = 0) -> DataFrame:
    """Bars with ``bar_idx``, ``n_bars`` and ``fields``, by symbol and date; symbols with fewer than
    ``min_bars`` bars are dropped."""
    bars = bars.drop("bar_idx", "n_bars")
    wanted = [f for f in dict.fromkeys(fields) if f not in bars.columns]

    def compute(table: pa.Table, stack: Stack):
        deep = stack.size >= min_bars
        if not deep.any():
            return table.slice(0, 0), {}
        if not deep.all():
            table, stack = table.filter(pa.array(deep)), stack.part(deep)
        f = Fields(stack, _inputs(table))
        return table, {"bar_idx": stack.at, "n_bars": stack.size, **{n: f[n] for n in wanted}}

    return map_symbols(bars, compute, {"bar_idx": "int", "n_bars": "int", **dict.fromkeys(wanted, "double")})


def with_states(bars: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Bars with ``bar_idx``, ``fields``, the columns of ``STATES`` and ``_closes``, which marks the last bar of
    a symbol's month. A column ``_seed`` tells what was known at a bar ``pos`` before: the symbol's rows begin
    there, and its smoothings go on from that."""
    wanted, seed = list(dict.fromkeys(f for f in fields if f not in bars.columns)), {}
    if "_seed" in bars.columns:
        seed = {n: f"_seed_{n}" for n in ("pos", *STATES)}
        bars = bars.select(*[c for c in bars.columns if c != "_seed"],
                           *[F.col(f"_seed.{n}").alias(c) for n, c in seed.items()])

    def compute(table: pa.Table, stack: Stack):
        seeds = {n: doubles(table, c) for n, c in seed.items()} or None
        index = stack.at + (0 if seeds is None else np.nan_to_num(seeds["pos"]).astype(np.int64))
        f = Fields(stack, _inputs(table), index, seeds)
        month = table.column("date").to_numpy().astype("datetime64[M]")
        closes = stack.last | (np.append(month[1:], month[-1:]) > month)
        return table, {"bar_idx": index, **{n: f[n] for n in wanted}, **{c: _state(f, n) for n, c in STATES.items()},
                       "_closes": closes}

    kinds = {c: {"y": "double", "at": "int", "seen": "bigint"}[n.split("_")[0]] for n, c in STATES.items()}
    return map_symbols(bars, compute, {"bar_idx": "int", **dict.fromkeys(wanted, "double"), **kinds, "_closes": "boolean"},
                       seed.values())
