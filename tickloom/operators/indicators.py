"""Daily and weekly indicator columns."""

from collections.abc import Iterable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ewm import ewm_steps, span_alpha, wilder_alpha
from ..functions.rolling import extreme_steps, mean_steps
from ..functions.steps import Step, add_steps
from ..functions.ties import difference
from ..functions.windows import lag, number_bars, rolling, trailing
from ..schema import (DAILY_FIELDS, EMA_PERIODS, OHLCV, ROC_PERIODS, SMA_PERIODS,
                      WEEKLY_EMA_PERIODS, WEEKLY_FIELDS)
from .fields import with_fields

MIN_HISTORY = 60


def pct_change(now: Column, base: Column) -> Column:
    """100 (now/base - 1), null for a zero base."""
    return 100 * (now / F.nullif(base, F.lit(0.0)) - 1)


def _lag_step(col: str, n: int = 1) -> Step:
    return Step((col,), lambda: lag(col, n))


def _slope(col: str, n: int) -> Step:
    return Step((col,), lambda: F.col(col) - lag(col, n))


def _mean_slope(col: str, n: int) -> Step:
    """Means of equal sums have a slope of zero, whatever the order of their closes."""
    return Step((col,), lambda: difference(F.col(col), lag(col, n)))


def _roc(n: int) -> Step:
    return Step(("close",), lambda: pct_change(F.col("close"), lag("close", n)))


def _rsi_steps(n: int, smooth=ewm_steps) -> dict[str, Step]:
    """Wilder's index; null, not 100, while the average loss is zero."""
    move = lambda: F.col("close") - F.col("_prev_close")
    gain, loss = F.col, F.col
    return {
        "_gain": Step(("close", "_prev_close"), lambda: F.when(
            move().isNotNull(), F.greatest(move(), F.lit(0.0)))),
        "_loss": Step(("close", "_prev_close"), lambda: F.when(
            move().isNotNull(), F.greatest(-move(), F.lit(0.0)))),
        **smooth("_avg_gain", "_gain", wilder_alpha(n), n),
        **smooth("_avg_loss", "_loss", wilder_alpha(n), n),
        "rsi": Step(("_avg_gain", "_avg_loss"), lambda: 100 - 100 / (
            1 + gain("_avg_gain") / F.nullif(loss("_avg_loss"), F.lit(0.0)))),
    }


def _directional_steps(n: int, smooth=ewm_steps) -> dict[str, Step]:
    up = lambda: F.col("high") - F.col("_prev_high")
    down = lambda: F.col("_prev_low") - F.col("low")

    def moved(mine, other) -> Column:
        return F.when((mine() > other()) & (mine() > 0), mine()).otherwise(0.0)

    def index(smoothed: str) -> Column:
        return 100 * F.col(smoothed) / F.nullif(F.col("atr"), F.lit(0.0))

    reads = ("high", "low", "_prev_high", "_prev_low")
    return {
        "_true_range": Step(("high", "low", "_prev_close"), lambda: F.greatest(
            F.col("high") - F.col("low"),
            F.abs(F.col("high") - F.col("_prev_close")),
            F.abs(F.col("low") - F.col("_prev_close")))),
        **smooth("atr", "_true_range", wilder_alpha(n), n),
        "atr_pct": Step(("atr", "close"), lambda: 100 * F.col("atr") / F.nullif(
            F.col("close"), F.lit(0.0))),
        "_plus_dm": Step(reads, lambda: moved(up, down)),
        "_minus_dm": Step(reads, lambda: moved(down, up)),
        **smooth("_plus_dm_avg", "_plus_dm", wilder_alpha(n), n),
        **smooth("_minus_dm_avg", "_minus_dm", wilder_alpha(n), n),
        "plus_di": Step(("_plus_dm_avg", "atr"), lambda: index("_plus_dm_avg")),
        "minus_di": Step(("_minus_dm_avg", "atr"), lambda: index("_minus_dm_avg")),
        "_dx": Step(("plus_di", "minus_di"), lambda: 100 * F.abs(
            F.col("plus_di") - F.col("minus_di")) / F.nullif(
            F.col("plus_di") + F.col("minus_di"), F.lit(0.0))),
        **smooth("adx", "_dx", wilder_alpha(n), n),
        "adx_slope": _slope("adx", 5),
    }


def stochastic_steps(n: int = 14, smooth_k: int = 3, smooth_d: int = 3) -> dict[str, Step]:
    def raw() -> Column:
        top, bottom = rolling(F.max, "high", n), rolling(F.min, "low", n)
        return 100 * (F.col("close") - bottom) / F.nullif(top - bottom, F.lit(0.0))

    return {
        "_raw_k": Step(("high", "low", "close"), raw),
        "stoch_k": Step(("_raw_k",), lambda: rolling(F.avg, "_raw_k", smooth_k)),
        "stoch_d": Step(("stoch_k",), lambda: rolling(F.avg, "stoch_k", smooth_d)),
    }


def _macd_steps(smooth=ewm_steps) -> dict[str, Step]:
    return {
        **smooth("_ema_12", "close", span_alpha(12), 12),
        **smooth("_ema_26", "close", span_alpha(26), 26),
        "macd": Step(("_ema_12", "_ema_26"), lambda: F.col("_ema_12") - F.col("_ema_26")),
        **smooth("macd_signal", "macd", span_alpha(9), 9),
        "macd_hist": Step(("macd", "macd_signal"),
                          lambda: F.col("macd") - F.col("macd_signal")),
    }


def _band_steps(n: int = 20, width: float = 2.0) -> dict[str, Step]:
    return {
        "_band_sd": Step(("close",), lambda: rolling(F.stddev_samp, "close", n)),
        "bb_upper": Step(("sma_20", "_band_sd"),
                         lambda: F.col("sma_20") + width * F.col("_band_sd")),
        "bb_lower": Step(("sma_20", "_band_sd"),
                         lambda: F.col("sma_20") - width * F.col("_band_sd")),
        "bb_width_pct": Step(("bb_upper", "bb_lower", "sma_20"), lambda: 100 * (
            F.col("bb_upper") - F.col("bb_lower")) / F.nullif(F.col("sma_20"), F.lit(0.0))),
    }


def median_steps(out: str, col: str, n: int) -> dict[str, Step]:
    """Median of the last ``n`` values, null until there are ``n``: they are looked up and sorted,
    which costs less than a percentile that counts them anew for each bar."""
    ordered = f"_{out}_ordered"

    def values() -> Column:
        held = [F.col(col), *[lag(col, i) for i in range(1, n)]]
        known = reduce(lambda a, b: a & b, [v.isNotNull() for v in held])
        return F.when(known, F.sort_array(F.array(*[F.coalesce(v, F.lit(0.0)) for v in held])))

    low, high = (n - 1) // 2, n // 2
    return {
        ordered: Step((col,), values),
        out: Step((ordered,), lambda: 0.5 * F.get(ordered, F.lit(low)) + 0.5 * F.get(ordered, F.lit(high))),
    }


def _yearly_range_steps() -> dict[str, Step]:
    return {
        **extreme_steps("high_52w", "high", "max", 252, 60),
        **extreme_steps("low_52w", "low", "min", 252, 60),
        "pct_from_52w_high": Step(("close", "high_52w"),
                                  lambda: pct_change(F.col("close"), F.col("high_52w"))),
        "pct_from_52w_low": Step(("close", "low_52w"),
                                 lambda: pct_change(F.col("close"), F.col("low_52w"))),
    }


# Smoothings of the daily panel and their inputs, inner ones included.
SMOOTHED = {
    **{f"ema_{n}": "close" for n in EMA_PERIODS}, "_ema_12": "close", "_ema_26": "close",
    "_avg_gain": "_gain", "_avg_loss": "_loss", "atr": "_true_range", "_plus_dm_avg": "_plus_dm",
    "_minus_dm_avg": "_minus_dm", "adx": "_dx", "macd_signal": "macd",
}


def daily_book(turnover_scale: float = 1e7, seeded: bool = False) -> dict[str, Step]:
    """``seeded``: smoothings go on from a column ``_seed`` (see ``functions.ewm``)."""
    smooth = partial(ewm_steps, seeded=seeded)
    book = {
        "_prev_close": _lag_step("close"),
        "_prev_open": _lag_step("open"),
        "_prev_high": _lag_step("high"),
        "_prev_low": _lag_step("low"),
    }
    for n in EMA_PERIODS:
        book |= smooth(f"ema_{n}", "close", span_alpha(n), n)
        book[f"ema_{n}_slope"] = _slope(f"ema_{n}", 5)
    for n in SMA_PERIODS:
        book |= mean_steps(f"sma_{n}", "close", n)
        book[f"sma_{n}_slope"] = _mean_slope(f"sma_{n}", 5)
    book |= _rsi_steps(14, smooth)
    book |= _directional_steps(14, smooth)
    book |= stochastic_steps()
    book |= _macd_steps(smooth)
    book |= _band_steps()
    book["vol_avg_20"] = Step(("volume",), lambda: rolling(F.avg, "volume", 20))
    book["vol_ratio"] = Step(("volume", "vol_avg_20"), lambda: F.col("volume") / F.nullif(
        F.col("vol_avg_20"), F.lit(0.0)))
    book["turnover_cr"] = Step(("close", "volume"),
                               lambda: F.col("close") * F.col("volume") / turnover_scale)
    book |= _yearly_range_steps()
    for n in ROC_PERIODS:
        book[f"roc_{n}"] = _roc(n)
    book["mom_12_1"] = Step(("close",), lambda: pct_change(lag("close", 21), lag("close", 252)))
    book |= median_steps("median_turnover", "turnover_cr", 20)
    return book


def weekly_book() -> dict[str, Step]:
    book = {"_prev_close": _lag_step("close")}
    for n in WEEKLY_EMA_PERIODS:
        book |= ewm_steps(f"ema_{n}", "close", span_alpha(n), n)
        book[f"ema_{n}_slope"] = _slope(f"ema_{n}", 3)
    book |= _rsi_steps(14)
    for n in (4, 13):
        book[f"roc_{n}"] = _roc(n)
    return book


def panel(bars: DataFrame, fields: Iterable[str] = DAILY_FIELDS,
          min_bars: int = MIN_HISTORY) -> DataFrame:
    """The indicator panel: (symbol, date, bar_idx, n_bars) plus ``fields``. Symbols
    with fewer than ``min_bars`` bars are left out. A panel is itself a table of
    bars: whatever runs on bars runs on a stored panel and finds its fields
    there instead of computing them."""
    fields = list(fields)
    if {"bar_idx", "n_bars", *fields} <= set(bars.columns):
        df = number_bars(bars, min_bars)
    else:
        df = with_fields(bars, fields, min_bars)
    return df.select("symbol", "date", "bar_idx", "n_bars", *fields)


def week_ending(date: str = "date") -> Column:
    """The Friday on or after a date."""
    return F.next_day(F.date_sub(F.col(date), 1), "FRI")


def weekly_bars(bars: DataFrame) -> DataFrame:
    """Bars by week ending Friday; ``date`` is that Friday. The last week of a
    symbol may be partial."""
    priced = bars.filter(F.col("close").isNotNull())
    return (priced.groupBy("symbol", week_ending().alias("week"))
            .agg(F.min_by("open", "date").alias("open"),
                 F.max("high").alias("high"),
                 F.min("low").alias("low"),
                 F.max_by("close", "date").alias("close"),
                 F.sum("volume").alias("volume"))
            .withColumnRenamed("week", "date"))


def weekly_panel(bars: DataFrame, fields: Iterable[str] = WEEKLY_FIELDS) -> DataFrame:
    """Weekly indicators; ``bars`` are daily."""
    fields = list(fields)
    df = add_steps(number_bars(weekly_bars(bars)), weekly_book(), fields)
    return df.select("symbol", "date", "bar_idx", *fields)


assert set(OHLCV) <= set(DAILY_FIELDS)
