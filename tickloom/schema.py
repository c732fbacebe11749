"""Fixed schemas and field names of the engine."""

from pyspark.sql import types as T

OHLC = ("open", "high", "low", "close")
OHLCV = OHLC + ("volume",)

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in OHLCV]
)

UNIVERSE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("industry", T.StringType()),
])

BENCHMARK = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("close", T.DoubleType()),
])

# Indicator periods.
EMA_PERIODS = (10, 20, 50, 100, 200)
SMA_PERIODS = (20, 50, 150, 200)
ROC_PERIODS = (5, 21, 63, 126, 252)
WEEKLY_EMA_PERIODS = (10, 20, 40)

DAILY_FIELDS = (
    OHLCV
    + tuple(f"ema_{n}{s}" for n in EMA_PERIODS for s in ("", "_slope"))
    + tuple(f"sma_{n}{s}" for n in SMA_PERIODS for s in ("", "_slope"))
    + ("rsi", "atr", "atr_pct", "adx", "plus_di", "minus_di", "adx_slope",
       "stoch_k", "stoch_d", "macd", "macd_signal", "macd_hist",
       "bb_upper", "bb_lower", "bb_width_pct",
       "vol_avg_20", "vol_ratio", "turnover_cr",
       "high_52w", "low_52w", "pct_from_52w_high", "pct_from_52w_low")
    + tuple(f"roc_{n}" for n in ROC_PERIODS)
    + ("mom_12_1",)
)

WEEKLY_FIELDS = (
    OHLCV
    + tuple(f"ema_{n}{s}" for n in WEEKLY_EMA_PERIODS for s in ("", "_slope"))
    + ("rsi", "roc_4", "roc_13")
)

# Universes with the median-turnover gate each one applies.
UNIVERSES = (
    ("nifty500", 0.5),
    ("nse_full", 2.0),
    ("nse_etf", 0.1),
)
