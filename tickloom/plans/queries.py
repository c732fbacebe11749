"""Registered queries: every operator over the whole of the given tables.

Bars come from the order lines (``sources.lineitem_bars``), the universe from the
suppliers with their nation as industry. Thresholds that the bars cannot meet
(turnover) are scaled; everything else runs with its usual arguments.
"""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.asof import as_of_rows, asof_join, calendar, fill_calendar
from ..functions.ewm import ewm_steps, span_alpha
from ..functions.ranks import places
from ..functions.rolling import mean_steps
from ..functions.steps import add_steps
from ..functions.windows import by_symbol, number_bars
from ..operators import cohorts as co
from ..operators import event_study as es
from ..operators import evidence, performance, quality, sizing
from ..operators import screen as sc
from ..operators.conditions import (Condition, atr_pct_percentile, bb_squeeze, breadth,
                                    breakout_resistance, candle, change, compare, cross,
                                    divergence, flat_base, gap, near_resistance, near_support,
                                    persistence, proximity, rel_strength, rs_percentile, sector,
                                    sector_rank, support_at_ma, threshold_cross, tight_range,
                                    trend, volume_spike, within)
from ..operators.cross_section import breadth as breadth_series
from ..operators.cross_section import return_step, standing, with_ranks
from ..operators.indicators import daily_book, panel, weekly_bars, weekly_panel
from ..operators.levels import level_steps
from ..schema import DAILY_FIELDS, OHLCV, ROC_PERIODS, UNIVERSES, WEEKLY_FIELDS
from ..session import new_folder, written
from ..sources import bars as src
from ..sources import stores
from ..sources.lineitem_bars import load_bars, load_universe, mean_close
from ..sources.panels import PanelStore
from ..sources.versions import Store
from .catalogue import PRESETS

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.date(1997, 6, 30)
GATE = 0.2
SECTORS = ("NATION_3", "NATION_7", "NATION_11")
PATTERN_NAMES = ("inside_bar", "nr7", "bullish_engulfing", "bearish_engulfing", "hammer",
                 "shooting_star")

INDICATORS: dict[str, tuple[str, ...]] = {
    "ema": ("ema_10", "ema_20", "ema_50", "ema_100", "ema_200"),
    "ema_slope": ("ema_10_slope", "ema_20_slope", "ema_50_slope", "ema_100_slope",
                  "ema_200_slope"),
    "sma": ("sma_20", "sma_50", "sma_150", "sma_200"),
    "sma_slope": ("sma_20_slope", "sma_50_slope", "sma_150_slope", "sma_200_slope"),
    "rsi": ("rsi",),
    "atr": ("atr", "atr_pct"),
    "adx": ("adx", "plus_di", "minus_di", "adx_slope"),
    "stochastic": ("stoch_k", "stoch_d"),
    "macd": ("macd", "macd_signal", "macd_hist"),
    "bollinger": ("bb_upper", "bb_lower", "bb_width_pct"),
    "volume_average": ("vol_avg_20", "vol_ratio"),
    "turnover": ("turnover_cr",),
    "yearly_range": ("high_52w", "low_52w", "pct_from_52w_high", "pct_from_52w_low"),
    "rate_of_change": tuple(f"roc_{n}" for n in ROC_PERIODS),
    "momentum_12_1": ("mom_12_1",),
    "median_turnover": ("median_turnover",),
}


def decimals_of(fields) -> int:
    """Turnovers are multiples of 5e-7 here: rounded where they cannot tie."""
    return 8 if "median_turnover" in fields else 6


CONDITIONS: dict[str, Condition] = {
    "compare": compare("close", ">", "sma_200"),
    "compare_number": compare("adx", ">=", 25),
    "proximity": proximity("low", "ema_50", 1.0, 3),
    "trend_up": trend("up"),
    "trend_down": trend("down"),
    "weekly_trend": trend("up", timeframe="weekly"),
    "support_at_ma": support_at_ma("ema_50"),
    "cross_above": cross("ema_50", "ema_200", "above", 5),
    "cross_below": cross("ema_20", "ema_50", "below", 3),
    "volume_spike": volume_spike(1.5),
    "within": within("rsi", min=40, max=60),
    "change": change("close", 21, ">", 10),
    "near_support": near_support(2.0),
    "near_resistance": near_resistance(2.5),
    "breakout_resistance": breakout_resistance(5, 0.5),
    "rel_strength": rel_strength(63, ">", 0),
    "tight_range": tight_range(8, 10),
    "bb_squeeze": bb_squeeze(20, 252),
    "flat_base": flat_base(),
    "gap_up": gap("up", 2.0, 3),
    "gap_down": gap("down", 2.0, 3),
    "sector": sector(SECTORS),
    "rs_percentile": rs_percentile(">=", 80),
    "rs_percentile_mom_12_1": rs_percentile(">=", 80, basis="mom_12_1"),
    "atr_pct_percentile": atr_pct_percentile("<=", 30),
    "sector_rank_top": sector_rank(63, top=3),
    "sector_rank_bottom": sector_rank(63, bottom=3),
    "breadth_positive": breadth("positive"),
    "breadth_negative": breadth("negative"),
    "threshold_cross": threshold_cross("rsi", 40, "above", 3),
    "persistence": persistence("rsi", ">=", 60, 15),
    "divergence_bullish": divergence("bullish", "rsi", 40),
    "divergence_bearish": divergence("bearish", "stoch_k", 40),
    "weekly_compare": compare("close", ">", "ema_20", timeframe="weekly"),
    "weekly_within": within("rsi", min=50, timeframe="weekly"),
    "weekly_change": change("close", 4, ">", 3, timeframe="weekly"),
    "weekly_cross": cross("ema_10", "ema_20", "above", 3, timeframe="weekly"),
    **{f"candle_{p}": candle(p, 1) for p in PATTERN_NAMES},
}

FLAGSHIP = [compare("close", ">", "sma_200"), volume_spike(1.2)]
# screens used by the operators on whole screens
EVIDENCE_SCREEN = [
    compare("close", ">", "sma_50"), proximity("low", "ema_50", 1.0, 3), trend("up"),
    support_at_ma("ema_50"), cross("ema_20", "ema_50", "above", 5), volume_spike(1.5),
    within("rsi", min=40, max=60), change("close", 21, ">", 0), near_support(2.5),
    near_resistance(2.5), breakout_resistance(5), rel_strength(63, ">", 0), candle("hammer", 5),
    gap("up", 2.0, 5), threshold_cross("rsi", 50, "above", 5), persistence("rsi", ">=", 50, 5),
    divergence("bullish", "rsi", 40), tight_range(8, 10), flat_base(), bb_squeeze(20, 252),
]
RANK_EVIDENCE_SCREEN = [rs_percentile(">=", 60), rs_percentile(">=", 60, basis="mom_12_1"),
                        atr_pct_percentile("<=", 50), sector_rank(63, top=5),
                        breadth("positive")]
WEEKLY_EVIDENCE_SCREEN = [
    trend("up", timeframe="weekly"), compare("close", ">", "ema_20", timeframe="weekly"),
    within("rsi", min=50, timeframe="weekly"), change("close", 4, ">", 3, timeframe="weekly"),
    cross("ema_10", "ema_20", "above", 3, timeframe="weekly"), sector(SECTORS)]
NEAR_SCREEN = [trend("up"), within("rsi", min=50), volume_spike(1.0),
               within("pct_from_52w_high", min=-5)]
STUDY_SCREENS = {
    "pullback": ([support_at_ma("ema_50"), trend("up")], "AND"),
    "golden_cross": ([cross("ema_50", "ema_200", "above", 5)], "AND"),
    "gap_or_spike": ([gap("up", 2.0, 1), volume_spike(1.8)], "OR"),
}
GRID_SCREEN = [within("rsi", max=40), volume_spike(1.2)]
BATCH_SCREENS = {k: (v, "AND") for k, v in PRESETS.items()}
CAPITAL = 100_000.0
COHORT_ANCHOR = dt.date(1995, 3, 1)


def preset_conditions(name: str) -> list[Condition]:
    """Presets as registered; the turnover floor of one is scaled to these bars."""
    return [within("turnover_cr", min=0.3) if c.kind == "within" and c["field"] == "turnover_cr"
            else c for c in PRESETS[name]]


def market(spark: SparkSession, folder: str) -> sc.Market:
    bars = load_bars(spark, folder)
    return sc.Market(bars, load_universe(spark, folder), mean_close(bars))


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    # adding zero turns a negative zero into zero
    return df.select(*[(F.round(c, decimals) + F.lit(0.0)).alias(c) if t == "double"
                       else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- sources
def dirty_bars(bars: DataFrame) -> DataFrame:
    day = F.dayofmonth("date")
    return bars.select(
        "symbol", (F.col("date").cast("timestamp_ntz") + F.expr("interval 9 hours")).alias("date"),
        "open", F.when(day == 17, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.when(day == 13, -F.col("low")).otherwise(F.col("low")).alias("low"), "close", "volume")


def scaled(bars: DataFrame, factor: float) -> DataFrame:
    return bars.select("symbol", "date", *[(F.col(c) * factor).alias(c) for c in
                                           ("open", "high", "low", "close")], "volume")


def q_clean_bars(spark, folder):
    return src.clean_bars(dirty_bars(load_bars(spark, folder)))


def q_upsert_bars(spark, folder):
    bars = load_bars(spark, folder)
    old = bars.filter(F.col("date") < "1997-01-01")
    new = scaled(bars.filter(F.col("date") >= "1996-06-01"), 2.0)
    return src.upsert_bars(old, new)


def q_replace_symbols(spark, folder):
    bars = load_bars(spark, folder)
    owed = spark.read.parquet(f"{folder}/supplier.parquet").filter("s_acctbal < 2000").select(
        F.col("s_suppkey").cast("string").alias("symbol"))
    fresh = scaled(bars.join(owed, "symbol", "left_semi").filter(F.col("date") >= "1995-01-01"), 0.5)
    return src.replace_symbols(bars, fresh)


def exchange_text(bars: DataFrame) -> DataFrame:
    """Daily rows as an exchange prints them: padded text, two series, gaps."""
    pad = lambda c: F.concat(F.lit(" "), c.cast("string"))
    day = F.dayofmonth("date")
    return bars.select(
        pad(F.col("symbol")).alias("SYMBOL"),
        F.when(day == 3, " BE").otherwise(" EQ").alias(" SERIES"),
        pad(F.date_format("date", "dd-MMM-yyyy")).alias(" DATE1"),
        pad(F.col("open")).alias(" OPEN_PRICE"),
        F.when(day == 5, " -").otherwise(pad(F.col("high"))).alias(" HIGH_PRICE"),
        F.when(day == 7, " 0").otherwise(pad(F.col("low"))).alias(" LOW_PRICE"),
        pad(F.col("close")).alias(" CLOSE_PRICE"),
        pad(F.col("volume").cast("bigint")).alias(" TTL_TRD_QNTY"),
        F.when(day == 9, " -").otherwise(pad(day)).alias(" DELIV_PER"))


def q_exchange_rows(spark, folder):
    return src.parse_exchange_rows(exchange_text(load_bars(spark, folder)))


def q_append_days(spark, folder):
    bars = load_bars(spark, folder)
    return src.append_days(bars.filter(F.col("date") <= "1997-06-30"),
                           scaled(bars.filter(F.col("date") > "1997-05-31"), 3.0))


def subjects(spark, folder) -> DataFrame:
    part = spark.read.parquet(f"{folder}/part.parquet")
    key, size = F.col("p_partkey"), F.col("p_size")
    return part.select("p_partkey", F.concat(
        F.when(size % 5 == 0, F.concat(F.lit("Bonus "), (size % 4 + 1).cast("string"), F.lit(":"),
                                       (key % 5 + 1).cast("string")))
        .when(size % 5 == 1, F.concat(
            F.lit("Face Value Split (Sub-Division) - From Rs"), (size % 9 + 2).cast("string"),
            F.lit("/- Per Share To Re "), (key % 2 + 1).cast("string"), F.lit("/- Per Share")))
        .when(size % 5 == 2, F.concat(F.lit("Interim Dividend - Rs "), size.cast("string"),
                                      F.lit(" Per Share")))
        .when(size % 5 == 3, F.lit("  BONUS 1 : 1 "))
        .otherwise(F.lit("Annual General Meeting"))).alias("subject"))


def q_adjustment_factor(spark, folder):
    return subjects(spark, folder).withColumn("factor", src.adjustment_factor("subject"))


def actions(bars: DataFrame) -> DataFrame:
    """Announcements derived from bars: the first days of January and July."""
    q = (F.col("volume") / 1000).cast("bigint")
    named = bars.filter((F.dayofmonth("date") <= 3) & F.month("date").isin(1, 7))
    return named.select(
        "symbol", F.date_format("date", "dd-MMM-yyyy").alias("exDate"),
        F.when(q % 3 == 0, F.lit("Dividend")).otherwise(
            F.concat(F.lit("Bonus 1:"), (q % 4 + 2).cast("string"))).alias("subject"),
        F.lit("EQ").alias("series"))


def q_corporate_actions(spark, folder):
    return src.corporate_actions(actions(load_bars(spark, folder)))


def q_cumulative_factors(spark, folder):
    df = src.cumulative_factors(src.corporate_actions(actions(load_bars(spark, folder))))
    return df.select("symbol", "ex_date", "factor", "cum_factor")


def q_adjusted_bars(spark, folder):
    bars = load_bars(spark, folder)
    factors = src.cumulative_factors(src.corporate_actions(actions(bars)))
    return src.apply_adjustments(bars, factors)


def _supplier_listing(spark, folder) -> DataFrame:
    return load_universe(spark, folder)


def q_universe_index(spark, folder):
    u = _supplier_listing(spark, folder)
    return src.universe_from_index_list(u.select(
        F.concat(F.col("name"), F.lit("  ")).alias("Company Name"), F.col("industry").alias("Industry"),
        F.concat(F.lit(" "), "symbol").alias("Symbol")))


def q_universe_full(spark, folder):
    u = _supplier_listing(spark, folder)
    return src.universe_from_full_listing(u.select(
        F.concat(F.lit(" "), "symbol").alias("SYMBOL"),
        F.col("name").alias("NAME OF COMPANY"),
        F.when(F.col("industry") == "NATION_5", " BE").otherwise(" EQ").alias(" SERIES")))


def q_universe_curated(spark, folder):
    u = _supplier_listing(spark, folder)
    return src.universe_from_curated(
        u.select(F.concat(F.lit(" "), "symbol").alias("Symbol"), F.col("name").alias("SecurityName")),
        u.filter(F.col("industry").isin(*SECTORS)).select("symbol"))


def q_benchmark_filled(spark, folder):
    """Month-start benchmark values carried onto every date."""
    bars = load_bars(spark, folder)
    monthly = mean_close(bars).filter(F.dayofmonth("date") == 1)
    return rounded(fill_calendar(bars.select("date").distinct(), monthly, ["close"]))


def q_asof_join(spark, folder):
    """The supplier's latest close at or before each order line's order date."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("date"))
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").join(orders, "l_orderkey").select(
        F.col("l_suppkey").cast("string").alias("symbol"), "date", "l_orderkey", "l_linenumber")
    bars = load_bars(spark, folder).select("symbol", "date", "close", F.col("date").alias("bar_date"))
    return asof_join(lines, bars, ["symbol"], ["close", "bar_date"])


# ---------------------------------------------------------------- structure, cross section
def q_pivots(spark, folder):
    df = add_steps(number_bars(load_bars(spark, folder), 60), level_steps(),
                   ["pivot_high", "pivot_low"])
    return df.filter("pivot_high or pivot_low").select("symbol", "date", "pivot_high", "pivot_low")


def q_sr_levels(spark, folder):
    df = add_steps(number_bars(load_bars(spark, folder), 60), level_steps(), ["levels"])
    return df.select("symbol", "date", F.explode("levels").alias("v")).select(
        "symbol", "date", F.round("v.level", 10).alias("level"), "v.touches")


def q_nearest_levels(spark, folder):
    df = add_steps(number_bars(load_bars(spark, folder), 60), level_steps(),
                   ["support", "resistance"])
    return rounded(df.select("symbol", "date", "close", "support", "resistance"))


def q_cross_section(spark, folder):
    """Ranks of every bar: three percentiles and the sector's place."""
    m = market(spark, folder)
    bars = m.bars.join(m.universe.select("symbol", "industry"), "symbol", "left")
    book = daily_book() | {"ret_63": return_step(63)}
    df = add_steps(number_bars(bars, 60), book, ["ret_63", "mom_12_1", "atr_pct"]).select(
        "symbol", "date", "_blk", "industry", "ret_63", "mom_12_1", "atr_pct")
    ranked = with_ranks(standing(df), ["rank:ret_63", "rank:mom_12_1", "rank:atr_pct", "sector_rank:63"])
    return ranked.select(
        "symbol", "date", "industry", F.round("ret_63", 6).alias("ret_63"), "ret_63_pctl",
        "mom_12_1_pctl", "atr_pct_pctl", F.round("sector_ret_63", 6).alias("sector_ret_63"),
        "sector_rank_63", "n_sectors_63")


def q_breadth(spark, folder):
    return rounded(breadth_series(load_bars(spark, folder)))


def q_asof_rows(spark, folder):
    df = as_of_rows(load_bars(spark, folder), ["close"])
    return df.select("as_of", "symbol", "date", "close")


# ---------------------------------------------------------------- screens
def _evaluated(spark, folder, as_of=None, gate=GATE):
    return sc.evaluate(market(spark, folder), NEAR_SCREEN, as_of=as_of, gate=gate)


def _display(df: DataFrame) -> DataFrame:
    return rounded(df.select(*[c for c in df.columns if not c.startswith("c_")]))


def q_match_table(spark, folder):
    """On a past date."""
    return _display(sc.matches(_evaluated(spark, folder, AS_OF), None))


def q_shown_matches(spark, folder):
    """The match table of the latest bars as a reader sees it."""
    return sc.for_display(sc.matches(_evaluated(spark, folder)).drop(*[c.name for c in NEAR_SCREEN]))


def q_top_matches(spark, folder):
    return _display(sc.matches(_evaluated(spark, folder), 10)).select("symbol", "ret_3m_pct")


def q_near_misses(spark, folder):
    return _display(sc.near_misses(_evaluated(spark, folder), None))


def q_screen_stats(spark, folder):
    return sc.screen_stats(_evaluated(spark, folder, gate=0.0), GATE)


def q_sector_gap(spark, folder):
    return sc.sector_gap(load_universe(spark, folder), PRESETS["sector_leader_pullback"])


def q_recent_bars(spark, folder):
    df = sc.recent_bars(market(spark, folder), ["close", "low", "high", "ema_50", "support"], 60)
    flat = df.select("symbol", F.explode("points").alias("p")).select("symbol", "p.*")
    return rounded(flat)


def q_quality_flags(spark, folder):
    m = market(spark, folder)
    # halve the last quarter of each price series so that jumps occur
    cut = F.col("date") >= "1998-06-01"
    bars = m.bars.select("symbol", "date", *[
        F.when(cut, F.col(c) * 0.5).otherwise(F.col(c)).alias(c) if c != "volume" else F.col(c)
        for c in OHLCV])
    return sc.quality_flags(sc.Market(bars), thin_bars=530)


def q_batch(spark, folder):
    df = sc.batch(market(spark, folder), BATCH_SCREENS, _previous(spark, folder))
    return df.select("screen_id", "matched", F.array_join("top3", ",").alias("top3"),
                     "new_since_last")


def _previous(spark, folder) -> DataFrame:
    """An earlier run: the uptrend screen half a year before the end."""
    m = market(spark, folder).until(dt.date(1998, 6, 1))
    df = sc.signals(m, PRESETS["tsmom_regime"], latest=True)
    return df.filter(sc.combine(PRESETS["tsmom_regime"])).select(
        F.lit("tsmom_regime").alias("screen_id"), "symbol")


def q_run_diff(spark, folder):
    now = sc.evaluate(market(spark, folder), PRESETS["tsmom_regime"])
    df = sc.run_diff(now, _previous(spark, folder))
    return df.select("symbol", "change", F.array_join("failing", ",").alias("failing"))


def q_watchlist(spark, folder):
    m = market(spark, folder)
    first = Window.partitionBy("symbol").orderBy("date")
    tags = (m.bars.filter(F.col("date") >= "1997-01-01")
            .withColumn("k", F.row_number().over(first)).filter("k = 1")
            .select(F.lit("tsmom_regime").alias("screen_id"), "symbol",
                    F.col("close").alias("close_at_tag"), F.col("date").alias("ts")))
    return rounded(sc.watchlist(tags, m, {"tsmom_regime": (PRESETS["tsmom_regime"], "AND")}))


def _flat_evidence(df: DataFrame, names: dict[int, tuple[str, ...]]) -> DataFrame:
    """One row per bar and condition with the values in columns v1..v4."""
    e = df.select("symbol", "date", F.explode("evidence").alias("e"))
    widest = max(len(v) for v in names.values())
    label = lambda j: F.create_map(*[x for i, v in names.items() for x in (
        F.lit(i), F.lit(v[j] if j < len(v) else None))])[F.col("e.cond_id")]
    words = F.transform(F.array_sort(F.map_entries("e.words")), lambda w: F.concat(w["key"], F.lit("="), w["value"]))
    return e.select(
        "symbol", "date", "e.cond_id", "e.passed", "e.at",
        *[F.round(F.try_element_at("e.values", label(j)), 6).alias(f"v{j + 1}")
          for j in range(widest)], F.array_join(words, ";").alias("words"))


def q_evidence(spark, folder):
    df = evidence.explain(market(spark, folder), EVIDENCE_SCREEN, latest=True)
    names = {i: tuple(evidence.evidence_steps(c)[1]) for i, c in enumerate(EVIDENCE_SCREEN)}
    return _flat_evidence(df, names)


def q_rank_evidence(spark, folder):
    df = evidence.explain(market(spark, folder), RANK_EVIDENCE_SCREEN, latest=False)
    names = {i: tuple(evidence.evidence_steps(c)[1]) for i, c in enumerate(RANK_EVIDENCE_SCREEN)}
    return _flat_evidence(df, names)


def q_weekly_evidence(spark, folder):
    df = evidence.explain(market(spark, folder), WEEKLY_EVIDENCE_SCREEN, latest=False)
    names = {i: tuple(evidence.evidence_steps(c)[1]) for i, c in enumerate(WEEKLY_EVIDENCE_SCREEN)}
    return _flat_evidence(df, names)


# ---------------------------------------------------------------- kept tables
def kept_panel(spark, folder) -> PanelStore:
    """A panel that is kept over two commits: early bars, one month of them wrong for some symbols;
    then the days that follow together with the corrections, sent twice."""
    bars = load_bars(spark, folder)
    store = PanelStore(spark, new_folder(spark, "panel"))
    late = (F.date_format("date", "yyyy-MM") == "1996-03") & F.col("symbol").endswith("7")
    early = F.col("date") < "1996-07-01"
    store.extend(bars.filter(early & ~late).unionByName(scaled(bars.filter(late), 1.1)), "daily", 1)
    for _ in range(2):
        store.extend(bars.filter(~early | late), "daily", 2)
    return store


KEPT_FIELDS = ("open", "close", "ema_10", "ema_200_slope", "sma_200", "rsi", "atr_pct", "adx_slope", "macd_hist", "bb_width_pct",
               "stoch_d", "vol_ratio", "high_52w", "pct_from_52w_low", "mom_12_1")


def q_kept_panel(spark, folder):
    return rounded(kept_panel(spark, folder).panel().select("symbol", "date", *KEPT_FIELDS))


def q_kept_match_table(spark, folder):
    """The match table of a past date from the months of a kept panel that it reaches."""
    store = PanelStore(spark, new_folder(spark, "panel"))
    store.extend(load_bars(spark, folder), "daily", 1)
    m = store.market(NEAR_SCREEN, sc.METRICS, as_of=AS_OF, universe=load_universe(spark, folder))
    return _display(sc.matches(sc.evaluate(m, NEAR_SCREEN, gate=GATE)))


def q_read_bars(spark, folder):
    """Bars written as a store's files and read from them."""
    path = new_folder(spark, "bars")
    load_bars(spark, folder).write.parquet(path)
    return src.read_bars(spark, path)


def q_benchmark(spark, folder):
    path = new_folder(spark, "benchmark")
    mean_close(load_bars(spark, folder)).write.parquet(path)
    return rounded(src.read_benchmark(spark, path))


def q_kept_runs(spark, folder):
    """Matches of two runs, kept; the second run is sent twice."""
    runs = Store(spark, new_folder(spark, "runs"))
    df = sc.evaluate(market(spark, folder), PRESETS["tsmom_regime"])
    first = sc.evaluate(market(spark, folder), PRESETS["tsmom_regime"], as_of=AS_OF)
    for number, found, ts in ((1, first, "1997-06-30"), (2, df, "1998-12-31"), (2, df, "1998-12-31")):
        stores.keep_run(runs, stores.run_record(found, "tsmom_regime", ts, ts), number)
    return rounded(stores.kept_runs(runs, "tsmom_regime"))


def q_kept_milestones(spark, folder):
    """Milestones frozen in two steps; what is frozen stays as it is, also when it is sent again
    with other figures."""
    store = Store(spark, new_folder(spark, "milestones"))
    rows = written(_milestones(spark, folder)[3])
    stores.freeze_milestones(store, rows.filter("horizon = 5"), 1)
    stores.freeze_milestones(store, rows.withColumn("net", F.when(F.col("horizon") == 5, 0.0).otherwise(F.col("net"))), 2)
    stores.freeze_milestones(store, rows, 2)
    return rounded(stores.kept_milestones(store).select("cohort_id", "horizon", "n_symbols", "n_stale", "gross", "net"))


def q_gated_universes(spark, folder):
    """Symbols whose median turnover reaches the gate of each universe, scaled to these bars."""
    last = sc.signals(market(spark, folder), [FLAGSHIP[0]], ["median_turnover"], latest=True)
    gates = spark.createDataFrame(UNIVERSES, "universe_id string, gate double")
    return last.crossJoin(F.broadcast(gates)).groupBy("universe_id").agg(
        F.count_if(F.col("median_turnover") >= F.col("gate") / 5).alias("liquid"))


# ---------------------------------------------------------------- event study
def _study(spark, folder):
    return es.events(market(spark, folder), STUDY_SCREENS, gate=GATE)


def q_forward_returns(spark, folder):
    return rounded(es.forward_returns(market(spark, folder)))


def q_baseline(spark, folder):
    return rounded(es.baseline(market(spark, folder), gate=GATE))


def q_daily_baseline(spark, folder):
    return rounded(es.daily_baseline(market(spark, folder), GATE))


def q_events(spark, folder):
    return rounded(es.wide_events(_study(spark, folder)))


def q_horizon_stats(spark, folder):
    return rounded(es.horizon_stats(_study(spark, folder)))


def q_event_timeline(spark, folder):
    return es.timeline(_study(spark, folder))


def q_bootstrap(spark, folder):
    return rounded(es.bootstrap(_study(spark, folder)))


def q_sensitivity(spark, folder):
    df = es.sensitivity(market(spark, folder), GRID_SCREEN)
    return rounded(df.select("condition_index", "param", "step", "n_events", "mean_excess_net",
                             "base_mean", "robust"))


# ---------------------------------------------------------------- sizing
def picks_and_quotes(spark, folder) -> tuple[DataFrame, DataFrame]:
    """One portfolio per region, its symbols ranked by three-month return; the
    nation is the sector."""
    m = market(spark, folder)
    last = sc.signals(m, [trend("up")], ["close", "atr", "atr_pct", "roc_63"], latest=True)
    nation = spark.read.parquet(f"{folder}/nation.parquet").select(
        F.col("n_name").alias("sector"), F.col("n_regionkey").cast("string").alias("portfolio_id"))
    rows = last.join(m.universe, "symbol").join(nation, F.col("industry") == F.col("sector"))
    picks = places(rows.select("portfolio_id", "symbol", "roc_63"), ["portfolio_id"], "roc_63",
                   "symbol").select("portfolio_id", "rank", "symbol")
    quotes = rows.select("symbol", F.col("close").alias("entry"), "atr", "atr_pct", "sector")
    return picks, quotes


def q_sizing_candidates(spark, folder):
    picks, quotes = picks_and_quotes(spark, folder)
    return rounded(sizing.candidates(picks, quotes))


def _sizing(method: str) -> Query:
    def run(spark, folder):
        picks, quotes = picks_and_quotes(spark, folder)
        return rounded(sizing.allocate(picks, quotes, CAPITAL, method, max_positions=15), 4)
    return run


def q_sizing_summary(spark, folder):
    picks, quotes = picks_and_quotes(spark, folder)
    both = sizing.with_equal_baseline(picks, quotes, CAPITAL, "risk", max_positions=15)
    return rounded(sizing.summary(both, CAPITAL), 4)


# ---------------------------------------------------------------- cohorts
def cohort_tables(spark, folder) -> tuple[DataFrame, DataFrame]:
    """A cohort per nation, holding its suppliers, anchored at dates 20 days apart."""
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    cohorts = nation.select(
        F.col("n_name").alias("cohort_id"),
        F.concat(F.lit("screen_"), F.col("n_regionkey").cast("string")).alias("screen_id"),
        F.lit("all").alias("universe_id"),
        F.when(F.col("n_nationkey") % 3 == 0, co.REPLAY).otherwise(co.FORWARD).alias("mode"),
        F.date_add(F.lit(COHORT_ANCHOR), (F.col("n_nationkey") * 20).cast("int")).alias("anchor"),
        F.lit(co.PENDING).alias("status"), F.lit(None).cast("date").alias("entry_date"))
    members = co.equal_weights(load_universe(spark, folder).select(
        F.col("industry").alias("cohort_id"), "symbol"))
    return cohorts, members


def _entered(spark, folder):
    m = market(spark, folder)
    cohorts, members = cohort_tables(spark, folder)
    return m, co.entry_dates(cohorts, members, m.bars), members


def q_cohort_weights(spark, folder):
    return cohort_tables(spark, folder)[1]


def q_value_weights(spark, folder):
    s = spark.read.parquet(f"{folder}/supplier.parquet")
    return co.value_weights(s.select(
        F.col("s_nationkey").alias("cohort_id"), F.col("s_suppkey").cast("string").alias("symbol"),
        (F.col("s_acctbal") + 2000).cast("double").alias("value"))).select(
        "cohort_id", "symbol", "weight")


def q_resolve_as_of(spark, folder):
    cohorts, _ = cohort_tables(spark, folder)
    asked = cohorts.select("cohort_id", F.add_months(F.col("anchor"), 30).alias("as_of"))
    return co.resolve_as_of(asked, load_bars(spark, folder))


def q_entry_dates(spark, folder):
    return _entered(spark, folder)[1].select("cohort_id", "anchor", "entry_date", "status")


def q_member_returns(spark, folder):
    m, cohorts, members = _entered(spark, folder)
    return rounded(co.member_returns(cohorts, members, m))


def _milestones(spark, folder):
    m, cohorts, members = _entered(spark, folder)
    return m, cohorts, members, co.milestones(cohorts, members, m)


def q_milestones(spark, folder):
    return rounded(_milestones(spark, folder)[3])


def q_freeze(spark, folder):
    """Milestones still to be written when the 5-bar ones already are."""
    rows = _milestones(spark, folder)[3]
    return rounded(co.freeze(rows.filter("horizon = 5"), rows))


def q_cohort_status(spark, folder):
    _, cohorts, _, rows = _milestones(spark, folder)
    return co.complete(cohorts, rows).select("cohort_id", "status")


def q_current_snapshot(spark, folder):
    m, cohorts, members = _entered(spark, folder)
    return rounded(co.current_snapshot(cohorts, members, m))


def q_delete_cohorts(spark, folder):
    _, cohorts, _ = _entered(spark, folder)
    requests = cohorts.select("cohort_id", F.when(
        F.length("cohort_id") > 8, "no longer followed").otherwise(" ").alias("reason"))
    return co.delete(cohorts, requests).select("cohort_id", "status", "delete_reason")


def q_scorecard(spark, folder):
    _, cohorts, _, rows = _milestones(spark, folder)
    study = (es.events(market(spark, folder), {"screen_0": STUDY_SCREENS["pullback"]})
             .groupBy("screen_id", "horizon").agg(F.avg("excess_net").alias("mean"))
             .select("screen_id", F.lit("all").alias("universe_id"), "horizon",
                     F.lit(1).alias("ts"), "mean"))
    return rounded(co.scorecard(cohorts, rows, study))


def q_retirement(spark, folder):
    _, cohorts, _, rows = _milestones(spark, folder)
    one = cohorts.withColumn("screen_id", F.lit("screen"))
    return rounded(co.retirement(one, co.scorecard(one, rows), AS_OF))


def q_deleted_forward(spark, folder):
    _, cohorts, _ = _entered(spark, folder)
    requests = cohorts.select("cohort_id", F.lit("closed").alias("reason"))
    return co.deleted_forward(co.delete(cohorts, requests)).select(
        "screen_id", "universe_id", "n_deleted", F.array_join("reasons", ",").alias("reasons"))


END = dt.date(1996, 12, 31)


def q_equity_curves(spark, folder):
    m, cohorts, members = _entered(spark, folder)
    curves = performance.symbol_curves(cohorts, members, m)
    return rounded(performance.cohort_curves(curves, m).select(
        "cohort_id", "date", "curve", "baseline", "benchmark"))


def q_member_performance(spark, folder):
    m, cohorts, members = _entered(spark, folder)
    curves = performance.symbol_curves(cohorts, members, m)
    df = performance.member_performance(curves, line=performance.cohort_curves(curves, m))
    return rounded(df.select("cohort_id", "symbol", "share", "entry_price", "end_price", "stale",
                             "return_gross", "return_net", "excess_gross", "excess_net",
                             "contribution_gross", "max_drawdown"))


def q_performance(spark, folder):
    """Up to a past date."""
    m, cohorts, members = _entered(spark, folder)
    return rounded(performance.performance(cohorts, members, m, END))


# ---------------------------------------------------------------- quality
def _suspect(spark, folder) -> tuple[DataFrame, DataFrame]:
    """A store with faults: bad bars, repeated bars, missing symbols, splits."""
    bars = load_bars(spark, folder)
    day, month = F.dayofmonth("date"), F.month("date")
    bad = bars.select(
        "symbol", "date", "open", "high",
        F.when((day == 13) & (month == 1), 0.0).otherwise(F.col("low")).alias("low"),
        F.when((day == 20) & (month == 7), F.col("close") / 2).otherwise(F.col("close")).alias("close"),
        F.when(F.col("date") >= "1998-08-01", 0.0).otherwise(F.col("volume")).alias("volume"))
    repeated = bad.filter((day == 28) & (month == 2))
    u = load_universe(spark, folder)
    gone = u.filter(F.col("industry") == "NATION_5").select("symbol")
    return bad.unionByName(repeated).join(gone, "symbol", "left_anti"), u


def q_coverage(spark, folder):
    return rounded(quality.coverage(*_suspect(spark, folder)))


def q_missing_symbols(spark, folder):
    return quality.missing_symbols(*_suspect(spark, folder))


def _one_check(check) -> Query:
    return lambda spark, folder: rounded(check(_suspect(spark, folder)[0]))


def q_jumps(spark, folder):
    return rounded(quality.jumps(_suspect(spark, folder)[0]))


def q_benchmark_check(spark, folder):
    return rounded(quality.benchmark_check(mean_close(load_bars(spark, folder)),
                                           dt.date(1998, 12, 10)))


def q_spot_checks(spark, folder):
    return rounded(quality.indicator_spot_checks(load_bars(spark, folder)))


def _two_sources(spark, folder) -> tuple[DataFrame, DataFrame]:
    bars = load_bars(spark, folder)
    other = bars.filter(F.dayofmonth("date") > 5).withColumn(
        "close", F.col("close") * (1 + (F.dayofmonth("date") - 15) / 2000))
    return bars, other


def q_cross_source(spark, folder):
    return rounded(quality.cross_source(*_two_sources(spark, folder)))


def q_source_divergence(spark, folder):
    return rounded(quality.divergence_between(*_two_sources(spark, folder)))


def q_run_log(spark, folder):
    """Run-log lines made from orders, some truncated, some without a key."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    day = F.dayofmonth(F.to_date("o_orderdate"))
    line = F.concat(F.lit('{"ts": "'), F.to_date("o_orderdate").cast("string"),
                    F.lit('", "as_of": "latest", "spec": {}, "stats": {"matched": 1}'),
                    F.when(day == 4, F.lit("")).otherwise(F.lit(', "matched": ["A"]')),
                    F.when(day == 11, F.lit("")).otherwise(F.lit("}")))
    return quality.run_log_check(orders.select(line.alias("value")))


def q_report(spark, folder):
    prices, u = _suspect(spark, folder)
    bars, other = _two_sources(spark, folder)
    df = quality.report(prices, u, mean_close(bars), dt.date(1998, 12, 3), other)
    return df.select("check_name", "status", "bad")


def q_flagship(spark, folder):
    """Latest bars above their 200-bar average on rising volume, with the name."""
    df = sc.evaluate(market(spark, folder), FLAGSHIP)
    return rounded(sc.matches(df, None).select(
        "symbol", "name", "industry", "date", "close", "vol_ratio", "ret_3m_pct"))


def _screen_query(conditions, logic="AND") -> Query:
    return lambda spark, folder: sc.signal_bars(market(spark, folder), conditions, logic)


def _panel_query(fields) -> Query:
    return lambda spark, folder: rounded(
        panel(load_bars(spark, folder), fields).select("symbol", "date", *fields),
        decimals_of(fields))


def q_ema_gaps(spark, folder):
    """Smoothings of a close that is missing on three days of each month."""
    known = F.when(~F.dayofmonth("date").isin(3, 4, 17), F.col("close"))
    bars = load_bars(spark, folder).select("symbol", "date", known.alias("close"))
    book = ewm_steps("ema_10", "close", span_alpha(10), 10) | ewm_steps("ema_50", "close", span_alpha(50), 50)
    return rounded(add_steps(number_bars(by_symbol(bars)), book, ["ema_10", "ema_50"])
                   .select("symbol", "date", "ema_10", "ema_50"))


def q_any_width(spark, folder):
    """Widths and smoothing factors beside the usual ones."""
    book = ewm_steps("ema_5", "close", span_alpha(5), 5) | ewm_steps("ema_2", "close", span_alpha(2), 2)
    for n in (7, 33):
        book |= mean_steps(f"sma_{n}", "close", n)
    names = ("ema_5", "ema_2", "sma_7", "sma_33")
    return rounded(add_steps(number_bars(load_bars(spark, folder), 60), book, names).select("symbol", "date", *names))


def registered() -> dict[str, Query]:
    out: dict[str, Query] = {
        "flagship": q_flagship,
        "read_bars": q_read_bars,
        "clean_bars": q_clean_bars,
        "upsert_bars": q_upsert_bars,
        "replace_symbols": q_replace_symbols,
        "exchange_rows": q_exchange_rows,
        "append_days": q_append_days,
        "adjustment_factor": q_adjustment_factor,
        "corporate_actions": q_corporate_actions,
        "cumulative_factors": q_cumulative_factors,
        "adjusted_bars": q_adjusted_bars,
        "universe_index_list": q_universe_index,
        "universe_full_listing": q_universe_full,
        "universe_curated": q_universe_curated,
        "benchmark": q_benchmark,
        "benchmark_filled": q_benchmark_filled,
        "asof_join": q_asof_join,
        "store_freshness": lambda s, f: src.check_fresh(load_bars(s, f), dt.date(1998, 12, 3)),
        "deep_symbols": lambda s, f: src.deep_symbols(load_bars(s, f), 530),
        "shared_calendar": lambda s, f: calendar(load_bars(s, f)).select("date", "day"),
        "weekly_bars": lambda s, f: weekly_bars(load_bars(s, f)),
        "weekly_indicators": lambda s, f: rounded(
            weekly_panel(load_bars(s, f)).select("symbol", "date", *WEEKLY_FIELDS)),
        "pivots": q_pivots,
        "sr_levels": q_sr_levels,
        "nearest_levels": q_nearest_levels,
        "cross_section": q_cross_section,
        "breadth": q_breadth,
        "asof_universe_rows": q_asof_rows,
        "screen_match_table": q_match_table,
        "screen_shown_matches": q_shown_matches,
        "screen_top_matches": q_top_matches,
        "screen_near_misses": q_near_misses,
        "screen_stats": q_screen_stats,
        "screen_sector_gap": q_sector_gap,
        "screen_recent_bars": q_recent_bars,
        "screen_quality_flags": q_quality_flags,
        "screen_liquidity_gate": lambda s, f: sc.signal_bars(
            market(s, f), [trend("up")], gate=0.3),
        "screen_batch": q_batch,
        "screen_run_diff": q_run_diff,
        "screen_watchlist": q_watchlist,
        "evidence": q_evidence,
        "evidence_ranks": q_rank_evidence,
        "evidence_weekly": q_weekly_evidence,
        "panel_all_fields": _panel_query(DAILY_FIELDS),
        "kept_panel": q_kept_panel,
        "kept_match_table": q_kept_match_table,
        "kept_runs": q_kept_runs,
        "kept_milestones": q_kept_milestones,
        "gated_universes": q_gated_universes,
        "indicator_any_width": q_any_width,
        "forward_returns": q_forward_returns,
        "event_baseline": q_baseline,
        "daily_baseline": q_daily_baseline,
        "events": q_events,
        "horizon_stats": q_horizon_stats,
        "event_timeline": q_event_timeline,
        "bootstrap_interval": q_bootstrap,
        "sensitivity_grid": q_sensitivity,
        "sizing_candidates": q_sizing_candidates,
        "sizing_risk": _sizing("risk"),
        "sizing_inverse_vol": _sizing("inverse_vol"),
        "sizing_equal": _sizing("equal"),
        "sizing_summary": q_sizing_summary,
        "cohort_equal_weights": q_cohort_weights,
        "cohort_value_weights": q_value_weights,
        "cohort_resolve_as_of": q_resolve_as_of,
        "cohort_entry_dates": q_entry_dates,
        "cohort_member_returns": q_member_returns,
        "cohort_milestones": q_milestones,
        "cohort_freeze": q_freeze,
        "cohort_status": q_cohort_status,
        "cohort_snapshot": q_current_snapshot,
        "cohort_delete": q_delete_cohorts,
        "cohort_deleted_forward": q_deleted_forward,
        "cohort_scorecard": q_scorecard,
        "cohort_retirement": q_retirement,
        "equity_curves": q_equity_curves,
        "member_performance": q_member_performance,
        "cohort_performance": q_performance,
        "check_coverage": q_coverage,
        "check_missing_symbols": q_missing_symbols,
        "check_freshness": _one_check(lambda p: quality.freshness(p, dt.date(1998, 12, 3))),
        "check_history_depth": _one_check(quality.history_depth),
        "check_symbol_depth": _one_check(quality.symbol_depth),
        "check_bar_integrity": _one_check(quality.bar_integrity),
        "check_duplicates": _one_check(quality.duplicates),
        "check_volume_liveness": _one_check(quality.volume_liveness),
        "check_adjustment_smell": _one_check(quality.adjustment_smell),
        "check_jumps": q_jumps,
        "check_benchmark": q_benchmark_check,
        "check_spot_checks": q_spot_checks,
        "check_cross_source": q_cross_source,
        "check_source_divergence": q_source_divergence,
        "check_run_log": q_run_log,
        "check_report": q_report,
    }
    out["indicator_ema_gaps"] = q_ema_gaps
    for name, fields in INDICATORS.items():
        out[f"indicator_{name}"] = _panel_query(fields)
    for name, condition in CONDITIONS.items():
        out[f"condition_{name}"] = _screen_query([condition])
    for name in PRESETS:
        out[f"preset_{name}"] = _screen_query(preset_conditions(name))
    return out
