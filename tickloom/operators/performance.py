"""Equity curves and risk of cohorts between entry and an end date.

Curves are long tables (cohort, symbol, date): every window below groups one
curve, at most one row per trading day.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.asof import calendar, standing_days
from .cohorts import ACTIVE, COMPLETED, member_entries
from .event_study import COST_PCT, daily_baseline
from .screen import Market

MIN_BARS_FOR_SHARPE = 60


def evaluation_window(cohorts: DataFrame, market: Market, end_date=None) -> DataFrame:
    """Entered cohorts with the calendar positions of entry and end (the last trading
    day at or before ``end_date``); none without a day after entry."""
    days = calendar(market.bars)
    upto = days if end_date is None else days.filter(F.col("date") <= F.lit(end_date).cast("date"))
    last = upto.agg(F.max("date").alias("end_date"), F.max("day").alias("end_day"))
    live = cohorts.filter(F.col("entry_date").isNotNull()
                          & F.col("status").isin(ACTIVE, COMPLETED))
    # the cohort's day is the first trading day at or after its entry date
    start = F.broadcast(days.select(F.col("date").alias("entry_date"), F.col("day").alias("start_day")))
    return (live.select("cohort_id", "entry_date").join(start, "entry_date")
            .join(F.broadcast(last), F.col("end_date") > F.col("entry_date"))
            .withColumn("n_bars", F.col("end_day") - F.col("start_day") + 1))


def symbol_curves(cohorts: DataFrame, members: DataFrame, market: Market,
                  end_date=None) -> DataFrame:
    """100 close / entry price per member and trading day, carried over missing days;
    ``stale`` where the symbol's last bar lies before the end."""
    window = evaluation_window(cohorts, market, end_date)
    entries = member_entries(cohorts, members, market, (1,)).filter(
        F.col("entry_price").isNotNull())
    held = entries.select("cohort_id", "symbol", "weight", "entry_price", "_last_date").join(
        window, "cohort_id")
    days = calendar(market.bars).select("date", "day")
    placed = market.bars.select("symbol", "date", "close").filter(
        F.col("close").isNotNull()).join(F.broadcast(days), "date")
    by_date = Window.partitionBy("symbol").orderBy("date")
    spans = placed.withColumn("next_day", F.lead("day").over(by_date))
    rows = held.join(spans, "symbol").filter(
        (F.col("day") >= F.col("start_day")) & (F.col("day") <= F.col("end_day")))
    until = F.least(F.col("next_day"), F.col("end_day") + 1)
    filled = rows.select(
        "cohort_id", "symbol", "weight", "entry_price", "n_bars", "start_day", "end_day",
        "close", (F.col("_last_date") < F.col("end_date")).alias("stale"),
        F.explode(standing_days(until, F.col("end_day"))).alias("at"))
    return filled.select("*", (100 * F.col("close") / F.col("entry_price")).alias("curve"))


def drawdowns(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Largest fall from a running peak, with the days of peak and trough (the first
    ones where several tie)."""
    so_far = (Window.partitionBy(*keys).orderBy("at")
              .rowsBetween(Window.unboundedPreceding, 0))
    peak = F.max(F.struct("curve", (-F.col("at")).alias("before"))).over(so_far)
    df = curves.withColumn("_peak", peak).withColumn(
        "_dd", F.col("curve") / F.col("_peak.curve") - 1)
    worst = F.min(F.struct(F.col("_dd").alias("dd"), F.col("at").alias("at"),
                           (-F.col("_peak.before")).alias("peak")))
    return df.groupBy(*keys).agg(worst.alias("_w")).select(
        *keys, F.col("_w.dd").alias("max_drawdown"), F.col("_w.peak").alias("peak_day"),
        F.col("_w.at").alias("trough_day"))


def member_performance(curves: DataFrame, cost_pct: float = COST_PCT, line: DataFrame | None = None) -> DataFrame:
    """Per member: end price, return, renormalised weight, contribution, drawdown; with the
    cohorts' ``line`` (``cohort_curves``) also the return beyond the baseline's, gross and net of
    the costs that both bear."""
    end = curves.filter(F.col("at") == F.col("end_day"))
    total = Window.partitionBy("cohort_id")
    share = F.col("weight") / F.nullif(F.sum("weight").over(total), F.lit(0.0))
    gross = F.col("curve") / 100 - 1
    rows = end.select("cohort_id", "symbol", "weight", share.alias("share"), "entry_price",
                      F.col("close").alias("end_price"), "stale", gross.alias("return_gross"),
                      (gross - cost_pct / 100).alias("return_net"))
    if line is not None:
        base = line.filter(F.col("at") == F.col("end_day")).select(
            "cohort_id", (F.col("baseline") / 100 - 1).alias("_base"))
        rows = rows.join(base, "cohort_id", "left").select(
            *rows.columns, (F.col("return_gross") - F.col("_base")).alias("excess_gross"),
            (F.col("return_net") - (F.col("_base") - cost_pct / 100)).alias("excess_net"))
    falls = drawdowns(curves, ["cohort_id", "symbol"])
    return rows.join(falls, ["cohort_id", "symbol"]).withColumn(
        "contribution_gross", F.col("share") * F.col("return_gross"))


def cohort_curves(curves: DataFrame, market: Market, gate: float = 0.0) -> DataFrame:
    """Per cohort and trading day: the weighted curve, the baseline compounded from
    the day after entry, and the benchmark rebased to 100."""
    days = F.broadcast(calendar(market.bars).select(F.col("day").alias("at"), "date"))
    line = curves.groupBy("cohort_id", "at", "start_day", "end_day", "n_bars").agg(
        (F.sum(F.col("weight") * F.col("curve")) / F.nullif(F.sum("weight"), F.lit(0.0)))
        .alias("curve")).join(days, "at")
    # one row per calendar day
    base = F.broadcast(daily_baseline(market, gate))
    so_far = (Window.partitionBy("cohort_id").orderBy("at")
              .rowsBetween(Window.unboundedPreceding, 0))
    move = F.when(F.col("at") == F.col("start_day"), 0.0).otherwise(F.coalesce("ret", F.lit(0.0)))
    df = line.join(base, "date", "left").withColumn(
        "baseline", 100 * F.exp(F.sum(F.log1p(move)).over(so_far))).drop("ret")
    if market.benchmark is None:
        return df.withColumn("benchmark", F.lit(None).cast("double"))
    # one row per date whatever the table repeats: bounded by the calendar
    index = F.broadcast(market.benchmark.groupBy("date").agg(F.max("close").alias("_px")))
    whole = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = F.coalesce(F.last("_px", ignorenulls=True).over(so_far),
                         F.first("_px", ignorenulls=True).over(whole))
    first = F.first("_px", ignorenulls=True).over(whole)
    return df.join(index, "date", "left").withColumn("benchmark", 100 * carried / first).drop("_px")


def performance(cohorts: DataFrame, members: DataFrame, market: Market, end_date=None,
                gate: float = 0.0, cost_pct: float = COST_PCT) -> DataFrame:
    """One row per cohort: returns against baseline and benchmark, volatility, Sharpe
    ratio (from 60 bars on), drawdown and hit rates."""
    curves = symbol_curves(cohorts, members, market, end_date)
    line = cohort_curves(curves, market, gate)
    by_day = Window.partitionBy("cohort_id").orderBy("at")
    moves = line.withColumn("_r", F.col("curve") / F.lag("curve").over(by_day) - 1)
    at_end = F.col("at") == F.col("end_day")
    ends = moves.groupBy("cohort_id", "n_bars").agg(
        *[F.max(F.when(at_end, F.col(c))).alias(f"_{c}") for c in ("curve", "baseline", "benchmark")],
        F.stddev_samp("_r").alias("_sd"), F.avg("_r").alias("_mean"))
    gross, base, index = (F.col(f"_{c}") / 100 - 1 for c in ("curve", "baseline", "benchmark"))
    cost = cost_pct / 100
    parts = member_performance(curves, cost_pct).select("cohort_id", "return_gross").join(
        ends.select("cohort_id", base.alias("_base")), "cohort_id")
    rates = parts.groupBy("cohort_id").agg(
        F.avg((F.col("return_gross") > 0).cast("double")).alias("hit_rate_positive"),
        F.avg((F.col("return_gross") > F.col("_base")).cast("double")).alias("hit_rate_vs_baseline"))
    year = math.sqrt(252)
    sharpe = F.when(F.col("n_bars") >= MIN_BARS_FOR_SHARPE,
                    F.col("_mean") / F.nullif(F.col("_sd"), F.lit(0.0)) * year)
    return (ends.join(drawdowns(line, ["cohort_id"]), "cohort_id").join(rates, "cohort_id")
            .select("cohort_id", "n_bars", gross.alias("gross"), (gross - cost).alias("net"),
                    (gross - base).alias("excess_gross_baseline"),
                    (gross - base).alias("excess_net_baseline"),
                    (gross - index).alias("excess_gross_benchmark"),
                    (gross - index).alias("excess_net_benchmark"),
                    (F.col("_sd") * year).alias("annualized_vol"), sharpe.alias("sharpe"),
                    "max_drawdown", "peak_day", "trough_day",
                    "hit_rate_positive", "hit_rate_vs_baseline"))
