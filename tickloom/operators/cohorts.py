"""Frozen cohorts followed out of sample.

``cohorts``: cohort_id, screen_id, universe_id, mode (forward or replay), anchor
DATE (creation date, or the as-of date of a replay), status, entry_date.
``members``: cohort_id, symbol, weight. ``milestones``: written once per
(cohort_id, horizon).
"""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.asof import calendar
from ..functions.steps import Step, add_steps
from ..functions.windows import lead, number_bars
from .event_study import COST_PCT, HORIZONS, baseline
from .screen import Market

FORWARD, REPLAY = "forward", "replay"
PENDING, ACTIVE, COMPLETED, DELETED = "pending", "active", "completed", "deleted"

# Evidence thresholds.
MIN_NAMES = 20
MIN_RETIREMENT_COHORTS = 6
MIN_RETIREMENT_DAYS = 90
RETIREMENT_HORIZON = 20
HIT_RATE_FLOOR = 0.45


def equal_weights(members: DataFrame) -> DataFrame:
    sizes = members.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("_n"))
    return members.join(sizes, "cohort_id").withColumn(
        "weight", F.bround(1.0 / F.col("_n"), 6)).drop("_n")


def value_weights(members: DataFrame) -> DataFrame:
    """Share of the tracked value; ``members`` carry ``value``."""
    totals = members.groupBy("cohort_id").agg(F.sum("value").alias("_total"))
    return members.join(totals, "cohort_id").withColumn(
        "weight", F.bround(F.col("value") / F.nullif(F.col("_total"), F.lit(0.0)), 6)
    ).drop("_total")


def resolve_as_of(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """Requested ``as_of`` dates moved back to a trading day; null where the date
    lies before the store or leaves no later bar. The list of trading days is
    one array, bounded by the calendar."""
    days = bars.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("_days"))
    before = F.filter("_days", lambda d: d <= F.col("as_of"))
    usable = (F.size(before) > 0) & (F.size(before) < F.size("_days"))
    joined = requests.join(F.broadcast(days), F.size("_days") > 0)
    return joined.select(*requests.columns,
                         F.when(usable, F.element_at(before, -1)).alias("resolved_as_of"))


def entry_dates(cohorts: DataFrame, members: DataFrame, bars: DataFrame) -> DataFrame:
    """First date after the anchor on which any member trades. Each member looks
    into its symbol's own date list (one entry per trading day)."""
    days = bars.groupBy("symbol").agg(F.collect_list("date").alias("_days"))
    later = F.array_min(F.filter("_days", lambda d: d > F.col("anchor")))
    first = (members.select("cohort_id", "symbol")
             .join(cohorts.select("cohort_id", "anchor"), "cohort_id")
             .join(days, "symbol")
             .select("cohort_id", later.alias("_entry"))
             .groupBy("cohort_id").agg(F.min("_entry").alias("_entry")))
    joined = cohorts.join(first, "cohort_id", "left")
    pending = F.col("status") == PENDING
    resolved = joined.withColumn("entry_date", F.when(pending, F.col("_entry"))
                                 .otherwise(F.col("entry_date")))
    return resolved.withColumn("status", F.when(
        pending & F.col("entry_date").isNotNull(), ACTIVE).otherwise(F.col("status"))
    ).drop("_entry")


def _entry_rows(market: Market, horizons: Sequence[int]) -> DataFrame:
    """Per bar what a position entered at its open sees: the closes h-1 bars on,
    and whether a bar came before (the signal bar)."""
    book = {f"_exit_{h}": Step(("close",), lambda h=h: (
        lead("close", h - 1) if h > 1 else F.col("close"))) for h in horizons}
    df = add_steps(number_bars(market.bars, market.min_bars), book, list(book))
    return df.select("symbol", F.col("date").alias("entry_date"), "bar_idx", "open",
                     *book)


def _last_closes(market: Market) -> DataFrame:
    bars = market.bars.groupBy("symbol").agg(
        F.max_by("close", "date").alias("_last_close"), F.max("date").alias("_last_date"),
        F.count(F.lit(1)).alias("_bars"))
    return bars.filter(F.col("_bars") >= market.min_bars).drop("_bars")


def member_entries(cohorts: DataFrame, members: DataFrame, market: Market,
                   horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Members of entered cohorts with their entry price and exit closes."""
    live = cohorts.filter(F.col("entry_date").isNotNull()
                          & F.col("status").isin(ACTIVE, COMPLETED))
    rows = members.join(live.select("cohort_id", "entry_date"), "cohort_id")
    joined = (rows.join(_last_closes(market), "symbol", "left")
              .join(_entry_rows(market, horizons), ["symbol", "entry_date"], "left"))
    entered = (F.col("bar_idx") > 0) & (F.col("open") > 0)
    return joined.withColumn("entry_price", F.when(entered, F.col("open"))) \
        .withColumn("has_prices", F.col("_last_date").isNotNull())


def member_returns(cohorts: DataFrame, members: DataFrame, market: Market,
                   horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Return per member and horizon. A symbol that stopped trading exits at its
    last close and is marked stale, as is one without any prices."""
    df = member_entries(cohorts, members, market, horizons)
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_exit_{h}").alias("exit"))
                      for h in horizons])
    long = df.select("*", F.explode(cells).alias("_c"))
    price = F.coalesce("_c.exit", "_last_close")
    early = F.col("entry_price").isNotNull() & F.col("_c.exit").isNull() \
        & F.col("_last_close").isNotNull()
    return long.select("cohort_id", "symbol", "weight", "entry_date", "_c.horizon",
                       (price / F.col("entry_price") - 1).alias("ret"),
                       (early | ~F.col("has_prices")).alias("stale"))


def _weighted(value: str = "ret") -> Column:
    known = F.col(value).isNotNull()
    weights = F.sum(F.when(known, F.col("weight")))
    return F.sum(F.when(known, F.col("weight") * F.col(value))) / F.nullif(weights, F.lit(0.0))


def milestones(cohorts: DataFrame, members: DataFrame, market: Market, gate: float = 0.0,
               horizons: Sequence[int] = HORIZONS, cost_pct: float = COST_PCT) -> DataFrame:
    """Weighted cohort return per horizon the shared calendar has reached, against
    the baseline of the signal date (the trading day before entry)."""
    days = calendar(market.bars)
    signal_day = days.select((F.col("day") + 1).alias("day"), F.col("date").alias("signal_date"))
    placed = F.broadcast(days.join(signal_day, "day", "left")
                         .select(F.col("date").alias("entry_date"), "day", "end", "signal_date"))
    rows = member_returns(cohorts, members, market, horizons)
    totals = rows.groupBy("cohort_id", "entry_date", "horizon").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.count_if("stale").alias("n_stale"),
        _weighted().alias("gross"))
    base = baseline(market, horizons, gate).withColumnRenamed("date", "signal_date")
    joined = (totals.join(placed, "entry_date")
              .filter(F.col("day") - 1 + F.col("horizon") <= F.col("end"))
              .join(F.broadcast(base), ["signal_date", "horizon"], "left"))
    net = F.col("gross") - cost_pct / 100
    return joined.select("cohort_id", "horizon", "n_symbols", "n_stale", "gross",
                         net.alias("net"), "baseline",
                         (F.col("gross") - F.col("baseline")).alias("excess_gross"),
                         (net - F.col("baseline")).alias("excess_net"))


def freeze(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Milestones to append: those not written before. Stored ones never change."""
    return computed.join(stored.select("cohort_id", "horizon"), ["cohort_id", "horizon"],
                         "left_anti")


def complete(cohorts: DataFrame, frozen: DataFrame,
             horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Cohorts whose last milestone is frozen are completed."""
    done = (frozen.filter(F.col("horizon") == max(horizons)).select("cohort_id").distinct()
            .withColumn("_done", F.lit(True)))
    return cohorts.join(done, "cohort_id", "left").withColumn("status", F.when(
        F.col("_done") & (F.col("status") == ACTIVE), COMPLETED).otherwise(F.col("status"))
    ).drop("_done")


def current_snapshot(cohorts: DataFrame, members: DataFrame, market: Market,
                     cost_pct: float = COST_PCT) -> DataFrame:
    """Mark to market at each member's latest close; never frozen."""
    df = member_entries(cohorts, members, market, (1,))
    df = df.withColumn("ret", F.col("_last_close") / F.col("entry_price") - 1)
    gross = _weighted()
    return df.groupBy("cohort_id").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.count("ret").alias("n_marked"),
        gross.alias("gross"), (gross - cost_pct / 100).alias("net"))


def delete(cohorts: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply deletion ``requests`` (cohort_id, reason). Replays and pending cohorts
    disappear; a forward cohort past its entry is kept as deleted and needs a
    reason, else nothing happens."""
    asked = requests.select("cohort_id", F.nullif(F.trim("reason"), F.lit("")).alias("_reason"),
                            F.lit(True).alias("_asked"))
    df = cohorts.join(asked, "cohort_id", "left")
    wanted = F.coalesce("_asked", F.lit(False)) & (F.col("status") != DELETED)
    erase = wanted & ((F.col("mode") == REPLAY) | (F.col("status") == PENDING))
    bury = wanted & ~erase & F.col("_reason").isNotNull()
    kept = df.filter(~erase)
    old = F.col("delete_reason") if "delete_reason" in cohorts.columns \
        else F.lit(None).cast("string")
    return kept.select(
        *[c for c in cohorts.columns if c not in ("status", "delete_reason")],
        F.when(bury, DELETED).otherwise(F.col("status")).alias("status"),
        F.when(bury, F.col("_reason")).otherwise(old).alias("delete_reason"))


def scorecard(cohorts: DataFrame, frozen: DataFrame, backtests: DataFrame | None = None,
              min_names: int = MIN_NAMES) -> DataFrame:
    """Out-of-sample record per screen, universe, mode and horizon: forward and
    replay cohorts never mix. Below ``min_names`` names the means are null.
    ``backtests`` (screen_id, universe_id, horizon, ts, mean) adds the latest
    in-sample mean of the same screen and universe."""
    live = cohorts.filter(F.col("status") != DELETED)
    keys = ["screen_id", "universe_id", "mode", "horizon"]
    rows = frozen.join(live.select("cohort_id", "screen_id", "universe_id", "mode"), "cohort_id")
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cohorts"), F.sum("n_symbols").alias("n_names"),
        F.count("excess_net").alias("_known"),
        F.avg("excess_net").alias("mean_excess_net"),
        F.percentile("excess_net", F.lit(0.5)).alias("median_excess_net"),
        F.avg((F.col("excess_net") > 0).cast("double")).alias("hit_rate"))
    enough = (F.col("n_names") >= min_names) & (F.col("_known") > 0)
    out = stats.select(*keys, "n_cohorts", "n_names", (~enough).alias("insufficient"),
                       *[F.when(enough, F.col(c)).alias(c) for c in
                         ("mean_excess_net", "median_excess_net", "hit_rate")])
    if backtests is None:
        return out
    latest = backtests.groupBy("screen_id", "universe_id", "horizon").agg(
        F.max_by("mean", "ts").alias("in_sample_mean"))
    return out.join(latest, ["screen_id", "universe_id", "horizon"], "left")


def deleted_forward(cohorts: DataFrame) -> DataFrame:
    """Deleted forward cohorts stay counted, with their reasons."""
    gone = cohorts.filter((F.col("status") == DELETED) & (F.col("mode") == FORWARD))
    return gone.groupBy("screen_id", "universe_id").agg(
        F.count(F.lit(1)).alias("n_deleted"),
        F.array_sort(F.collect_set("delete_reason")).alias("reasons"))


def retirement(cohorts: DataFrame, card: DataFrame, as_of: dt.date,
               horizon: int = RETIREMENT_HORIZON) -> DataFrame:
    """Verdict per screen: retire when enough forward evidence shows a negative mean
    or a hit rate below the floor."""
    live = cohorts.filter((F.col("mode") == FORWARD) & (F.col("status") != DELETED))
    seen = live.groupBy("screen_id", "universe_id").agg(
        F.count(F.lit(1)).alias("n_cohorts"),
        F.date_diff(F.lit(as_of), F.min("entry_date")).alias("days_elapsed"))
    at = card.filter((F.col("mode") == FORWARD) & (F.col("horizon") == horizon)).select(
        "screen_id", "universe_id", "insufficient", "mean_excess_net", "hit_rate")
    eligible = F.coalesce((F.col("n_cohorts") >= MIN_RETIREMENT_COHORTS)
                          & (F.col("days_elapsed") >= MIN_RETIREMENT_DAYS), F.lit(False))
    fails = (F.col("mean_excess_net") < 0) | (F.col("hit_rate") < HIT_RATE_FLOOR)
    judged = eligible & ~F.coalesce("insufficient", F.lit(True))
    return seen.join(at, ["screen_id", "universe_id"], "left").select(
        "screen_id", "universe_id", "n_cohorts", "days_elapsed", eligible.alias("eligible"),
        F.when(~judged, "insufficient_evidence").when(fails, "retire").otherwise("retain")
        .alias("verdict"),
        F.when(judged, F.col("mean_excess_net")).alias("mean_excess_net"),
        F.when(judged, F.col("hit_rate")).alias("hit_rate"))


