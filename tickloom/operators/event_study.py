"""Event studies: what followed a signal, against the universe on the same date.

The signal of bar t is known at its close, the entry is the next open, and the
return at horizon h is close[t+h] / open[t+1] - 1. All horizons, screens and
parameter variants are rows of one long table.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.folds import spaced_out
from ..functions.ranks import quantiles
from ..functions.steps import Step, add_steps
from ..functions.windows import lead, number_bars
from ..session import written
from .conditions import SENSITIVITY_STEPS, Condition
from .indicators import daily_book, pct_change
from .screen import Market, hits, liquid, signals

HORIZONS = (5, 20, 60)
COOLDOWN = 20
COST_PCT = 0.30
MIN_EVENTS = 30
GRID_HORIZON = 20
#: Modulus and multipliers of the drawn numbers.
PRIME = 2**31 - 1
MIX = (716_243_921, 391_875_437, 904_117_603)


def forward_steps(horizons: Sequence[int] = HORIZONS) -> dict[str, Step]:
    book = {"entry": Step(("open",), lambda: F.when(lead("open") > 0, lead("open")))}
    for h in horizons:
        book[f"fwd_{h}"] = Step(("close", "entry"),
                                lambda h=h: lead("close", h) / F.col("entry") - 1)
    return book


def forward_returns(market: Market, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Forward return of every bar, long: symbol, date, horizon, gross."""
    df = add_steps(number_bars(market.bars, market.min_bars), forward_steps(horizons),
                   [f"fwd_{h}" for h in horizons])
    return _by_horizon(df, horizons, "gross").select("symbol", "date", "horizon", "gross")


def _by_horizon(df: DataFrame, horizons: Sequence[int], name: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias(name))
                      for h in horizons])
    keep = [c for c in df.columns if not c.startswith("fwd_")]
    return df.select(*keep, F.explode(cells).alias("_cell")).select(
        *keep, "_cell.horizon", f"_cell.{name}")


def baseline(market: Market, horizons: Sequence[int] = HORIZONS, gate: float = 0.0) -> DataFrame:
    """Mean forward return of the liquid symbols per date and horizon: at most one
    row per calendar day and horizon."""
    df = add_steps(number_bars(market.bars, market.min_bars),
                   daily_book() | forward_steps(horizons),
                   [f"fwd_{h}" for h in horizons] + (["median_turnover"] if gate else []))
    means = df.groupBy("date").agg(*[
        F.avg(F.when(liquid(gate), F.col(f"fwd_{h}"))).alias(f"fwd_{h}") for h in horizons])
    return _by_horizon(means, horizons, "baseline").select("date", "horizon", "baseline")


def daily_baseline(market: Market, gate: float = 0.0) -> DataFrame:
    """Mean close-to-close return of the liquid symbols per date."""
    df = add_steps(number_bars(market.bars, market.min_bars), daily_book(),
                   ["_prev_close"] + (["median_turnover"] if gate else []))
    move = pct_change(F.col("close"), F.col("_prev_close")) / 100
    return df.groupBy("date").agg(F.avg(F.when(liquid(gate), move)).alias("ret"))


def _event_type(horizons: Sequence[int]) -> str:
    cells = ",".join(f"fwd_{h}:double" for h in horizons)
    return f"struct<bar_idx:int,date:date,entry:double,{cells}>"


def events(market: Market, screens: dict[str, tuple[Sequence[Condition], str]],
           horizons: Sequence[int] = HORIZONS, cooldown: int = COOLDOWN,
           cost_pct: float = COST_PCT, gate: float = 0.0) -> DataFrame:
    """Events of every screen with their returns, long: screen_id, symbol,
    signal_date, horizon, gross, net, baseline, excess_gross, excess_net.

    A signal counts when no event of the same screen and symbol lies within the
    last ``cooldown`` bars. The fold runs over one symbol's signal bars (at most
    one per calendar day), where the panel already is."""
    every = [c for conds, _ in screens.values() for c in conds]
    names = [f"fwd_{h}" for h in horizons]
    df = signals(market, every, ["median_turnover"] if gate else [],
                 steps=forward_steps(horizons)).filter(liquid(gate))
    signal = hits(df, screens, ["symbol", F.struct("bar_idx", "date", "entry", *names).alias("e")])
    kept = (signal.groupBy("symbol", "screen_id")
            .agg(F.array_sort(F.collect_list("e")).alias("_rows"))
            .select("screen_id", "symbol", F.explode(spaced_out(
                F.col("_rows"), "bar_idx", cooldown, _event_type(horizons))).alias("e"))
            .select("screen_id", "symbol", "e.*")
            .filter(F.col("entry").isNotNull()))
    rows = _by_horizon(kept, horizons, "gross")
    # the baseline holds one row per calendar day and horizon
    base = F.broadcast(baseline(market, horizons, gate))
    net = F.col("gross") - cost_pct / 100
    return rows.join(base, ["date", "horizon"], "left").select(
        "screen_id", "symbol", F.col("date").alias("signal_date"), "horizon",
        "gross", net.alias("net"), "baseline",
        (F.col("gross") - F.col("baseline")).alias("excess_gross"),
        (net - F.col("baseline")).alias("excess_net"))


def wide_events(rows: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One row per event, columns per horizon."""
    measures = ("gross", "net", "baseline", "excess_gross", "excess_net")
    return rows.groupBy("screen_id", "symbol", "signal_date").agg(*[
        F.max(F.when(F.col("horizon") == h, F.col(m))).alias(f"{m}_{h}")
        for m in measures for h in horizons])


def _complete(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("excess_gross").isNotNull() & F.col("excess_net").isNotNull())


def horizon_stats(rows: DataFrame, keys=("screen_id", "horizon"),
                  min_events: int = MIN_EVENTS) -> DataFrame:
    """Count, means, median, hit rate, tail quantiles and mean of the worst 5% per
    group; everything but the counts is null below ``min_events`` events."""
    keys = list(keys)
    measures = ("excess_gross", "excess_net")
    shares = {"p5": 0.05, "median": 0.5, "p95": 0.95}
    done = written(_complete(rows))
    long = done.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in measures])).alias("_m")
    ).select(*keys, "_m.measure", "_m.x")
    # a handful of groups: one row each
    tails = quantiles(long, [*keys, "measure"], "x", shares).groupBy(*keys).agg(*[
        F.max(F.when(F.col("measure") == m, F.col(k))).alias(f"{m}_{k}")
        for m in measures for k in shares])
    with_tails = done.join(tails, keys)
    aggs = [F.count(F.lit(1)).alias("n_events"),
            F.count_distinct("signal_date").alias("event_dates"),
            F.avg("gross").alias("event_gross_mean"), F.avg("net").alias("event_net_mean"),
            F.avg("baseline").alias("baseline_mean")]
    for m in measures:
        aggs += [F.avg(m).alias(f"{m}_mean"),
                 F.avg((F.col(m) > 0).cast("double")).alias(f"{m}_hit_rate"),
                 F.avg(F.when(F.col(m) <= F.col(f"{m}_p5"), F.col(m))).alias(f"{m}_worst5pct_mean"),
                 *[F.max(f"{m}_{k}").alias(f"{m}_{k}") for k in shares]]
    stats = with_tails.groupBy(*keys).agg(*aggs)
    enough = F.col("n_events") >= min_events
    shown = [c for c in stats.columns if c not in (*keys, "n_events", "event_dates")]
    return stats.select(*keys, "n_events", "event_dates", (~enough).alias("insufficient"),
                        *[F.when(enough, F.col(c)).alias(c) for c in shown])


def draw_of(seed: int, replicate: Column, slot: Column, n: Column) -> Column:
    """A number below n: (seed, replicate, slot) mixed by squarings modulo a prime, all
    within 63 bits, so another engine can state the same draws."""
    h = F.pmod(F.lit(seed * MIX[0]) + replicate.cast("long") * MIX[1] + slot.cast("long") * MIX[2], F.lit(PRIME))
    for m in MIX:
        h = F.pmod(h * (h + m) + m, F.lit(PRIME))
    return F.pmod(h, n).cast("int")


def bootstrap(rows: DataFrame, keys=("screen_id", "horizon"), replicates: int = 1000,
              seed: int = 42) -> DataFrame:
    """5% and 95% bounds of the mean excess, resampling whole signal dates.

    Events of a date move together, so a date is the unit: the mean per date (at
    most one row per calendar day and group) is drawn with replacement. The
    draws follow from (seed, replicate, draw number), the same on every run
    and after every retry; they are spread over tasks by replicate."""
    keys = list(keys)
    by_date = written(_complete(rows).groupBy(*keys, "signal_date")
                     .agg(F.avg("excess_net").alias("x")))
    order = Window.partitionBy(*keys).orderBy("signal_date")
    numbered = written(by_date.select(*keys, "x", (F.row_number().over(order) - 1).alias("k"),
                                      F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n")))
    means = written(resampled(numbered, keys, replicates, seed))
    return quantiles(means, keys, "mean", {"lo5": 0.05, "hi95": 0.95})


def resampled(numbered: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """The mean of each replicate: every date slot k draws one date. ``numbered``: one row per group
    and calendar day, so that side is the one to broadcast; the draws, a thousand times as many,
    stay where they are made, though Spark takes both sides for equally small."""
    tasks = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = numbered.select(*keys, "k", "n").repartition(tasks, *keys, "k")
    draws = slots.select(*keys, "n", "k", F.explode(F.sequence(
        F.lit(0), F.lit(replicates - 1))).alias("b")).select(
        *keys, "b", draw_of(seed, F.col("b"), F.col("k"), F.col("n")).alias("k"))
    return (draws.join(F.broadcast(numbered.select(*keys, "k", "x")), [*keys, "k"])
            .groupBy(*keys, "b").agg(F.avg("x").alias("mean")))


def timeline(rows: DataFrame) -> DataFrame:
    """Events per screen and month."""
    one = rows.select("screen_id", "symbol", "signal_date").distinct()
    return (one.groupBy("screen_id", F.date_format("signal_date", "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("n_events")))


def variants(conditions: Sequence[Condition], logic: str = "AND"
             ) -> dict[str, tuple[list[Condition], str]]:
    """A screen and its one-threshold-at-a-time variants: each numeric threshold
    moved by one and two steps either way. Keys read ``condition|name|step``."""
    screens = {"base": (list(conditions), logic)}
    for i, c in enumerate(conditions):
        for name, value in c.thresholds():
            for step in (-2, -1, 1, 2):
                moved = list(conditions)
                moved[i] = c.with_arg(name, value + step * SENSITIVITY_STEPS[name])
                screens[f"{i}|{name}|{step}"] = (moved, logic)
    return screens


def sensitivity(market: Market, conditions: Sequence[Condition], logic: str = "AND",
                cooldown: int = COOLDOWN, cost_pct: float = COST_PCT, gate: float = 0.0,
                min_events: int = MIN_EVENTS) -> DataFrame:
    """Grid over the thresholds of a screen at horizon 20. All variants are
    flags of one panel. A parameter is robust when every variant's mean keeps
    the sign of the base and at least a quarter of its size."""
    rows = events(market, variants(conditions, logic), (GRID_HORIZON,), cooldown, cost_pct, gate)
    cells = (_complete(rows).groupBy("screen_id")
             .agg(F.count(F.lit(1)).alias("n_events"), F.avg("excess_net").alias("mean")))
    cells = cells.withColumn("mean", F.when(F.col("n_events") >= min_events, F.col("mean")))
    # variants without a single event have no row: the list of variants is the frame
    listed = market.bars.sparkSession.createDataFrame(
        [(k, *(k.split("|") if k != "base" else (None, None, None)))
         for k in variants(conditions, logic)],
        "screen_id string, condition string, param string, step string")
    grid = listed.join(cells, "screen_id", "left")
    base = grid.filter(F.col("screen_id") == "base").select(F.col("mean").alias("base_mean"))
    varied = grid.filter(F.col("screen_id") != "base").select(
        F.col("condition").cast("int").alias("condition_index"), "param",
        F.col("step").cast("int").alias("step"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"), F.col("mean").alias("mean_excess_net"))
    one = varied.join(F.broadcast(base), F.col("step").isNotNull())
    m, b = F.col("mean_excess_net"), F.col("base_mean")
    same: Column = ((m > 0) == (b > 0)) & (F.abs(m) >= 0.25 * F.abs(b))
    group = Window.partitionBy("condition_index", "param")
    robust = (F.count(m).over(group) > 0) & b.isNotNull() & (b != 0) & (
        F.min(F.when(m.isNotNull(), F.coalesce(same, F.lit(False)))).over(group))
    return one.withColumn("robust", F.coalesce(robust, F.lit(False)))


