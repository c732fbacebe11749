"""Ranks across symbols on a date, and market breadth.

On a date every symbol counts with its latest bar at or before it, also when it
no longer trades. ``with_ranks`` either ranks at every date of the history (each
bar stands for the calendar days until the symbol's next one) or, for a screen
of the latest rows, once.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.asof import calendar
from ..functions.ranks import counted_values, percentile_rank, standing_percentiles
from ..functions.steps import Step, add_steps
from ..functions.ties import exceeds
from ..functions.windows import between, lag, number_bars
from ..session import written
from .indicators import MIN_HISTORY, daily_book, pct_change

#: Leading sectors that evidence names.
LEADERS = 3


def return_step(window: int) -> Step:
    return Step(("close",), lambda: pct_change(F.col("close"), lag("close", window)))


def rank_inputs(needs: Iterable[str]) -> dict[str, Step]:
    """Steps for the values that the needed ranks compare."""
    book = {}
    for need in needs:
        kind, _, what = need.partition(":")
        if kind == "sector_rank":
            book[f"ret_{what}"] = return_step(int(what))
        elif kind == "rank" and what.startswith("ret_"):
            book[what] = return_step(int(what.removeprefix("ret_")))
    return book


def rank_values(needs: Iterable[str]) -> list[str]:
    values = {what if kind == "rank" else f"ret_{what}"
              for kind, _, what in (n.partition(":") for n in needs)
              if kind in ("rank", "sector_rank")}
    return sorted(values)


def _percentiles(standing: DataFrame, value: str) -> DataFrame:
    return counted_values(standing, ["day"], value).select(
        "day", value, F.bround(percentile_rank(), 2).alias(f"{value}_pctl"))


def _sectors(standing: DataFrame, window: int) -> DataFrame:
    """Equal-weight return of each sector on each day, ranked from the best. The
    ranking window holds one row per sector."""
    value = f"ret_{window}"
    mean = (standing.filter(F.col("industry").isNotNull()).groupBy("day", "industry")
            .agg(F.avg(value).alias("_mean")).filter(F.col("_mean").isNotNull()))
    best_first = Window.partitionBy("day").orderBy(F.desc("_mean"))
    by_name = Window.partitionBy("day").orderBy(F.desc("_mean"), "industry").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    told = F.format_string("%s (%.2f%%)", "industry", "_mean")
    return mean.select(
        "day", "industry", F.col("_mean").alias(f"sector_ret_{window}"),
        F.rank().over(best_first).alias(f"sector_rank_{window}"),
        F.count(F.lit(1)).over(Window.partitionBy("day")).alias(f"n_sectors_{window}"),
        F.array_join(F.slice(F.collect_list(told).over(by_name), 1, LEADERS), ", ").alias(f"sector_leaders_{window}"))


def standing(df: DataFrame) -> DataFrame:
    """Numbered bars with the date ``_next`` of the symbol's next one, in the order in which a panel
    is sorted already; without ``_blk``."""
    by_date = Window.partitionBy("symbol").orderBy("_blk", "date")
    return df.withColumn("_next", F.lead("date").over(by_date)).drop("_blk")


def with_ranks(df: DataFrame, needs: Iterable[str], latest: bool = False) -> DataFrame:
    """Add ``<value>_pctl`` for every ``rank:<value>`` and sector columns for every
    ``sector_rank:<window>``. ``df`` holds the values (``rank_inputs``), and
    ``industry`` for sector ranks. ``latest``: one row per symbol, one ranking; else ``df`` comes
    from ``standing``, and its rows go through the first percentile: nothing is joined back for it.
    Days are counted on the dates of ``df``: others have no row to rank."""
    needs = sorted(n for n in needs if n.startswith(("rank:", "sector_rank:")))
    if not needs:
        return df
    df = written(df)
    carried = rank_values(needs)
    if any(n.startswith("sector_rank:") for n in needs):
        carried.append("industry")
    if latest:
        placed = df.withColumn("day", F.lit(0))
        days = placed.select("day", *carried)
    else:
        days = calendar(df)
        then = days.select(F.col("date").alias("_next"), F.col("day").alias("until"))
        placed = spans = (df.join(F.broadcast(days), "date").join(F.broadcast(then), "_next", "left")
                          .withColumn("until", F.coalesce("until", F.col("end") + 1)).drop("end", "_next"))
        days = spans.select(F.explode(F.sequence("day", F.col("until") - 1)).alias("day"), *carried)
    through = False
    for need in needs:
        kind, _, what = need.partition(":")
        out = f"{what}_pctl"
        if kind != "rank":
            placed = placed.join(_sectors(days, int(what)), ["day", "industry"], "left")
        elif latest:
            placed = placed.join(_percentiles(days, what), ["day", what], "left")
        elif through:
            placed = placed.join(standing_percentiles(spans, "symbol", what, out), ["symbol", "day"], "left")
        else:
            through = True
            rest = [c for c in spans.columns if c not in ("symbol", "day", what)]
            known = standing_percentiles(spans, "symbol", what, out, rest)
            unknown = spans.filter(F.col(what).isNull()).withColumn(out, F.lit(None).cast("double"))
            placed = known.unionByName(unknown)
    return placed.drop("day", "until")


def breadth(bars: DataFrame, min_bars: int = MIN_HISTORY) -> DataFrame:
    """Per date, over the symbols trading that day: the share above their 200-bar
    average and the share at or above their previous 20 highs, each among the
    symbols with enough history for it."""
    book = daily_book()
    twenty = lambda: between(-20, -1)
    book["_prior_high"] = Step(("high",), lambda: F.when(
        F.count("high").over(twenty()) == 20, F.max("high").over(twenty())))
    df = add_steps(number_bars(bars, min_bars), book, ["sma_200", "_prior_high"])

    def share(hit, known):
        return F.avg(F.when(known.isNotNull(), F.coalesce(hit, F.lit(False)).cast("double")))

    return df.groupBy("date").agg(
        (100 * share(exceeds(F.col("close"), F.col("sma_200")), F.col("sma_200")))
        .alias("pct_above_200dma"),
        (100 * share(F.col("high") >= F.col("_prior_high"), F.col("_prior_high")))
        .alias("pct_at_20d_high"),
        F.count("sma_200").alias("n_symbols"))
