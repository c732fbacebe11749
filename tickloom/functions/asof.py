"""As-of alignment: the latest row at or before a date.

A calendar (the distinct dates of a store) has at most 366 rows a year, so it
may be ordered in one task and broadcast.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def calendar(df: DataFrame) -> DataFrame:
    """Distinct dates with their position ``day`` and the last position ``end``."""
    in_order = Window.orderBy("date")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select("date").distinct().select(
        "date", (F.row_number().over(in_order) - 1).alias("day"),
        (F.count(F.lit(1)).over(whole).cast("int") - 1).alias("end"))


def fill_calendar(dates: DataFrame, series: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``series`` (one row per date) carried forward onto every row of ``dates``."""
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    both = dates.select("date", F.lit(True).alias("_wanted")).join(series, "date", "full")
    filled = both.select(
        "date", "_wanted",
        *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in columns])
    return filled.filter("_wanted").drop("_wanted")


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str],
              date: str = "date") -> DataFrame:
    """For each left row the right row with the same key and the latest date at or
    before its own; right columns ``columns`` (null when there is none).

    The search runs on the distinct (key, date) pairs of both sides, so a key's
    group is bounded by the calendar however many left rows it has; the answer is
    joined back by (key, date). ``right`` holds one row per key and date."""
    keys = [*on, date]
    r = right.select(*keys, F.struct(*columns).alias("_right"))
    asked = left.select(*keys).distinct().select(
        *keys, F.lit(None).cast(r.schema["_right"].dataType).alias("_right"),
        F.lit(1).alias("_asked"))
    order = (Window.partitionBy(*on).orderBy(date, "_asked")
             .rowsBetween(Window.unboundedPreceding, 0))
    both = asked.unionByName(r.withColumn("_asked", F.lit(0)))
    found = (both.withColumn("_match", F.last("_right", ignorenulls=True).over(order))
             .filter(F.col("_asked") == 1).select(*keys, "_match"))
    return left.join(found, keys, "left").select(
        *left.columns, *[F.col(f"_match.{c}").alias(c) for c in columns])


def standing_days(next_day: Column, last_day: Column) -> Column:
    """Calendar positions a row stands for: its own up to the day before the
    symbol's next row, or to the end of the calendar for its last one."""
    return F.sequence(F.col("day"), F.coalesce(next_day - 1, last_day))


def as_of_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per calendar day and symbol: ``columns`` of the symbol's latest row
    at or before that day, with that row's ``date``; ``as_of`` is the day itself.
    Symbols that stopped trading stand with their last row."""
    days = calendar(df)
    by_date = Window.partitionBy("symbol").orderBy("date")
    placed = (df.select("symbol", "date", *columns).join(F.broadcast(days), "date")
              .withColumn("_next", F.lead("day").over(by_date)))
    grid = placed.select("symbol", "date", *columns, F.explode(
        standing_days(F.col("_next"), F.col("end"))).alias("_at"))
    return (grid.join(F.broadcast(days.select(F.col("day").alias("_at"),
                                              F.col("date").alias("as_of"))), "_at")
            .drop("_at"))
