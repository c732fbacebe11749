"""Exact ranks and quantiles inside groups of any size.

``rank() over (partition by date ...)`` sorts a whole group in one task. Here a
group is first reduced to its distinct values with their counts (map-side), then
cut into value ranges: a value's range is a fixed, never falling function of the
value, with ranges about 1.5% wide relative to it, so a group spreads over
hundreds of tasks and has at most some 90,000 ranges whatever it holds. Ranks
are counted exactly inside each range and shifted by the exact number of rows in
the ranges below.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_SCALE, RANGES_PER_E = 8.0, 64
DAYS_A_BLOCK = 32


def value_range(value: str) -> Column:
    return F.floor(F.asinh(F.col(value) * RANGE_SCALE) * RANGES_PER_E)


def counted_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value) with ``same`` (rows holding the value), ``below`` (rows of
    the group with a smaller value) and ``total`` (rows of the group). Null
    values are left out."""
    keys = list(keys)
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias("same"))
              .withColumn("_range", value_range(value)))
    group = Window.partitionBy(*keys)
    lower = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (counts.groupBy(*keys, "_range").agg(F.sum("same").alias("_rows"))
              .select(*keys, "_range", F.sum("_rows").over(lower).alias("_shift"),
                      F.sum("_rows").over(group).alias("total")))
    inside = (Window.partitionBy(*keys, "_range").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    below = F.coalesce(F.col("_below"), F.lit(0)) + F.coalesce(F.col("_shift"), F.lit(0))
    return (counts.withColumn("_below", F.sum("same").over(inside))
            .join(shifts, [*keys, "_range"])
            .select(*keys, value, "same", below.alias("below"), "total"))


def percentile_rank() -> Column:
    """Average-tie percentile of a counted value: 100 for the largest."""
    return 100 * (F.col("below") + (F.col("same") + 1) / 2) / F.col("total")


def _cells(spans: DataFrame) -> DataFrame:
    """(_range, day) with ``_shift`` (rows that stand on the day in lower ranges) and ``total`` (in
    all). A range's changes are summed map-side, so this never holds more than days by ranges."""
    changes = (spans.select("_range", F.explode(F.array(
        F.struct("day", F.lit(1).alias("change")),
        F.struct(F.col("until").alias("day"), F.lit(-1).alias("change")))).alias("c"))
        .groupBy("_range", "c.day").agg(F.sum("c.change").alias("change")))
    by_day = Window.partitionBy("_range").orderBy("day")
    standing = changes.select("_range", "day", F.lead("day").over(by_day).alias("_next"), F.sum("change").over(
        by_day.rowsBetween(Window.unboundedPreceding, 0)).alias("_rows")).filter("_rows > 0")
    cells = standing.select("_range", "_rows", F.explode(F.sequence("day", F.col("_next") - 1)).alias("day"))
    day = Window.partitionBy("day")
    lower = day.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return cells.select("_range", "day", F.coalesce(F.sum("_rows").over(lower), F.lit(0)).alias("_shift"),
                        F.sum("_rows").over(day).alias("total"))


def standing_percentiles(spans: DataFrame, key: str, value: str, out: str, carry: Sequence[str] = ()) -> DataFrame:
    """Percentile of each row's value on its own ``day`` among all rows that stand on that day:
    (key, day, ``out``), with ``carry`` also the value and these columns of the row. A row stands
    from ``day`` to the day before ``until``; null values are left out.

    A row is shuffled once for each block of days it touches and spread over its days only where
    it is counted. Ranks are counted among the rows of one value range and day, whose cell adds
    the rows of lower ranges; the cell comes along as a row without a value, which sorts first."""
    names = {c: f"_carry{i}" for i, c in enumerate(carry)}
    known = spans.filter(F.col(value).isNotNull()).select(
        key, "day", "until", F.col(value).alias("_x"), *[F.col(c).alias(n) for c, n in names.items()])
    known = known.withColumn("_range", value_range("_x"))
    block = lambda day: F.floor(day / DAYS_A_BLOCK).cast("int")
    pieces = known.select("*", F.explode(F.sequence(block(F.col("day")), block(F.col("until") - 1))).alias("_block"))
    # only the block of a row's own day needs what it carries
    at_home = F.col("_block") == block(F.col("day"))
    pieces = pieces.withColumns({n: F.when(at_home, F.col(n)) for n in (key, *names.values())})
    cells = _cells(known).select("*", (F.col("day") + 1).alias("until"), block(F.col("day")).alias("_block"))
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pieces.unionByName(cells, allowMissingColumns=True).repartition(n, "_range", "_block")
    first = F.col("_block") * DAYS_A_BLOCK
    days = both.select(key, *names.values(), "_x", "_range", "_block", "_shift", "total", F.col("day").alias("_own"), F.explode(F.sequence(
        F.greatest("day", first), F.least(F.col("until") - 1, first + (DAYS_A_BLOCK - 1)))).alias("day"))
    order = Window.partitionBy("_range", "_block", "day").orderBy("_x")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = days.select(
        key, *names.values(), "_x", "day", "_own", F.rank().over(order).alias("_rank"), F.first("_shift").over(so_far).alias("_shift"),
        F.first("total").over(so_far).alias("total"),
        F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow)).alias("same"))
    own = counted.filter((F.col("day") == F.col("_own")) & F.col("_x").isNotNull())
    told = [F.col("_x").alias(value), *[F.col(n).alias(c) for c, n in names.items()]] if carry else []
    return own.withColumn("below", F.col("_shift") + F.col("_rank") - 2).select(
        key, "day", *told, F.bround(percentile_rank(), 2).alias(out))


def places(df: DataFrame, keys: Sequence[str], value: str, tie: str,
           out: str = "rank") -> DataFrame:
    """Add the place of each row in its group, the largest value first, equal values
    in the order of ``tie``, missing values last."""
    keys = list(keys)
    counted = counted_values(df, keys, value).select(
        *keys, value, (F.col("total") - F.col("below") - F.col("same")).alias("_ahead"))
    sizes = df.groupBy(*keys).agg(F.count(value).alias("_known"))
    equal = Window.partitionBy(*keys, value).orderBy(tie)
    return (df.join(counted, [*keys, value], "left").join(sizes, keys)
            .withColumn(out, (F.coalesce("_ahead", "_known")
                              + F.row_number().over(equal)).cast("int"))
            .drop("_ahead", "_known"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str,
              shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group; one column per entry of
    ``shares`` (column name -> share between 0 and 1)."""
    counted = counted_values(df, keys, value)
    x, first = F.col(value), F.col("below")
    last = first + F.col("same") - 1
    aggs, outs = [], []
    for name, share in shares.items():
        at = (F.col("total") - 1) * F.lit(float(share))
        lo, hi = F.floor(at), F.ceil(at)
        aggs += [F.max(F.when((first <= lo) & (lo <= last), x)).alias(f"_{name}_lo"),
                 F.max(F.when((first <= hi) & (hi <= last), x)).alias(f"_{name}_hi"),
                 F.max(at - lo).alias(f"_{name}_f")]
        a, b, f = (F.col(f"_{name}_{k}") for k in ("lo", "hi", "f"))
        outs.append((a + (b - a) * f).alias(name))
    return counted.groupBy(*keys).agg(*aggs).select(*keys, *outs)
