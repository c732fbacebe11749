"""Price bars derived from order lines: one symbol per supplier, one bar per
ship date, with integer arithmetic so that any engine gets the same bars."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import by_symbol


def _nearest(x: Column) -> Column:
    """A positive number as the nearest whole one, halves up."""
    return F.floor(x + 0.5)


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    daily = (lineitem
             .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
             .agg(F.sum(_nearest(F.col("l_extendedprice"))).alias("h"),
                  F.sum("l_quantity").cast("bigint").alias("q"))
             .withColumn("symbol", F.col("l_suppkey").cast("string")))
    h = F.col("h")
    # the sums are shuffled, not what is made of them: two numbers a bar instead of five
    moves = by_symbol(daily.select("symbol", "date", "q", "h")).select(
        "symbol", "date", "q",
        (h % 401 - 200).alias("bp"), (h % 97).alias("u"), (h % 89).alias("v"),
        F.when(h % 13 == 0, 300).when(h % 17 == 0, -300).otherwise(0).alias("gp"))
    so_far = (Window.partitionBy("symbol").orderBy("date")
              .rowsBetween(Window.unboundedPreceding, 0))
    level = moves.withColumn("cum", F.sum("bp").over(so_far))

    def cents(points):
        return _nearest(10000 * F.exp(points.cast("double") / 10000.0))

    c, o = F.col("c"), F.col("o")
    return (level
            .withColumn("c", cents(F.col("cum")))
            .withColumn("o", cents(F.col("cum") - F.col("bp") + F.col("gp")))
            .select("symbol", "date",
                    (o / 100.0).alias("open"),
                    ((F.greatest(o, c) + F.col("u")) / 100.0).alias("high"),
                    ((F.least(o, c) - F.col("v")) / 100.0).alias("low"),
                    (c / 100.0).alias("close"),
                    (F.col("q") * 1000).cast("double").alias("volume")))


def load_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bars_from_lineitem(spark.read.parquet(f"{folder}/lineitem.parquet"))


def load_universe(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier as symbol, its nation as industry (25 nations: a fixed list)."""
    supplier = spark.read.parquet(f"{folder}/supplier.parquet")
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    return (supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(F.col("s_suppkey").cast("string").alias("symbol"),
                    F.col("s_name").alias("name"), F.col("n_name").alias("industry")))


def mean_close(bars: DataFrame) -> DataFrame:
    """A benchmark: the mean close of each date."""
    return bars.groupBy("date").agg(F.avg("close").alias("close"))
