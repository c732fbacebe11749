"""Writing: panel store, match lists, run records."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohorts import freeze
from ..operators.indicators import panel
from ..schema import DAILY_FIELDS
from .versions import PART, Store, Version


def write_panel(bars: DataFrame, table: str, buckets: int = 200, fields=DAILY_FIELDS) -> None:
    """Compute the panel once and keep it bucketed and sorted by symbol, so later
    per-symbol windows need no shuffle. Rebuild after every change of the bars."""
    (panel(bars, fields).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, "symbol").sortBy("symbol", "date").saveAsTable(table))


def write_matches(matches: DataFrame, path: str) -> None:
    """Match list as CSV."""
    flat = [c for c, t in matches.dtypes if not t.startswith(("array", "map", "struct"))]
    matches.select(*flat).write.mode("overwrite").csv(path, header=True)


def append_run(records: DataFrame, path: str) -> None:
    """Append run records (screens, backtests, allocations, tags) as JSON lines."""
    records.write.mode("append").json(path)


def run_record(evaluated: DataFrame, screen_id: str, ts, as_of) -> DataFrame:
    """One record per run: counts and, as rows of their own table, the matches."""
    return evaluated.filter("matched").select(
        F.lit(screen_id).alias("screen_id"), F.lit(ts).alias("ts"),
        F.lit(as_of).alias("as_of"), "symbol", "close")


def read_runs(spark: SparkSession, path: str, screen_id: str | None = None) -> DataFrame:
    """Run records, newest first."""
    runs = spark.read.json(path)
    if screen_id is not None:
        runs = runs.filter(F.col("screen_id") == screen_id)
    return runs.orderBy(F.desc("ts"))


# ---------------------------------------------------------------- kept in versions
def keep_run(store: Store, records: DataFrame, number: int, writer: str = "runs") -> Version:
    """Append a run's records (with ``ts``); a number that is done changes nothing."""
    return store.commit(writer, number, append={"runs": records.withColumn(
        PART, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM"))})


def kept_runs(store: Store, screen_id: str | None = None) -> DataFrame:
    runs = store.read("runs")
    return runs if screen_id is None else runs.filter(F.col("screen_id") == screen_id)


def freeze_milestones(store: Store, rows: DataFrame, number: int, writer: str = "milestones") -> Version:
    """Add the milestones (cohort_id, horizon) that aren't there yet. Rows are computed from the
    newest version, and the commit is refused if another one has come in between."""
    version = store.version()
    if "milestones" in version.schemas:
        rows = freeze(store.read("milestones", version=version), rows)
    return store.commit(writer, number, append={"milestones": rows.withColumn(PART, F.lit("all"))}, base=version)


def kept_milestones(store: Store) -> DataFrame:
    return store.read("milestones")
