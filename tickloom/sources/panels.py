"""A panel that is kept and extended.

The store has two tables, both by month. ``panel``: bars with their indicators. ``marks``: for
each symbol and month the position of its last bar there, and all that its smoothings knew at
that bar. A bar's indicators depend on the bars of a window of fixed reach and, for smoothings,
on what was known before it. So when bars come or change, only their symbols are computed
again, from the first changed month on: the window's bars are read, the smoothings start from a
mark at or before the window, and only the months that change are written.

A screen on a past date reads the months that its longest window reaches from that date: its
reach in bars is taken from the windows of its columns, the months from the marks.
"""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.steps import reach
from ..operators.conditions import Condition
from ..operators.fields import STATES, with_states
from ..operators.indicators import MIN_HISTORY, daily_book
from ..operators.screen import Market, screen_columns
from ..schema import BARS, DAILY_FIELDS, OHLCV
from ..session import written
from .bars import clean_bars, keep_last, unique_bars
from .versions import PART, Staged, Store, Version, part_of

#: Columns of a stored panel that a screen reads beside the indicators.
FIELDS = (*DAILY_FIELDS, "median_turnover")
STATE = [*STATES.items()]
PANEL = ("symbol", "date", "bar_idx", *FIELDS)


def state_type(name: str) -> str:
    return {"y": "double", "at": "int", "seen": "bigint"}[name.split("_")[0]]



def _tidy(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(PART).sortWithinPartitions(PART, *by)


def month_of(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


class PanelStore:
    """``buckets``: parts of a month, by the symbol's hash, so that a part is some hundred MB;
    it stays the same for a store."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1):
        self.spark, self.store, self.buckets = spark, Store(spark, path), buckets
        self.reach = reach(daily_book(seeded=True), FIELDS, [*OHLCV, "_seed"])

    # ------------------------------------------------------------ reading
    def bars(self) -> DataFrame:
        return self.store.read("panel").select(*BARS.names)

    def marks(self, version: Version | None = None) -> DataFrame:
        """symbol, month, part, bar_idx (of the symbol's last bar in the month)."""
        return self.store.read("marks", version=version)

    def parts_of(self, marks: DataFrame) -> list[str]:
        """The parts of some marks: at most one per month and bucket."""
        return [r[PART] for r in marks.select(F.concat_ws(".", "month", "bucket").alias(PART)).distinct().collect()]

    def panel(self, min_bars: int = MIN_HISTORY) -> DataFrame:
        """The whole panel as ``operators.indicators.panel`` gives it."""
        version = self.store.version()
        sizes = self.marks(version).groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n_bars"))
        return (self.store.read("panel", version=version).join(sizes.filter(F.col("n_bars") >= min_bars), "symbol")
                .select(*PANEL, "n_bars"))

    def months_for(self, as_of, bars: int | None, version: Version | None = None) -> list[str]:
        """The parts that hold, for every symbol, its latest bar at or before a date and the
        ``bars`` bars before that (None: all)."""
        month = F.lit(as_of).cast("date")
        marks = self.marks(version).filter(F.col("month") <= F.date_format(month, "yyyy-MM"))
        if bars is None:
            return self.parts_of(marks)
        # the last bar of an earlier month is at or before the one asked for
        last = marks.filter(F.col("month") < F.date_format(month, "yyyy-MM")).groupBy("symbol").agg(
            (F.max("bar_idx") - bars).alias("_from"))
        return self.parts_of(marks.join(last, "symbol", "left").filter(
            F.col("bar_idx") >= F.coalesce("_from", F.lit(0))))

    def market(self, conditions: Sequence[Condition], fields: Sequence[str] = (), as_of=None,
               universe: DataFrame | None = None, benchmark: DataFrame | None = None,
               min_bars: int = MIN_HISTORY) -> Market:
        """What a screen needs to judge the latest bar of each symbol at or before a date (the
        newest of the store by default), like ``Market.until`` on the whole store: symbols with
        fewer than ``min_bars`` bars in all are left out."""
        version = self.store.version()
        marks = self.marks(version)
        if as_of is None:
            as_of = marks.agg(F.max("last_date")).first()[0]
        book, wanted = screen_columns(conditions, fields)
        bars = None if any(c.weekly for c in conditions) else reach(
            book, wanted, [*PANEL, "industry", "benchmark", "_breadth"])
        rows = (self.store.read("panel", self.months_for(as_of, bars, version), version)
                .filter(F.col("date") <= F.lit(as_of).cast("date")))
        deep = marks.groupBy("symbol").agg(F.max("bar_idx").alias("_last")).filter(F.col("_last") + 1 >= min_bars)
        sizes = rows.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n_bars")).join(deep.select("symbol"), "symbol")
        cut = benchmark if benchmark is None else benchmark.filter(F.col("date") <= F.lit(as_of).cast("date"))
        return Market(rows.join(sizes, "symbol"), universe, cut, 0)

    # ------------------------------------------------------------ writing
    def extend(self, bars: DataFrame, writer: str, number: int, whole: bool = False) -> Version:
        """Merge bars into the store, newer ones winning over the stored ones of the same day, and
        bring the panel up to date, in one commit. ``whole``: they are all that counts of their
        symbols (after an adjustment, for instance). A number that is done changes nothing."""
        version = self.store.version()
        if version.done(writer, number):
            return version
        known = bars.filter(F.col("symbol").isNotNull() & F.col("date").isNotNull())
        fresh = written(unique_bars(clean_bars(known)).select(*BARS.names))
        if "panel" not in version.schemas:
            return self._commit(self._staged(self._computed(fresh)), writer, number, version)
        marks = self.marks(version)
        changed = written(self._changed(fresh, marks, whole))
        reread = marks.join(changed, "symbol").filter(F.col("month") >= F.coalesce("_from", F.lit("")))
        old = (self.store.read("panel", self.parts_of(reread), version).select(*BARS.names, "bar_idx")
               .join(changed.select("symbol", "since", "_seed.pos"), "symbol")
               .filter(F.col("bar_idx") >= F.coalesce("pos", F.lit(0))))
        if whole:
            old = old.filter(month_of() < F.col("since"))
        both = fresh.withColumn("_batch", F.lit(1)).unionByName(
            old.select(*BARS.names).withColumn("_batch", F.lit(0)))
        rows = self._staged(self._computed(keep_last(both, "_batch").select(*BARS.names), changed))
        # a part is written whole: rows of other symbols and earlier months move along
        parts = set(rows.folders) | set(self.parts_of(marks.join(changed, "symbol").filter(F.col("month") >= F.col("since"))))
        since = changed.select("symbol", "since")
        stay = F.col("since").isNull() | (F.col("month") < F.col("since"))
        panel = (self.store.read("panel", parts, version).withColumn("month", month_of())
                 .join(since, "symbol", "left").filter(stay).withColumn(PART, part_of("date", self.buckets)))
        kept = (self.store.read("marks", parts, version).join(since, "symbol", "left").filter(stay)
                .withColumn(PART, F.concat_ws(".", "month", "bucket")))
        return self._commit(rows, writer, number, version, parts, panel, kept)

    def _staged(self, rows: DataFrame) -> Staged:
        """Computed rows in the folders of their parts, with ``_state``: written once, and the marks
        are read from there."""
        return self.store.stage(_tidy(rows.select(*PANEL, "_state", PART), "symbol", "date"))

    def _commit(self, rows: Staged, writer: str, number: int, version: Version, parts: Iterable[str] = (),
                panel: DataFrame | None = None, kept: DataFrame | None = None) -> Version:
        """``panel`` and ``kept``: rows and marks of the ``parts`` that stay as they are."""
        marks = self.store.staged(rows).filter("_state is not null").withColumn(PART, part_of("date", self.buckets)).select(
            "symbol", month_of().alias("month"), F.split_part(F.col(PART), F.lit("."), F.lit(2)).alias("bucket"),
            "bar_idx", F.col("date").alias("last_date"), F.col("_state").alias("state"), PART)
        if kept is not None:
            marks = marks.unionByName(kept.select(*marks.columns))
        # the panel's files hold the states too, but its schema does not name them
        fields = Staged(StructType([f for f in rows.schema.fields if f.name != "_state"]), rows.folders)
        stay = {} if panel is None else {"panel": _tidy(panel.select(*PANEL, PART), "symbol", "date")}
        return self.store.commit(writer, number, {"panel": (fields, parts), "marks": (_tidy(marks, "symbol"), parts)},
                                 stay, version)

    def _changed(self, fresh: DataFrame, marks: DataFrame, whole: bool) -> DataFrame:
        """symbol, since (first month that changes), _from (month to read from) and _seed."""
        since = fresh.groupBy("symbol").agg(F.min(month_of()).alias("since"))
        if whole:
            first = marks.groupBy("symbol").agg(F.min("month").alias("_first"))
            since = since.join(first, "symbol", "left").select(
                "symbol", F.least("since", F.coalesce("_first", "since")).alias("since"))
        # a symbol has one mark a month: its list is bounded by the calendar
        before = (marks.join(since, "symbol").filter(F.col("month") < F.col("since")).groupBy("symbol")
                  .agg(F.max("bar_idx").alias("_last"), F.collect_list(F.struct("bar_idx", "month")).alias("_marks")))
        start = F.array_max(F.filter("_marks", lambda m: m["bar_idx"] < F.col("_last") + 1 - self.reach))
        start = before.select("symbol", start["month"].alias("_from"))
        state = marks.select("symbol", F.col("month").alias("_from"), F.struct(
            F.col("bar_idx").alias("pos"), "state.*").alias("_seed"))
        return since.join(start, "symbol", "left").join(state, ["symbol", "_from"], "left").select(
            "symbol", "since", "_from", "_seed")

    def _computed(self, run: DataFrame, changed: DataFrame | None = None) -> DataFrame:
        """Rows of the changed months, all months without ``changed``: panel columns, part, and
        ``_state`` on the last bar of a symbol's month. ``run``: the symbols' bars from their marks on."""
        if changed is None:
            rows = with_states(run, FIELDS)
        else:
            rows = with_states(run.join(changed.select("symbol", "since", "_seed"), "symbol"), FIELDS).filter(
                month_of() >= F.col("since"))
        state = F.struct(*[F.col(c).cast(state_type(n)).alias(n) for n, c in STATE])
        return rows.select(*PANEL, F.when(F.col("_closes"), state).alias("_state"), part_of("date", self.buckets).alias(PART))
