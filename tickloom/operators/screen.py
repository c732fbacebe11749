"""Screens: conditions joined to a panel, matches, near misses and what follows
from them."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.asof import fill_calendar
from ..functions.steps import Step, add_steps
from ..functions.windows import number_bars, so_far
from ..session import written
from .conditions import Condition
from .cross_section import breadth, rank_inputs, standing, with_ranks
from .flags import can_tell, last_bars
from .indicators import MIN_HISTORY, daily_book, pct_change, weekly_bars, weekly_book
from .levels import level_steps


@dataclass(frozen=True)
class Market:
    """What a screen runs on. ``universe``: symbol, name, industry;
    ``benchmark``: date, close."""

    bars: DataFrame
    universe: DataFrame | None = None
    benchmark: DataFrame | None = None
    min_bars: int = MIN_HISTORY

    def until(self, as_of) -> "Market":
        """The market as it was known on a date: later bars removed. Whether a symbol has enough
        bars is judged on all it has, on this path and on that of a stored panel
        (``sources.panels``)."""
        cut = lambda df: df if df is None else df.filter(F.col("date") <= F.lit(as_of).cast("date"))  # noqa: E731,E501
        bars = cut(self.bars)
        if self.min_bars:
            deep = self.bars.groupBy("symbol").count().filter(F.col("count") >= self.min_bars)
            bars = bars.join(deep.select("symbol"), "symbol", "left_semi")
        return Market(bars.drop("bar_idx", "n_bars"), self.universe, cut(self.benchmark), 0)


def stored_market(panel: DataFrame, universe: DataFrame | None = None,
                  benchmark: DataFrame | None = None) -> Market:
    """A market over a stored panel (``stores.write_panel``): its indicators are
    read, not recomputed."""
    return Market(panel, universe, benchmark, 0)


def combine(conditions: Sequence[Condition], logic: str = "AND") -> Column:
    if logic not in ("AND", "OR"):
        raise ValueError(f"logic {logic!r}")
    flags = [F.col(c.name) for c in conditions]
    return reduce((lambda a, b: a & b) if logic == "AND" else (lambda a, b: a | b), flags)


def _with_weekly(df: DataFrame, bars: DataFrame, conditions: Sequence[Condition],
                 book: dict[str, Step] | None = None, values: Mapping[str, str] | None = None) -> DataFrame:
    """Weekly conditions as known on a daily bar: those of the symbol's latest week whose Friday
    isn't after the bar. ``values``: further columns, name -> column of the weekly panel.

    A week's row is a struct that goes through the daily partitioning as a row of its own, before
    the bars of its Friday, and stands until the next one: no join, and no second shuffle of the
    bars by symbol."""
    every = weekly_book()
    for c in conditions:
        every |= c.steps()
    every |= book or {}
    values = dict(values or {})
    names = [c.name for c in conditions]
    weeks = add_steps(number_bars(weekly_bars(bars)), every, [*names, *values.values()])
    week = F.struct(*names, *[F.col(col).alias(out) for out, col in values.items()])
    weeks = weeks.select("symbol", "date", F.lit(0).alias("_kind"), week.alias("_week"))
    rows = df.withColumn("_kind", F.lit(1)).unionByName(weeks, allowMissingColumns=True)
    so_far = (Window.partitionBy("symbol").orderBy("date", "_kind")
              .rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_week", F.last("_week", ignorenulls=True).over(so_far)).filter("_kind = 1")
    flags = [F.coalesce(F.col(f"_week.{n}"), F.lit(False)).alias(n) for n in names]
    return rows.select(*df.columns, *flags, *[F.col(f"_week.{out}").alias(out) for out in values])


def _join_context(market: Market, needs: set[str]) -> DataFrame:
    df = market.bars
    dates = market.bars.select("date").distinct()
    if "universe" in needs:
        if market.universe is None:
            raise ValueError("this screen needs a universe with sectors")
        df = df.join(market.universe.select("symbol", "industry"), "symbol", "left")
    if "benchmark" in needs:
        if market.benchmark is None:
            raise ValueError("this screen needs a benchmark")
        # one row per date: bounded by the calendar
        filled = fill_calendar(
            dates, market.benchmark.select("date", F.col("close").alias("benchmark")),
            ["benchmark"])
        df = df.join(F.broadcast(filled), "date", "left")
    if "breadth" in needs:
        gauge = breadth(market.bars, market.min_bars).select(
            "date", F.col("pct_above_200dma").alias("_breadth"), F.col("pct_at_20d_high").alias("_breadth_high"))
        df = df.join(F.broadcast(gauge), "date", "left")
    return df


def _is_ranked(c: Condition) -> bool:
    return any(n.startswith(("rank:", "sector_rank:")) for n in c.needs)


def screen_columns(conditions: Sequence[Condition], fields: Sequence[str] = (),
                   more: dict[str, Step] | None = None) -> tuple[dict[str, Step], list[str]]:
    """The steps of a screen, and the columns that it takes from the panel: plain daily
    conditions, ``fields``, and the values that ranks compare."""
    needs = set().union(*[c.needs for c in conditions])
    book = daily_book() | level_steps()
    plain = [c for c in conditions if not c.weekly and not _is_ranked(c)]
    for c in plain:
        book |= c.steps()
    book |= rank_inputs(needs)
    if "breadth" in needs:
        book["pct_above_200dma"] = Step(("_breadth",), lambda: F.last(
            "_breadth", ignorenulls=True).over(so_far()))
        book["pct_at_20d_high"] = Step(("_breadth_high",), lambda: F.last(
            "_breadth_high", ignorenulls=True).over(so_far()))
    book |= more or {}
    inputs = [n.partition(":")[2] for n in needs if n.startswith("rank:")]
    inputs += [f"ret_{n.partition(':')[2]}" for n in needs if n.startswith("sector_rank:")]
    return book, [*[c.name for c in plain], *[f for f in fields if not _reads_rank(f)], *inputs]


def signals(market: Market, conditions: Sequence[Condition], fields: Sequence[str] = (),
            steps: dict[str, Step] | None = None, latest: bool = False,
            extra_steps: dict[str, Step] | None = None, weekly_steps: dict[str, Step] | None = None,
            weekly_values: Mapping[str, str] | None = None) -> DataFrame:
    """The panel with one boolean column per condition.

    All per-symbol columns share one shuffle by symbol; ranks add a shuffle by
    (date, value). ``fields`` and the names in ``steps`` are kept as well;
    ``extra_steps`` only define what ``fields`` may name; ``weekly_values`` (name -> column of the
    weekly panel, or of ``weekly_steps``) are kept as well.
    ``latest`` keeps the last bar of each symbol."""
    conditions = list(dict.fromkeys(conditions))
    needs = set().union(*[c.needs for c in conditions])
    weekly = [c for c in conditions if c.weekly]
    ranked = [c for c in conditions if not c.weekly and _is_ranked(c)]
    steps = steps or {}
    book, wanted = screen_columns(conditions, [*fields, *steps], steps | (extra_steps or {}))

    after: dict[str, Step] = {}
    for c in ranked:
        after |= c.steps()
    df = _join_context(market, needs)
    if weekly:
        df = _with_weekly(df, market.bars, weekly, weekly_steps, weekly_values)
    keep = ["symbol", "date", "bar_idx", "n_bars", *(["industry"] if "universe" in needs else []),
            *[c.name for c in weekly], *(weekly_values or {})]
    plain = [c for c in conditions if not c.weekly and not _is_ranked(c)]
    values = [w for w in wanted if w not in {c.name for c in plain}]
    stored = {"bar_idx", "n_bars"} <= set(df.columns)
    if latest and not stored and not steps and not extra_steps and can_tell(plain, values):
        df = last_bars(df.drop("bar_idx", "n_bars"), plain, values, market.min_bars, set(df.columns) - {*keep, *wanted})
        df = df.withColumn("_blk", F.lit(0))
    else:
        df = add_steps(number_bars(df, market.min_bars), book, wanted)
        if latest:
            df = df.filter(F.col("bar_idx") == F.col("n_bars") - 1)
    df = df.select(*dict.fromkeys([*keep, *wanted]), "_blk")
    df = standing(df) if ranked and not latest else df.drop("_blk")
    df = with_ranks(df, needs, latest)
    df = add_steps(df, after, [c.name for c in ranked])
    out = ["symbol", "date", "bar_idx", "n_bars", *(["industry"] if "universe" in needs else []),
           *[c.name for c in conditions], *fields, *steps, *(weekly_values or {})]
    return df.select(*dict.fromkeys(out))


def _reads_rank(name: str) -> bool:
    """Columns that only exist once the ranks are joined."""
    return name.endswith("_pctl") or name.startswith(("sector_rank_", "n_sectors_", "sector_ret_", "sector_leaders_"))


def liquid(gate: float) -> Column:
    """The median of the last 20 turnovers reaches ``gate``; fewer bars fail."""
    if not gate:
        return F.lit(True)
    return F.coalesce(F.col("median_turnover") >= gate, F.lit(False))


def signal_bars(market: Market, conditions: Sequence[Condition], logic: str = "AND",
                gate: float = 0.0) -> DataFrame:
    """Every (symbol, date) on which the screen holds."""
    fields = ["median_turnover"] if gate else []
    df = signals(market, conditions, fields)
    return df.filter(combine(conditions, logic) & liquid(gate)).select("symbol", "date")


METRICS = ("close", "ema_50", "rsi", "adx", "vol_ratio", "atr_pct", "roc_21", "roc_63",
           "pct_from_52w_high", "median_turnover")


def evaluate(market: Market, conditions: Sequence[Condition], logic: str = "AND", as_of=None,
             gate: float = 0.0) -> DataFrame:
    """One row per symbol that passes the liquidity gate: metrics, flags, the
    number of conditions passed and whether the screen matched."""
    market = market.until(as_of) if as_of is not None else market
    df = signals(market, conditions, METRICS, latest=True).filter(liquid(gate))
    passed = reduce(lambda a, b: a + b, [F.col(c.name).cast("int") for c in conditions])
    if market.universe is not None:
        df = df.drop("industry").join(market.universe.select("symbol", "name", "industry"),
                                      "symbol", "left")
    else:
        df = df.select("*", F.lit(None).cast("string").alias("name"),
                       F.lit(None).cast("string").alias("industry"))
    return df.select(
        "symbol", "name", "industry", "date",
        passed.alias("conditions_passed"),
        F.lit(len(conditions)).alias("conditions_total"),
        combine(conditions, logic).alias("matched"),
        "close",
        pct_change(F.col("close"), F.col("ema_50")).alias("pct_vs_ema50"),
        "rsi", "adx", "vol_ratio", "atr_pct",
        F.col("roc_21").alias("ret_1m_pct"), F.col("roc_63").alias("ret_3m_pct"),
        "pct_from_52w_high", F.col("median_turnover").alias("turnover_cr"),
        *[c.name for c in conditions])


def _few(df: DataFrame) -> DataFrame:
    """The rows that are left of a panel, as files: a sort of all rows draws a sample of them first,
    and would compute the whole panel for it a second time."""
    return written(df)


def matches(evaluated: DataFrame, limit: int | None = None) -> DataFrame:
    """Matches, best three-month return first; ``limit`` is the display cap."""
    order = [F.desc_nulls_last("ret_3m_pct"), F.asc("symbol")]
    df = evaluated.filter("matched")
    return df.orderBy(*order).limit(limit) if limit else _few(df).orderBy(*order)


def near_misses(evaluated: DataFrame, limit: int | None = None) -> DataFrame:
    """Symbols that don't match and fail exactly one condition."""
    df = evaluated.filter(~F.col("matched") & (F.col("conditions_passed") == F.col("conditions_total") - 1))
    order = [F.desc("conditions_passed"), F.asc("symbol")]
    return df.orderBy(*order).limit(limit) if limit else _few(df).orderBy(*order)


# Decimals shown per metric.
DISPLAY_DECIMALS = {
    "close": 2, "pct_vs_ema50": 2, "rsi": 1, "adx": 1, "vol_ratio": 2, "atr_pct": 2,
    "ret_1m_pct": 1, "ret_3m_pct": 1, "pct_from_52w_high": 1, "turnover_cr": 1,
}


def for_display(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.bround(c, d) for c, d in DISPLAY_DECIMALS.items()
                           if c in df.columns})


def screen_stats(evaluated: DataFrame, gate: float = 0.0) -> DataFrame:
    """How many symbols there are, the liquidity gate leaves out, were evaluated, matched and
    nearly matched. ``evaluated``: ``evaluate`` without a gate."""
    near = F.col("conditions_passed") == F.col("conditions_total") - 1
    liquid = F.coalesce(F.col("turnover_cr") >= gate, F.lit(False)) if gate else F.lit(True)
    return evaluated.agg(
        F.count(F.lit(1)).alias("universe"),
        F.count_if(~liquid).alias("liquidity_excluded"),
        F.count_if(liquid).alias("evaluated"),
        F.count_if(liquid & F.col("matched")).alias("matched"),
        F.count_if(liquid & near & ~F.col("matched")).alias("near_misses"))


def sector_gap(universe: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """One row (needs_sector, symbols_with_sector, gap): a screen that needs
    sectors on a universe that has none can never match."""
    wants = any(c.kind in ("sector", "sector_rank") for c in conditions)
    return universe.agg(F.count("industry").alias("symbols_with_sector")).select(
        F.lit(wants).alias("needs_sector"), "symbols_with_sector",
        (F.lit(wants) & (F.col("symbols_with_sector") == 0)).alias("gap"))


def recent_bars(market: Market, fields: Sequence[str], bars: int = 60) -> DataFrame:
    """The last ``bars`` bars of each symbol as one sorted array of structs (60 for
    a spark line, 250 for a chart), with the series a screen refers to."""
    df = add_steps(number_bars(market.bars, market.min_bars), daily_book() | level_steps(), fields)
    recent = df.filter(F.col("bar_idx") >= F.col("n_bars") - bars)
    point = F.struct("date", *fields)
    return recent.groupBy("symbol").agg(F.array_sort(F.collect_list(point)).alias("points"))


def quality_flags(market: Market, window: int = 60, jump_pct: float = 40.0,
                  thin_bars: int = 250) -> DataFrame:
    """Per symbol: a jump inside the chart window (with its date), thin history,
    last bar older than the store's latest."""
    moved = F.abs(pct_change(F.col("close"), F.col("_prev_close")))
    df = add_steps(number_bars(market.bars, market.min_bars), daily_book(), ["_prev_close"])
    # a return inside the window needs both of its bars there
    inside = F.col("bar_idx") > F.greatest(F.col("n_bars") - window, F.lit(0))
    per_symbol = df.select("symbol", "date", "n_bars", F.when(inside, moved).alias("move")) \
        .groupBy("symbol").agg(
            F.max("move").alias("max_move"), F.max_by("date", "move").alias("at"),
            F.max("n_bars").alias("bars"), F.max("date").alias("last_bar"))
    latest = market.bars.agg(F.max("date").alias("store_latest"))
    return per_symbol.join(F.broadcast(latest), F.col("last_bar") <= F.col("store_latest")).select(
        "symbol",
        F.coalesce(F.col("max_move") > jump_pct, F.lit(False)).alias("jump"),
        F.when(F.col("max_move") > jump_pct, F.col("at")).alias("jump_date"),
        (F.col("bars") < thin_bars).alias("thin_history"),
        (F.col("last_bar") < F.col("store_latest")).alias("stale"))


# ---------------------------------------------------------------- many screens
def hits(df: DataFrame, screens: dict[str, tuple[Sequence[Condition], str]],
         columns: Sequence[str]) -> DataFrame:
    """One row per (row of ``df``, screen that holds there): the flags of all
    screens come from one pass over the panel."""
    held = F.filter(
        F.array(*[F.when(combine(conds, logic), F.lit(name))
                  for name, (conds, logic) in screens.items()]),
        lambda s: s.isNotNull())
    return df.select(*columns, F.explode(held).alias("screen_id"))


def batch(market: Market, screens: dict[str, tuple[Sequence[Condition], str]],
          previous: DataFrame | None = None, gate: float = 0.0) -> DataFrame:
    """Per screen: number of matches, the three best symbols by three-month return
    and the number of symbols new since ``previous`` (screen_id, symbol)."""
    every = [c for conds, _ in screens.values() for c in conds]
    df = signals(market, every, ["roc_63", "median_turnover"], latest=True).filter(liquid(gate))
    found = hits(df, screens, ["symbol", "roc_63"])
    if previous is not None:
        seen = previous.select("screen_id", "symbol", F.lit(1).alias("_seen"))
        found = found.join(seen, ["screen_id", "symbol"], "left")
    else:
        found = found.withColumn("_seen", F.lit(1))
    order = Window.partitionBy("screen_id").orderBy(F.desc_nulls_last("roc_63"), "symbol")
    best = (found.withColumn("_place", F.row_number().over(order)).filter("_place <= 3")
            .groupBy("screen_id").agg(F.array_sort(F.collect_list(F.struct("_place", "symbol"))).alias("_top")))
    counts = found.groupBy("screen_id").agg(F.count(F.lit(1)).alias("matched"),
                                            F.count_if(F.col("_seen").isNull()).alias("new_since_last"))
    return counts.join(best, "screen_id").select(
        "screen_id", "matched", F.col("_top.symbol").alias("top3"), "new_since_last")


def run_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Symbols that entered or left the match list. ``current``: symbol, matched and
    condition flags (``evaluate``); ``previous``: symbol. A dropped symbol lists
    the conditions it now fails; ``not_evaluated`` when it has no row any more."""
    flags = [c for c in current.columns if c.startswith("c_")]
    before = previous.select("symbol", F.lit(True).alias("_before"))
    both = current.join(before, "symbol", "full")
    now = F.coalesce("matched", F.lit(False))
    was = F.coalesce("_before", F.lit(False))
    failing = F.filter(F.array(*[F.when(~F.col(c), F.lit(c)) for c in flags]),
                       lambda x: x.isNotNull())
    return (both.filter(now != was)
            .select("symbol", F.when(now, "new").otherwise("dropped").alias("change"),
                    F.when(~now & F.col("matched").isNull(), F.array(F.lit("not_evaluated")))
                    .when(~now, failing).alias("failing")))


def watchlist(tags: DataFrame, market: Market,
              screens: dict[str, tuple[Sequence[Condition], str]]) -> DataFrame:
    """Tagged rows (screen_id, symbol, close_at_tag, ts) against the latest bars:
    current close, move since the tag, and whether the screen still holds."""
    every = [c for conds, _ in screens.values() for c in conds]
    df = signals(market, every, ["close"], latest=True)
    holds = F.map_from_arrays(
        F.array(*[F.lit(n) for n in screens]),
        F.array(*[combine(conds, logic) for conds, logic in screens.values()]))
    now = df.select("symbol", F.col("close").alias("current_close"), holds.alias("_holds"))
    return tags.join(now, "symbol", "left").select(
        *tags.columns, "current_close",
        pct_change(F.col("current_close"), F.col("close_at_tag")).alias("move_pct"),
        F.col("_holds")[F.col("screen_id")].alias("still_holds"))
