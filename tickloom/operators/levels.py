"""Swing pivots, support and resistance levels, divergence.

A pivot is a property of its own bar and the five bars on each side, so it is
computed once per bar. A bar at position i may use the pivots from i-245 to
i-5: each bar gathers the pivot prices of that bounded frame (at most 2 x 241
numbers) and folds the sorted prices into levels. Most bars have the pivots of the
bar before and take its levels over. No join, no shuffle, and the work per bar does
not depend on the length of the history.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rolling import gather_steps
from ..functions.steps import Step
from ..functions.windows import between, lag, so_far

PIVOT_K = 5
LOOKBACK = 250
MIN_TOUCHES = 2
TOLERANCE_PCT = 1.0


def _pivot(col: str, extreme, k: int) -> Column:
    centred = between(-k, k)
    return F.coalesce((F.count(col).over(centred) == 2 * k + 1)
                      & (F.col(col) == extreme(col).over(centred)), F.lit(False))


def pivot_steps(k: int = PIVOT_K) -> dict[str, Step]:
    return {
        "pivot_high": Step(("high",), lambda: _pivot("high", F.max, k)),
        "pivot_low": Step(("low",), lambda: _pivot("low", F.min, k)),
    }


def fold_levels(prices: Column, min_touches: int, tol_pct: float) -> Column:
    """Sorted prices to an array of (level, touches): a price joins the current
    cluster while it is within ``tol_pct`` of the cluster's last member. Prices are
    added in whole millionths, so a level equals a price exactly or not at all."""
    millionths = lambda price: F.round(price * 1e6).cast("long")
    empty = F.array().cast("array<struct<level:double,touches:int>>")
    start = F.struct(
        F.lit(0).cast("long").alias("total"), F.lit(0).alias("n"),
        F.lit(None).cast("double").alias("last"), empty.alias("closed"))

    def closed_with(acc: Column) -> Column:
        level = F.struct((acc["total"] / 1e6 / acc["n"]).alias("level"), acc["n"].alias("touches"))
        return F.when(acc["n"] >= min_touches,
                      F.concat(acc["closed"], F.array(level))).otherwise(acc["closed"])

    def merge(acc: Column, price: Column) -> Column:
        joins = 100 * (price - acc["last"]) / acc["last"] <= tol_pct
        return F.when(
            joins, F.struct((acc["total"] + millionths(price)).alias("total"),
                            (acc["n"] + 1).alias("n"), price.alias("last"),
                            acc["closed"].alias("closed"))
        ).otherwise(F.struct(millionths(price).alias("total"), F.lit(1).alias("n"), price.alias("last"),
                             closed_with(acc).alias("closed")))

    return F.aggregate(prices, start, merge, closed_with)


def level_steps(k: int = PIVOT_K, lookback: int = LOOKBACK,
                min_touches: int = MIN_TOUCHES, tol_pct: float = TOLERANCE_PCT
                ) -> dict[str, Step]:
    """``levels`` (array of level, touches), ``support`` (highest level at or
    below the close) and ``resistance`` (lowest level above it)."""

    def best(keep, pick) -> Column:
        kept = F.filter("levels", lambda x: keep(x["level"], F.col("close")))
        return pick(F.transform(kept, lambda x: x["level"]))

    def changed() -> Column:
        """Bars whose pivots aren't those of the bar before: one comes in or one drops out."""
        comes, leaves = lag("_is_pivot", k), lag("_is_pivot", lookback - k + 1)
        return lag("bar_idx").isNull() | F.coalesce(comes, F.lit(False)) | F.coalesce(leaves, F.lit(False))

    # the frame i-lookback..i holds confirmed pivots from its first bar + k on
    gathered = gather_steps("_pivot_prices", {"high": "pivot_high", "low": "pivot_low"}, k, lookback - k)
    every = gathered["_pivot_prices"]
    return {
        **pivot_steps(k),
        **gathered,
        "_is_pivot": Step(("pivot_high", "pivot_low"), lambda: F.col("pivot_high") | F.col("pivot_low")),
        # a bar that the table lacks is in no frame of a bar that has all it reaches: reach 0
        "_pivots_changed": Step(("_is_pivot",), changed, 0),
        "_pivot_prices": Step((*every.reads, "_pivots_changed"), lambda: F.when(F.col("_pivots_changed"), every.build())),
        "_new_levels": Step(("_pivot_prices",), lambda: F.when(F.col("_pivot_prices").isNotNull(), fold_levels(
            F.array_sort("_pivot_prices"), min_touches, tol_pct))),
        "levels": Step(("_new_levels",), lambda: F.last("_new_levels", ignorenulls=True).over(so_far()), 0),
        "support": Step(("levels", "close"),
                        lambda: best(lambda lv, c: lv <= c, F.array_max)),
        "resistance": Step(("levels", "close"),
                           lambda: best(lambda lv, c: lv > c, F.array_min)),
    }


def divergence_steps(name: str, kind: str, oscillator: str, lookback: int,
                     k: int = PIVOT_K) -> dict[str, Step]:
    """``name``: the last two confirmed pivots of the window disagree with the
    oscillator; ``name_pair`` holds the two pivots."""
    flag, price = ("pivot_low", "low") if kind == "bullish" else ("pivot_high", "high")

    def pivots() -> Column:
        # pivots need k bars on both sides inside the window
        frame = between(-(lookback - 1 - k), -k)
        point = F.struct(F.col("bar_idx").alias("at"), F.col("date").alias("date"),
                         F.col(price).alias("price"), F.col(oscillator).alias("osc"))
        return F.collect_list(F.when(F.col(flag), point)).over(frame)

    def pair() -> Column:
        found = F.col(f"_{name}_pivots")
        return F.when(F.size(found) >= 2, F.struct(
            F.element_at(found, -2).alias("first"), F.element_at(found, -1).alias("second")))

    def disagrees() -> Column:
        a, b = F.col(f"{name}_pair.first"), F.col(f"{name}_pair.second")
        price_up, osc_up = b["price"] > a["price"], b["osc"] > a["osc"]
        price_down, osc_down = b["price"] < a["price"], b["osc"] < a["osc"]
        found = (price_down & osc_up) if kind == "bullish" else (price_up & osc_down)
        return F.coalesce((b["at"] - a["at"] >= k) & found, F.lit(False))

    return {
        **pivot_steps(k),
        f"_{name}_pivots": Step((flag, price, oscillator), pivots),
        f"{name}_pair": Step((f"_{name}_pivots",), pair),
        name: Step((f"{name}_pair",), disagrees),
    }
