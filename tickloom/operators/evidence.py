"""Why a condition holds or not: the observed values, as columns.

Each condition yields a map of named numbers and, where a moment in the window
matters, its date. The values are computed on every bar in the same pass as the
conditions.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import Step
from ..functions.windows import lag, trailing
from .conditions import Condition, distance_pct, width_below_steps
from .indicators import pct_change
from .screen import Market, signals


def _when(flag: str, value: str) -> Column:
    return F.when(F.col(flag), F.col(value))


def _last_hit(flag: str, value: str, n: int) -> Column:
    """``value`` of the latest bar of the window on which ``flag`` held."""
    return F.last(_when(flag, value), ignorenulls=True).over(trailing(n))


def evidence_words(c: Condition) -> dict[str, str]:
    """{name: column} of what isn't a number: sectors, and the first of two dates."""
    if c.kind == "sector":
        return {"sector": "industry"}
    if c.kind == "sector_rank":
        return {"sector": "industry", "leaders": f"sector_leaders_{c['window']}"}
    if c.kind == "divergence":
        return {"first_date": f"_{c.name}_ev_first_date"}
    return {}


def evidence_steps(c: Condition) -> tuple[dict[str, Step], dict[str, str], str | None]:
    """Steps, {value name: column}, and the column of the date (or none)."""
    n = c.name
    book: dict[str, Step] = dict(c.steps())
    names: dict[str, str] = {}

    def add(label: str, reads, build) -> str:
        col = f"_{n}_ev_{label}"
        book[col] = Step(tuple(reads), build)
        return col

    def value(label: str, reads, build) -> None:
        names[label] = add(label, reads, build)

    at = None
    k = c.kind
    if k == "compare":
        names["left"] = c["left"]
        if isinstance(c["right"], str):
            names["right"] = c["right"]
            value("gap_pct", (c["left"], c["right"]),
                  lambda: pct_change(F.col(c["left"]), F.col(c["right"])))
        else:
            value("right", ("close",), lambda: F.lit(float(c["right"])))
    elif k == "proximity":
        d = add("distance", (c["target"], c["ref"]), lambda: distance_pct(c["target"], c["ref"]))
        w = c["lookback"]
        value("min_distance_pct", (d,), lambda: F.min(d).over(trailing(w)))
        at = add("at", (d, "date"), lambda: F.min(F.struct(d, "date")).over(trailing(w))["date"])
    elif k == "trend":
        fast, slow = ("ema_20", "ema_40") if c.weekly else ("ema_50", "ema_200")
        names |= {x: x for x in ("close", fast, slow, f"{fast}_slope")}
    elif k == "support_at_ma":
        ma, w = c["ma"], c["lookback"]
        d = add("distance", ("low", ma), lambda: F.when(F.col("low") < F.col(ma), 0.0)
                .otherwise(distance_pct("low", ma)))
        hold = add("hold", ("close", ma), lambda: pct_change(F.col("close"), F.col(ma)))
        value("touch_distance_pct", (d,), lambda: F.min(d).over(trailing(w)))
        value("worst_hold_pct", (hold,), lambda: F.min(hold).over(trailing(w)))
        names["close_vs_ma_pct"] = hold
    elif k in ("cross", "threshold_cross", "candle"):
        at = add("at", (f"_{n}_hit", "date"),
                 lambda: _last_hit(f"_{n}_hit", "date", c["lookback"]))
    elif k == "gap":
        value("gap_pct", (f"_{n}_hit", "_gap_pct"),
              lambda: _last_hit(f"_{n}_hit", "_gap_pct", c["lookback"]))
        at = add("at", (f"_{n}_hit", "date"),
                 lambda: _last_hit(f"_{n}_hit", "date", c["lookback"]))
    elif k == "volume_spike":
        names["ratio"] = "vol_ratio"
    elif k == "within":
        names[c["field"]] = c["field"]
    elif k == "change":
        names["change_pct"] = f"_change_{c['field']}_{c['window']}"
    elif k == "near_support":
        names["support"] = "support"
        value("distance_pct", ("close", "support"), lambda: pct_change(F.col("close"), F.col("support")))
    elif k == "near_resistance":
        names["resistance"] = "resistance"
        value("distance_pct", ("close", "resistance"),
              lambda: 100 * (F.col("resistance") - F.col("close")) / F.col("close"))
    elif k == "breakout_resistance":
        names |= {"level": f"_resistance_{c['lookback']}_ago", "close_now": "close"}
    elif k == "rel_strength":
        w = c["window"]
        value("stock_ret_pct", ("close",), lambda: pct_change(F.col("close"), lag("close", w)))
        value("benchmark_ret_pct", ("benchmark",),
              lambda: pct_change(F.col("benchmark"), lag("benchmark", w)))
        names["relative_pct"] = f"_rel_strength_{w}"
    elif k == "persistence":
        value("window_min", (c["field"],), lambda: F.min(c["field"]).over(trailing(c["bars"])))
        value("window_max", (c["field"],), lambda: F.max(c["field"]).over(trailing(c["bars"])))
    elif k == "divergence":
        for i, which in ((1, "first"), (2, "second")):
            for part in ("price", "osc"):
                value(f"{part}_{i}", (f"{n}_pair",),
                      lambda which=which, part=part: F.col(f"{n}_pair.{which}.{part}"))
        add("first_date", (f"{n}_pair",), lambda: F.col(f"{n}_pair.first.date"))
        at = add("at", (f"{n}_pair",), lambda: F.col(f"{n}_pair.second.date"))
    elif k in ("tight_range", "flat_base"):
        names["span_pct"] = f"_span_pct_{c['bars']}"
        if k == "flat_base":
            names["pct_from_52w_high"] = "pct_from_52w_high"
    elif k == "bb_squeeze":
        book |= width_below_steps(c["lookback"])
        names["width_pct"] = "bb_width_pct"
        total, below = f"_width_n_{c['lookback']}", f"_width_below_{c['lookback']}"
        value("share_below_pct", (total, below), lambda: 100 * F.col(below) / F.nullif(
            F.col(total), F.lit(0)))
    elif k == "rs_percentile":
        r = "mom_12_1" if c["basis"] == "mom_12_1" else f"ret_{c['window']}"
        names |= {"value": r, "percentile": f"{r}_pctl"}
    elif k == "atr_pct_percentile":
        names |= {"value": "atr_pct", "percentile": "atr_pct_pctl"}
    elif k == "sector_rank":
        w = c["window"]
        names |= {"sector_rank": f"sector_rank_{w}", "n_sectors": f"n_sectors_{w}",
                  "sector_ret_pct": f"sector_ret_{w}"}
    elif k == "breadth":
        names |= {x: x for x in ("pct_above_200dma", "pct_at_20d_high")}
    elif k == "sector":
        names = {}
    return book, names, at


def explain(market: Market, conditions: Sequence[Condition], latest: bool = True) -> DataFrame:
    """symbol, date, evidence ARRAY<STRUCT<cond_id, passed, values MAP, words MAP, at DATE>>;
    values that cannot be computed are null. Those of weekly conditions are of the week whose
    Friday was the last one at or before the bar."""
    plans, extra, weekly_extra, weekly_values = [], {}, {}, {}
    keep: list[str] = []
    for c in conditions:
        book, names, at = evidence_steps(c)
        words = evidence_words(c)
        if c.weekly:
            weekly_extra |= book
            told = {f"_{c.name}_week_{label}": col for label, col in names.items()}
            names = {label: f"_{c.name}_week_{label}" for label in names}
            if at:
                told[f"_{c.name}_week_at"] = at
                at = f"_{c.name}_week_at"
            weekly_values |= told
        else:
            keep += [*names.values(), *words.values(), *([at] if at else [])]
            if not any(x.startswith(("rank:", "sector_rank:")) for x in c.needs):
                extra |= book
        plans.append((c, names, words, at))
    base = [c for c in dict.fromkeys(keep) if c not in ("close", "date", "industry")]
    df = signals(market, conditions, ["close", *base], latest=latest, extra_steps=extra,
                 weekly_steps=weekly_extra, weekly_values=weekly_values)

    def cells(columns: dict[str, str], kind: str) -> Column:
        pairs = [x for label, col in columns.items() for x in (F.lit(label), F.col(col).cast(kind))]
        return F.create_map(*pairs) if pairs else F.create_map().cast(f"map<string,{kind}>")

    return df.select("symbol", "date", F.array(*[F.struct(
        F.lit(i).alias("cond_id"), F.col(c.name).alias("passed"), cells(names, "double").alias("values"),
        cells(words, "string").alias("words"), (F.col(at) if at else F.lit(None)).cast("date").alias("at"))
        for i, (c, names, words, at) in enumerate(plans)]).alias("evidence"))
