from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from bars import frame

from tickloom.functions.asof import as_of_rows, asof_join, calendar
from tickloom.functions.ranks import counted_values, percentile_rank, quantiles, standing_percentiles
from tickloom.operators import conditions as c
from tickloom.operators.cross_section import breadth
from tickloom.operators.screen import Market, signal_bars, signals


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    # one group holds most rows, one value a third of them
    g = np.where(rng.random(20000) < 0.7, 0, rng.integers(1, 5, 20000))
    x = np.where(rng.random(20000) < 0.33, 0.0, rng.normal(0, 20, 20000).round(2))
    pdf = pd.DataFrame({"g": g, "x": x})
    return pdf, spark.createDataFrame(pdf)


def test_ranks_with_ties_and_hot_groups(values):
    pdf, df = values
    got = counted_values(df, ["g"], "x").withColumn("p", percentile_rank()).toPandas()
    pdf = pdf.assign(p=pdf.groupby("g").x.rank(pct=True) * 100).drop_duplicates(["g", "x"])
    both = pdf.merge(got, on=["g", "x"], suffixes=("", "_got"))
    assert len(both) == len(pdf) == len(got)
    np.testing.assert_allclose(both.p_got, both.p)


def test_exact_quantiles(values):
    pdf, df = values
    got = quantiles(df, ["g"], "x", {"a": 0.05, "b": 0.5, "c": 0.95}).toPandas().set_index("g")
    want = pdf.groupby("g").x.quantile([0.05, 0.5, 0.95]).unstack()
    np.testing.assert_allclose(got.sort_index()[["a", "b", "c"]], want.sort_index())


def sector_market(spark, to_bars):
    n, drifts = 300, {"FAST": 0.004, "SLOW": 0.0005, "DOWN": -0.003}
    frames, rows = [], []
    for sector, d in drifts.items():
        for k in range(2):
            s = f"{sector}{k}"
            frames.append(frame(s, 100 * (1 + d + k * 1e-5) ** np.arange(n)))
            rows.append((s, s, sector))
    frames.append(frame("YOUNG", 100 * 1.01 ** np.arange(61), start="2023-02-01"))
    rows.append(("YOUNG", "YOUNG", None))
    universe = spark.createDataFrame(rows, "symbol string, name string, industry string")
    return Market(to_bars(*frames), universe)


def test_sector_ranks_and_percentiles(spark, to_bars):
    m = sector_market(spark, to_bars)
    conds = [c.rs_percentile(">=", 60), c.sector_rank(63, top=1), c.sector_rank(63, bottom=1)]
    df = signals(m, conds, ["sector_rank_63", "n_sectors_63", "ret_63_pctl"], latest=True)
    got = df.toPandas().set_index("symbol")
    assert list(got.loc[["FAST0", "SLOW0", "DOWN0"], "sector_rank_63"]) == [1, 2, 3]
    assert (got.n_sectors_63.dropna() == 3).all()
    assert got.loc["FAST1", "ret_63_pctl"] == 100.0
    assert got.loc["DOWN0", "ret_63_pctl"] == pytest.approx(16.67)
    # too little history: no rank, and no condition holds
    assert pd.isna(got.loc["YOUNG", "ret_63_pctl"])
    assert not got.loc["YOUNG", [x.name for x in conds]].any()
    assert got.loc["FAST0", conds[1].name] and got.loc["DOWN0", conds[2].name]


def test_every_date_agrees_with_a_screen_of_that_date(walk_bars, walks):
    m = Market(walk_bars)
    cond = c.rs_percentile(">=", 70, window=20)
    every = {(r.symbol, r.date): r[cond.name] for r in signals(m, [cond]).collect()}
    for i in (100, 200, 319):
        d = walks.date.iloc[i]
        for r in signals(m.until(d), [cond], latest=True).collect():
            assert every[r.symbol, d] == r[cond.name]


def test_breadth(to_bars):
    up = [frame(f"U{k}", 100 * 1.002 ** np.arange(220)) for k in range(4)]
    down = [frame(f"D{k}", 100 * 0.998 ** np.arange(220)) for k in range(2)]
    row = breadth(to_bars(*up, *down)).orderBy("date").collect()
    assert row[0].pct_above_200dma is None and row[0].n_symbols == 0
    assert row[-1].pct_above_200dma == pytest.approx(66.6667, abs=1e-3)
    assert row[-1].pct_at_20d_high == pytest.approx(66.6667, abs=1e-3)


def test_stale_symbols_stand_with_their_last_row(to_bars):
    bars = to_bars(frame("A", [1.0, 2, 3, 4]), frame("B", [5.0, 6]))
    got = {(str(r.as_of), r.symbol): r.close for r in as_of_rows(bars, ["close"]).collect()}
    assert len(got) == 8
    assert got["2022-01-06", "B"] == 6 and got["2022-01-06", "A"] == 4
    assert [r.day for r in calendar(bars).orderBy("date").collect()] == [0, 1, 2, 3]


def test_asof_join(spark):
    left = spark.sql("""select * from values ('a', date '2020-01-05', 1), ('a', date '2020-01-01', 2),
        ('b', date '2020-01-09', 3) as t(k, date, id)""")
    right = spark.sql("""select * from values ('a', date '2020-01-02', 10.0), ('a', date '2020-01-05', 20.0),
        ('c', date '2020-01-01', 30.0) as t(k, date, v)""")
    got = {r.id: r.v for r in asof_join(left, right, ["k"], ["v"]).collect()}
    assert got[1] == 20 and got[2] is None and got[3] is None


def test_percentiles_among_standing_rows(spark):
    """Held to a plain count over all rows of a day, with ties, nulls and spans over many blocks."""
    rng = np.random.default_rng(5)
    rows = []
    for s in range(60):
        days = np.sort(rng.choice(150, rng.integers(1, 20), replace=False))
        for i, d in enumerate(days):
            until = int(days[i + 1]) if i + 1 < len(days) else 150
            x = None if rng.random() < 0.1 else float(np.round(rng.normal(0, 3), 1))
            rows.append((f"S{s}", int(d), until, x))
    df = spark.createDataFrame(rows, "symbol string, day int, until int, x double")
    out = standing_percentiles(df, "symbol", "x", "pctl")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # one shuffle of the rows, and no join back by value: the rest of the plan holds days by ranges
    assert "Join" not in plan
    got = {(r.symbol, r.day): r.pctl for r in out.collect()}
    want = {}
    for s, d, _, x in rows:
        if x is not None:
            there = [y for _, a, b, y in rows if a <= d < b and y is not None]
            below, same = sum(y < x for y in there), sum(y == x for y in there)
            want[s, d] = float(round(Decimal(100 * (below + (same + 1) / 2) / len(there)), 2))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 0.0101 for k in want)
    assert sum(got[k] == want[k] for k in want) > 0.98 * len(want)


def test_rows_go_through_their_rank(spark, walk_bars):
    """A screen on one percentile joins nothing back by symbol and shuffles no bars for the calendar."""
    df = signal_bars(Market(walk_bars), [c.rs_percentile(">=", 60), c.within("pct_from_52w_high", min=-5)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert "hashpartitioning(symbol" not in plan


def test_rows_without_a_value_keep_their_place(spark, walk_bars):
    got = signals(Market(walk_bars), [c.rs_percentile(">=", 60)], ["close"])
    assert got.count() == walk_bars.count()
    assert got.filter("c_rs_percentile_op_gte_value_60_0_window_63_0_basis_return is null").count() == 0
