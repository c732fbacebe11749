import numpy as np
import pandas as pd
import pytest
from bars import frame
from pyspark.sql import functions as F

from tickloom.functions.folds import spaced_out
from tickloom.operators import conditions as c
from tickloom.operators import event_study as es
from tickloom.operators.screen import Market


def test_cooldown(spark):
    df = spark.sql("select transform(array(1, 2, 5, 30, 31, 60), x -> named_struct('i', x)) as a")
    kept = df.select(spaced_out(F.col("a"), "i", 20, "struct<i:int>").alias("k")).first().k
    assert [r.i for r in kept] == [1, 30, 60]
    assert df.select(spaced_out(F.filter("a", lambda x: x["i"] < 0), "i", 20, "struct<i:int>")
                     .alias("k")).first().k == []


SPIKE = {"spike": ([c.compare("close", ">", 500)], "AND")}


def spike(at, n=220):
    close = np.full(n, 100.0)
    close[at] = 1000.0
    return frame("S", close, open_=np.full(n, 99.0), high=np.maximum(close, 101), low=np.full(n, 98.0))


def test_entry_is_the_next_open(to_bars):
    got = {r.horizon: r for r in es.events(Market(to_bars(spike(150))), SPIKE).collect()}
    assert set(got) == {5, 20, 60}
    for r in got.values():
        assert r.gross == pytest.approx(100 / 99 - 1)
        assert r.net == pytest.approx(r.gross - 0.003)
        # the only symbol is its own baseline
        assert r.excess_gross == pytest.approx(0) and r.excess_net == pytest.approx(-0.003)


def test_events_near_the_end_lack_long_horizons(to_bars):
    got = {r.horizon: r.gross for r in es.events(Market(to_bars(spike(212))), SPIKE).collect()}
    assert got[5] is not None and got[20] is None and got[60] is None
    assert es.events(Market(to_bars(spike(219))), SPIKE).count() == 0


def test_baseline_by_hand(to_bars):
    a = frame("A", 100 * 1.01 ** np.arange(70))
    b = frame("B", np.full(70, 50.0))
    rows = es.baseline(Market(to_bars(a, b)), (5,)).filter(F.col("date") == F.lit(a.date[10])).collect()
    want = ((a.close[15] / a.open[11] - 1) + 0.0) / 2
    assert rows[0].baseline == pytest.approx(want)
    gated = es.baseline(Market(to_bars(a, b)), (5,), gate=8.0)
    got = gated.filter(F.col("date") == F.lit(a.date[30])).first().baseline
    assert got == pytest.approx(a.close[35] / a.open[31] - 1)


def planted(edge, seed=7):
    rng = np.random.default_rng(seed)
    frames = []
    for k in range(40):
        r = rng.normal(0, 0.01, 300)
        volume = np.full(300, 1e6)
        for at in (120, 200):
            at += int(rng.integers(0, 40))
            volume[at] = 6e6
            if edge:
                r[at + 2: at + 22] += 0.05 / 20
        frames.append(frame(f"P{k:02d}", 100 * np.exp(np.cumsum(r)), volume=volume))
    return frames


def test_planted_edge_is_found_and_noise_is_not(to_bars):
    screens = {"marker": ([c.volume_spike(3.0)], "AND")}
    stats = {}
    for edge in (True, False):
        rows = es.events(Market(to_bars(*planted(edge))), screens).cache()
        stats[edge] = {r.horizon: r for r in es.horizon_stats(rows).collect()}[20]
        assert stats[edge].n_events == 80 and not stats[edge].insufficient
        b = {r.horizon: r for r in es.bootstrap(rows, replicates=300).collect()}[20]
        again = {r.horizon: r for r in es.bootstrap(rows, replicates=300).collect()}[20]
        assert b == again
        by_date = rows.filter("horizon = 20").groupBy("signal_date").agg(F.avg("excess_net").alias("x"))
        assert b.lo5 < by_date.agg(F.avg("x")).first()[0] < b.hi95
        if edge:
            assert b.lo5 > 0
        pdf = rows.filter("horizon = 20").toPandas().excess_net
        assert stats[edge].excess_net_p5 == pytest.approx(np.percentile(pdf, 5))
        assert stats[edge].excess_net_median == pytest.approx(pdf.median())
        assert stats[edge].excess_net_worst5pct_mean == pytest.approx(
            pdf[pdf <= np.percentile(pdf, 5)].mean())
    assert stats[True].excess_gross_mean > 0.02
    assert abs(stats[False].excess_gross_mean) < 0.015


def test_too_few_events_are_not_summarised(to_bars):
    rows = es.events(Market(to_bars(spike(150))), SPIKE)
    for r in es.horizon_stats(rows).collect():
        assert r.insufficient and r.n_events == 1 and r.excess_net_mean is None


def test_sensitivity_grid(walk_bars):
    conds = [c.within("rsi", max=45)]
    grid = es.sensitivity(Market(walk_bars), conds).toPandas()
    assert sorted(grid.step) == [-2, -1, 1, 2]
    assert grid.sort_values("step").n_events.is_monotonic_increasing
    alone = es.events(Market(walk_bars), {"x": ([c.within("rsi", max=47.0)], "AND")}, (20,))
    want = alone.filter("excess_net is not null").agg(F.avg("excess_net")).first()[0]
    assert grid[grid.step == 1].mean_excess_net.iloc[0] == pytest.approx(want)
    assert pd.notna(grid.base_mean).all()


def test_draws_are_never_broadcast(spark, tmp_path):
    """They are a thousand times as many as the dates they are drawn from."""
    rows = [("s", 5, pd.Timestamp("2022-01-03").date() + pd.Timedelta(days=i), float(i % 7), float(i % 7)) for i in range(40)]
    rows = spark.createDataFrame(rows, "screen_id string, horizon int, signal_date date, excess_gross double, excess_net double")
    plans, kept = [], es.written

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    es.written = noted
    try:
        df = es.bootstrap(rows)
    finally:
        es.written = kept
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    drawn = [p for p in plans if "Generate" in p]
    assert drawn and df.count() == 1
    for plan in drawn:
        assert "BroadcastExchange" in plan and "Generate" not in plan.split("BroadcastExchange", 1)[1]
