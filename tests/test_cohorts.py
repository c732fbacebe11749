import datetime as dt

import numpy as np
import pandas as pd
import pytest
from bars import frame, walk
from pyspark.sql import functions as F

from tickloom.operators import cohorts as co
from tickloom.operators import performance as pf
from tickloom.operators.screen import Market

COHORT = ("cohort_id string, screen_id string, universe_id string, mode string, anchor date, "
          "status string, entry_date date")


@pytest.fixture(scope="module")
def frames():
    return [walk(f"C{k}", 150, 20 + k) for k in range(4)] + [walk("GONE", 90, 30)]


@pytest.fixture(scope="module")
def tables(spark, frames):
    anchor = frames[0].date[60]
    cohorts = spark.createDataFrame(
        [("one", "s", "u", "forward", anchor, "pending", None),
         ("late", "s", "u", "forward", dt.date(2030, 1, 1), "pending", None),
         ("old", "s", "u", "replay", anchor, "pending", None)], COHORT)
    members = co.equal_weights(spark.createDataFrame(
        [("one", "C0"), ("one", "C1"), ("one", "GONE"), ("one", "NEVER"), ("late", "C0"), ("old", "C2")],
        "cohort_id string, symbol string"))
    return cohorts, members


def entered(tables, m):
    return co.entry_dates(*tables, m.bars)


def test_lifecycle(tables, frames, to_bars):
    m = Market(to_bars(*frames))
    cohorts = entered(tables, m).cache()
    by_id = {r.cohort_id: r for r in cohorts.collect()}
    assert by_id["one"].status == "active" and by_id["one"].entry_date == frames[0].date[61]
    assert by_id["late"].status == "pending" and by_id["late"].entry_date is None
    returns = {(r.symbol, r.horizon): r for r in co.member_returns(cohorts, tables[1], m)
               .filter("cohort_id = 'one'").collect()}
    x = frames[0]
    for h in (5, 20, 60):
        assert returns["C0", h].ret == pytest.approx(x.close[60 + h] / x.open[61] - 1)
        assert not returns["C0", h].stale
        assert returns["NEVER", h].ret is None and returns["NEVER", h].stale
    gone = frames[4]
    assert returns["GONE", 60].stale and not returns["GONE", 20].stale
    assert returns["GONE", 60].ret == pytest.approx(gone.close.iloc[-1] / gone.open[61] - 1)
    miles = co.milestones(cohorts, tables[1], m).cache()
    row = miles.filter("cohort_id = 'one' and horizon = 60").first()
    known = [returns[s, 60].ret for s in ("C0", "C1", "GONE")]
    assert row.gross == pytest.approx(np.mean(known)) and row.n_stale == 2 and row.n_symbols == 4
    assert row.excess_net == pytest.approx(row.net - row.baseline)
    # freezing twice adds nothing
    first = co.freeze(miles.limit(0), miles)
    assert first.count() == miles.count() and co.freeze(miles, miles).count() == 0
    done = {r.cohort_id: r.status for r in co.complete(cohorts, miles).collect()}
    assert done == {"one": "completed", "old": "completed", "late": "pending"}
    now = {r.cohort_id: r for r in co.current_snapshot(cohorts, tables[1], m).collect()}
    assert now["one"].n_marked == 3 and "late" not in now


def test_milestones_wait_for_the_calendar(tables, frames, to_bars):
    m = Market(to_bars(*[f.iloc[:82] for f in frames]))
    got = co.milestones(entered(tables, m), tables[1], m).filter("cohort_id = 'one'").collect()
    assert {r.horizon for r in got} == {5, 20}


def test_halving_all_prices_changes_nothing(tables, frames, to_bars):
    halved = [f.assign(**{c: f[c] / 2 for c in ("open", "high", "low", "close")}) for f in frames]
    a, b = (co.milestones(entered(tables, m), tables[1], m).orderBy("cohort_id", "horizon").toPandas()
            for m in (Market(to_bars(*frames)), Market(to_bars(*halved))))
    np.testing.assert_allclose(a[["gross", "excess_net"]], b[["gross", "excess_net"]])


def test_deletion(tables, frames, to_bars, spark):
    cohorts = entered(tables, Market(to_bars(*frames)))
    ask = spark.createDataFrame([("one", " "), ("late", ""), ("old", "x")], "cohort_id string, reason string")
    got = {r.cohort_id: r for r in co.delete(cohorts, ask).collect()}
    assert set(got) == {"one"} and got["one"].status == "active"
    ask = spark.createDataFrame([("one", "bad data")], "cohort_id string, reason string")
    after = co.delete(cohorts, ask)
    assert {r.cohort_id: r.status for r in after.collect()}["one"] == "deleted"
    assert co.deleted_forward(after).first().reasons == ["bad data"]


def test_scorecard_and_retirement(spark):
    rows = [(f"f{i}", "s", "u", "forward", dt.date(2024, 1, 1), "completed", dt.date(2024, 1, 2))
            for i in range(6)] + [("r", "s", "u", "replay", dt.date(2024, 1, 1), "completed",
                                   dt.date(2024, 1, 2))]
    cohorts = spark.createDataFrame(rows, COHORT)
    miles = spark.createDataFrame(
        [(f"f{i}", 20, 4, -0.01 * (i + 1)) for i in range(6)] + [("r", 20, 20, 0.5)],
        "cohort_id string, horizon int, n_symbols int, excess_net double")
    card = {r["mode"]: r for r in co.scorecard(cohorts, miles).collect()}
    assert card["forward"].mean_excess_net == pytest.approx(-0.035)
    assert card["replay"].mean_excess_net == pytest.approx(0.5)
    verdicts = {d: co.retirement(cohorts, co.scorecard(cohorts, miles), d).first().verdict
                for d in (dt.date(2024, 2, 1), dt.date(2024, 6, 1))}
    assert list(verdicts.values()) == ["insufficient_evidence", "retire"]
    few = co.scorecard(cohorts.filter("cohort_id in ('f0', 'f1')"), miles).first()
    assert few.insufficient and few.mean_excess_net is None
    for names, hidden in ((19, True), (20, False)):
        one = co.scorecard(cohorts.filter("cohort_id = 'r'"), miles.withColumn("n_symbols", F.lit(names))).first()
        assert one.insufficient is hidden


def test_resolve_as_of(spark, to_bars):
    bars = to_bars(frame("A", np.arange(1.0, 6)))  # Monday to Friday
    asked = spark.createDataFrame([(d,) for d in ("2022-01-01", "2022-01-04", "2022-01-07", "2022-02-01")],
                                  "d string").select(F.to_date("d").alias("as_of"))
    got = [r.resolved_as_of for r in co.resolve_as_of(asked, bars).orderBy("as_of").collect()]
    assert got == [None, dt.date(2022, 1, 4), None, None]


def test_performance(tables, frames, to_bars, spark):
    m = Market(to_bars(*frames), benchmark=to_bars(frames[3]).select("date", "close"))
    cohorts = entered(tables, m)
    got = {r.cohort_id: r for r in pf.performance(cohorts, tables[1], m).collect()}
    days = list(frames[0].date[61:])
    curves = []
    for f in (frames[0], frames[1], frames[4]):
        s = f.set_index("date").close.reindex(days).ffill()
        curves.append(100 * s / f.open[61])
    curve = sum(curves) / 3
    r = got["one"]
    assert r.n_bars == len(days)
    assert r.gross == pytest.approx(curve.iloc[-1] / 100 - 1)
    fall = curve / curve.cummax() - 1
    assert r.max_drawdown == pytest.approx(fall.min())
    rets = curve.pct_change().dropna()
    assert r.annualized_vol == pytest.approx(rets.std() * np.sqrt(252))
    assert r.sharpe == pytest.approx(rets.mean() / rets.std() * np.sqrt(252))
    closes = pd.DataFrame({f.symbol[0]: f.set_index("date").close for f in frames})
    moves = closes.pct_change(fill_method=None).mean(axis=1).reindex(days).fillna(0.0)
    moves.iloc[0] = 0.0
    assert r.excess_gross_baseline == pytest.approx(r.gross - ((1 + moves).prod() - 1))
    px = frames[3].set_index("date").close.reindex(days)
    assert r.excess_gross_benchmark == pytest.approx(r.gross - (px.iloc[-1] / px.iloc[0] - 1))
    short = pf.performance(cohorts, tables[1], m, end_date=days[30]).collect()
    assert all(x.sharpe is None for x in short)
    assert pf.performance(cohorts, tables[1], m, end_date=days[0]).count() == 0
