"""A kept panel equals one that is built anew; versions are whole or not there."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from bars import walk
from pyspark.sql import functions as F

from tickloom.operators import conditions as c
from tickloom.operators.indicators import panel
from tickloom.operators.screen import Market, evaluate
from tickloom.schema import BARS
from tickloom.sources import stores
from tickloom.sources.panels import FIELDS, PanelStore
from tickloom.sources.versions import Conflict, Store


def made():
    """Symbols that trade daily, seldom, since lately, no longer, and with missing values."""
    daily = [walk(f"D{i}", 700, i) for i in range(3)]
    seldom = walk("SELDOM", 900, 10).iloc[::4]
    new = walk("NEW", 700, 11).iloc[620:]
    gone = walk("GONE", 330, 12)
    holes = walk("HOLES", 700, 13)
    holes.loc[np.arange(700) % 9 == 2, "close"] = np.nan
    holes.loc[300:340, ["high", "low"]] = np.nan
    df = pd.concat([*daily, seldom, new, gone, holes], ignore_index=True)
    return df.astype(object).where(df.notna(), None)


@pytest.fixture(scope="module")
def frames(spark):
    every = made()
    return every, lambda df: spark.createDataFrame(df, BARS)


def same(got, want):
    got, want = (d.select("symbol", "date", "bar_idx", *FIELDS).toPandas().sort_values(["symbol", "date"])
                 .reset_index(drop=True) for d in (got, want))
    assert (got[["symbol", "date", "bar_idx"]] == want[["symbol", "date", "bar_idx"]]).all().all()
    for col in FIELDS:
        np.testing.assert_allclose(got[col].astype(float), want[col].astype(float), rtol=1e-9, atol=1e-9, err_msg=col)


def test_extended_panel_equals_a_rebuild(spark, frames, tmp_path):
    every, to = frames
    day = pd.to_datetime(every.date)
    store = PanelStore(spark, str(tmp_path / "store"), buckets=2)
    first = every[day < "2023-09-05"]
    store.extend(to(first), "daily", 1)
    same(store.panel(0), panel(to(first), FIELDS, 0))
    # days that follow, in several batches; one is sent again, one changes nothing
    for n, (a, b) in enumerate((("2023-09-05", "2023-09-20"), ("2023-09-20", "2030-01-01")), 2):
        store.extend(to(every[(day >= a) & (day < b)]), "daily", n)
        store.extend(to(every[(day >= a) & (day < b)].head(3)), "daily", n)
    same(store.panel(0), panel(to(every), FIELDS, 0))
    # late corrections of two symbols, one of them in an early month
    fixed = every.copy()
    wrong = ((fixed.symbol == "D1") & (day == "2024-01-10")) | ((fixed.symbol == "SELDOM") & (day < "2022-02-01"))
    fixed.loc[wrong, ["open", "high", "low", "close"]] *= 1.5
    store.extend(to(fixed[wrong]), "fixes", 1)
    same(store.panel(0), panel(to(fixed), FIELDS, 0))
    # a symbol is replaced as a whole, with fewer bars
    whole = fixed[(fixed.symbol == "D2") & (day > "2023-01-01")].copy()
    whole[["open", "high", "low", "close"]] /= 2
    store.extend(to(whole), "fixes", 2, whole=True)
    final = pd.concat([fixed[fixed.symbol != "D2"], whole])
    same(store.panel(0), panel(to(final), FIELDS, 0))
    assert store.panel().select("symbol").distinct().count() == panel(to(final)).select("symbol").distinct().count()
    assert store.bars().count() == len(final)


def test_only_touched_months_are_written_and_read(spark, frames, tmp_path):
    every, to = frames
    every = every[every.symbol.str.startswith("D")]
    day = pd.to_datetime(every.date)
    store = PanelStore(spark, str(tmp_path / "store"))
    store.extend(to(every[day < "2024-08-15"]), "daily", 1)
    before = store.store.version().parts["panel"]
    read = []
    whole_read = store.store.read
    store.store.read = lambda table, parts=None, version=None: (
        read.append((table, parts)), whole_read(table, parts, version))[1]
    store.extend(to(every[day >= "2024-08-15"]), "daily", 2)
    after = store.store.version().parts["panel"]
    assert {p for p in after if after[p] != before.get(p)} == {"2024-08.0", "2024-09.0"}
    months = {p for table, parts in read if table == "panel" for p in parts}
    assert min(months) >= "2023-06" and len(months) <= 16
    # a screen of three bars and one of a quarter, on a past date
    day = dt.date(2024, 5, 15)

    def months_of(*conditions):
        read.clear()
        bars = store.market(conditions, as_of=day).bars
        asked = sorted(p[:7] for table, parts in read if table == "panel" for p in parts)
        opened = {f.split("part=")[1][:7] for f in bars.inputFiles() if f.split("/part=")[0].split("/")[-1] in panel_folders}
        assert opened == set(asked)
        return asked

    panel_folders = {f.split("/")[1] for fs in after.values() for f in fs}
    assert months_of(c.proximity("low", "ema_50", 1.0, 3)) == ["2024-04", "2024-05"]
    assert months_of(c.rel_strength(63, ">", 0)) == ["2024-02", "2024-03", "2024-04", "2024-05"]
    assert len(months_of(c.trend("up", "weekly"))) > 20


SCREENS = {
    "ranks": [c.rs_percentile(">=", 40), c.sector_rank(63, top=2), c.atr_pct_percentile("<=", 80)],
    "levels": [c.near_support(5.0), c.support_at_ma("ema_50"), c.bb_squeeze(60, 252)],
    "context": [c.rel_strength(63, ">", -50), c.breadth("positive"), c.trend("up", "weekly"), c.persistence("rsi", ">", 20, 5)],
}


@pytest.fixture(scope="module")
def kept(spark, frames, tmp_path_factory):
    every, to = frames
    store = PanelStore(spark, str(tmp_path_factory.mktemp("kept") / "store"))
    store.extend(to(every), "daily", 1)
    return store


@pytest.mark.parametrize("name", SCREENS)
def test_stored_and_plain_market_agree_on_past_dates(spark, frames, kept, name):
    every, to = frames
    bars, store = to(every), kept
    universe = spark.createDataFrame([(s, s, f"S{i % 3}") for i, s in enumerate(sorted(set(every.symbol)))],
                                     "symbol string, name string, industry string")
    bench = bars.groupBy("date").agg(F.avg("close").alias("close"))
    shown = lambda df: sorted(map(str, df.select(*[
        F.round(x, 6).alias(x) if t == "double" else F.col(x) for x, t in df.dtypes]).collect()))
    for day in (None, dt.date(2023, 4, 15)):
        want = evaluate(Market(bars, universe, bench), SCREENS[name], as_of=day)
        conds = SCREENS[name]
        got = evaluate(store.market(conds, METRICS, as_of=day, universe=universe, benchmark=bench), conds)
        assert shown(got) == shown(want) and want.count() >= 5


METRICS = ("roc_63", "median_turnover", "pct_from_52w_high")


def rows_of(spark, parts, value):
    return spark.createDataFrame([(p, value) for p in parts], "part string, x int")


def test_commits_are_whole_or_not_there(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    assert store.version().number == 0
    with pytest.raises(ValueError):
        store.read("t")
    store.commit("w", 1, {"t": (rows_of(spark, "ab", 1), ())}, {"log": rows_of(spark, "a", 1)})
    store.commit("w", 1, {"t": (rows_of(spark, "ab", 2), "ab")}, {"log": rows_of(spark, "a", 2)})
    assert [r.x for r in store.read("t").collect()] == [1, 1] and store.read("log").count() == 1

    # the job dies when the rows are written but the version isn't
    with monkeypatch.context() as m:
        m.setattr(Store, "_write_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.commit("w", 2, {"t": (rows_of(spark, "b", 3), "b")}, {"log": rows_of(spark, "a", 3)})
    assert sorted(r.x for r in store.read("t").collect()) == [1, 1] and store.read("log").count() == 1
    base = store.version()
    for _ in range(2):
        store.commit("w", 2, {"t": (rows_of(spark, "b", 3), "b")}, {"log": rows_of(spark, "a", 3)})
    assert sorted(r.x for r in store.read("t").collect()) == [1, 3]
    assert [r.x for r in store.read("t", ["b", "no such part"]).collect()] == [3]
    assert store.read("t", []).count() == 0
    assert sorted(r.x for r in store.read("log").collect()) == [1, 3]

    # two writers start from one version
    with pytest.raises(Conflict):
        store.commit("other", 1, {"t": (rows_of(spark, "a", 9), "a")}, base=base)
    with pytest.raises(Conflict):
        store._write_new("versions/0000000002.json", "{}")
    # a part may go
    store.commit("w", 3, {"t": (rows_of(spark, "b", 0).limit(0), "b")})
    assert [r.x for r in store.read("t").collect()] == [1]
    old = base
    assert sorted(r.x for r in store.read("t", version=old).collect()) == [1, 1]
    gone = store.clear_unused()
    assert any(g.startswith("data/") for g in gone)
    assert [r.x for r in store.read("t").collect()] == [1] and store.read("log").count() == 2


def test_kept_runs_and_milestones(spark, tmp_path):
    runs = Store(spark, str(tmp_path / "runs"))
    rows = lambda *r: spark.createDataFrame(r, "screen_id string, ts string, as_of string, symbol string, close double")
    for _ in range(2):
        stores.keep_run(runs, rows(("a", "2024-01-31", "latest", "X", 1.0), ("a", "2024-01-31", "latest", "Y", 2.0)), 1)
        stores.keep_run(runs, rows(("b", "2024-02-01", "latest", "X", 3.0)), 2)
    assert sorted(r.symbol for r in stores.kept_runs(runs, "a").collect()) == ["X", "Y"]
    assert stores.kept_runs(runs).count() == 3
    kept = Store(spark, str(tmp_path / "milestones"))
    marks = lambda *r: spark.createDataFrame(r, "cohort_id string, horizon int, net double")
    stores.freeze_milestones(kept, marks(("c", 5, 0.1)), 1)
    for _ in range(2):
        stores.freeze_milestones(kept, marks(("c", 5, 9.9), ("c", 20, 0.2), ("d", 5, 0.3)), 2)
    assert sorted(map(tuple, stores.kept_milestones(kept).collect())) == [("c", 5, 0.1), ("c", 20, 0.2), ("d", 5, 0.3)]


def test_windows_see_the_whole_series_of_a_month_list(kept):
    """Parts that a date reaches hold the bars of every symbol, also of those that trade seldom."""
    day = dt.date(2024, 5, 15)
    rows = kept.store.read("panel", kept.months_for(day, 63)).filter(F.col("date") <= F.lit(day))
    whole = kept.store.read("panel").filter(F.col("date") <= F.lit(day))
    last = whole.groupBy("symbol").agg(F.max("bar_idx").alias("last"))
    need = whole.join(last, "symbol").filter(F.col("bar_idx") >= F.col("last") - 63)
    assert need.select("symbol", "date").exceptAll(rows.select("symbol", "date")).count() == 0
