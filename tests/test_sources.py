import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from bars import frame, walk
from pyspark.sql import functions as F

from tickloom.operators import conditions as c
from tickloom.operators import quality
from tickloom.operators.screen import Market, evaluate, signal_bars, stored_market
from tickloom.sources import bars as src
from tickloom.sources import stores
from tickloom.sources.panels import PanelStore
from tickloom.streaming.upserts import read_stream, start_upserts

CSV = """SYMBOL, SERIES, DATE1, PREV_CLOSE, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, LAST_PRICE, CLOSE_PRICE, AVG_PRICE, TTL_TRD_QNTY, TURNOVER_LACS, NO_OF_TRADES, DELIV_QTY, DELIV_PER
AAA, EQ, 03-Jul-2026, 10, 10, 11, 9, 10, 10.5, 10, 1000, 1, 1, 500, 50.5
BBB, BE, 03-Jul-2026, 10, 10, 11, 9, 10, 10.5, 10, 1000, 1, 1, 500, 50.5
CCC, EQ, 03-Jul-2026, 10, 10, 8, 9, 10, 10.5, 10, 1000, 1, 1, 500, 50.5
DDD, EQ, 03-Jul-2026, 10, 0, 11, 9, 10, 10.5, 10, 1000, 1, 1, 500, 50.5
EEE, EQ, 03-Jul-2026, 10, -, 11, 9, 10, 10.5, 10, 1000, 1, 1, 500, -
"""


def test_exchange_csv(spark, tmp_path):
    (tmp_path / "day.csv").write_text(CSV)
    got = {r.symbol: r for r in src.read_exchange_csv(spark, str(tmp_path)).collect()}
    assert set(got) == {"AAA", "EEE"}
    assert got["AAA"].date == dt.date(2026, 7, 3) and got["AAA"].delivery_pct == 50.5
    assert got["EEE"].open is None and got["EEE"].delivery_pct is None and got["EEE"].close == 10.5


@pytest.mark.parametrize("subject,want", [
    ("Bonus 3:1", 0.25), ("BONUS 1 : 1", 0.5), ("Dividend - Rs 5 Per Share", None),
    ("Face Value Split (Sub-Division) - From Rs10/- Per Share To Re 1/- Per Share", 0.1),
    ("From Rs. 10 Per Share To Rs. 2.50 Per Share / Bonus 1:1", 0.25), ("Annual General Meeting", None)])
def test_adjustment_factor(spark, subject, want):
    df = spark.createDataFrame([(subject,)], "s string")
    assert df.select(src.adjustment_factor("s").alias("f")).first().f == want


@pytest.mark.parametrize("subject,want", [
    ("Face Value Split(From Rs 10/- Per Share To Rs 2/- Per Share)", 0.2),
    ("Face Value Split (Sub-Division)-From Rs 10/- Per Share To Rs 2/- Per Share", 0.2),
    ("Change from 1 April: Split From Rs 10/- Per Share To Rs 2/- Per Share", 0.2),
    ("From Rs 10/- Per Share To Rs 2/- Per Share, then From Rs 2 Per Share To Re 1 Per Share", 0.2),
    ("Bonus Issue - Bonus 1:1", 0.5), ("Dividend/Bonus 3 : 1)", 0.25), ("(Bonus 1:4), Bonus 1:1", 0.8),
    ("Split from 5 per share to 2 per share", None), ("From Rs 5 Per Share To 2 Per Share", None),
    ("From #5 Per Share To #2 Per Share", None), ("From Rs 10. Per Share To Rs 2 Per Share", None),
    ("From Rs 0 Per Share To Rs 2 Per Share / Bonus 1:1", None), ("Nobonus 1:1", None), ("Bonus 0:0", None),
    ("Bonus Issue 1:1", None), ("from", None), ("bonus", None), ("", None), (None, None)])
def test_adjustment_factor_wherever_it_is_stated(spark, subject, want):
    df = spark.createDataFrame([(subject,)], "s string")
    assert df.select(src.adjustment_factor("s").alias("f")).first().f == want


def test_adjustments_compound(spark, to_bars, tmp_path):
    rows = [{"symbol": "ABC", "exDate": d, "subject": s, "series": "EQ"} for d, s in
            (("01-Mar-2024", "Bonus 1:1"), ("03-Jun-2024", "Bonus 3:1"), ("-", "Bonus 1:1"),
             ("05-Jun-2024", "Dividend"))]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    acts = src.read_corporate_actions(spark, str(tmp_path))
    assert acts.count() == 4
    factors = src.cumulative_factors(acts)
    assert {str(r.ex_date): r.cum_factor for r in factors.collect()} == {
        "2024-03-01": 0.125, "2024-06-03": 0.25}
    bars = to_bars(frame("ABC", [100.0] * 150, start="2024-01-01"), frame("XYZ", [100.0] * 5))
    got = {(r.symbol, str(r.date)): r for r in src.apply_adjustments(bars, factors).collect()}
    assert len(got) == 155
    assert got["ABC", "2024-02-29"].close == 12.5
    assert got["ABC", "2024-03-01"].close == 25.0
    assert got["ABC", "2024-05-31"].close == 25.0
    assert got["ABC", "2024-06-03"].close == 100.0
    assert got["ABC", "2024-02-29"].volume == 1e6 and got["XYZ", "2022-01-03"].close == 100.0


def test_upsert_replace_append(to_bars):
    old, fresh = frame("A", [10.0, 11, 12]), frame("A", [20.0, 21, 22, 23]).iloc[2:]
    got = src.upsert_bars(to_bars(old, frame("B", [5.0])), to_bars(fresh)).orderBy("symbol", "date")
    assert [r.close for r in got.collect()] == [10, 11, 22, 23, 5]
    got = src.replace_symbols(to_bars(old, frame("B", [5.0])), to_bars(fresh)).orderBy("symbol", "date")
    assert [r.close for r in got.collect()] == [22, 23, 5]
    got = src.append_days(to_bars(old), to_bars(fresh)).orderBy("date")
    assert [r.close for r in got.collect()] == [10, 11, 12, 23]
    assert src.append_days(to_bars(old).limit(0), to_bars(fresh)).count() == 2
    assert src.unique_bars(to_bars(old, old)).count() == 3


def test_freshness(to_bars):
    bars = to_bars(frame("A", [1.0, 2]))
    assert src.assert_fresh(bars, dt.date(2022, 1, 9)) == dt.date(2022, 1, 4)
    with pytest.raises(ValueError):
        src.assert_fresh(bars, dt.date(2022, 1, 10))


def test_panel_store_serves_screens(spark, walk_bars):
    stores.write_panel(walk_bars, "panel_store", 4)
    stored = spark.table("panel_store")
    conds = [c.support_at_ma("ema_50"), c.trend("up"), c.near_support(3.0)]
    a = signal_bars(Market(walk_bars), conds)
    b = signal_bars(stored_market(stored), conds)
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() > 0
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    day = dt.date(2022, 12, 1)
    early = evaluate(stored_market(stored), conds, as_of=day)
    assert early.agg(F.max("date")).first()[0] <= day


def test_sinks(spark, walk_bars, tmp_path):
    ev = evaluate(Market(walk_bars), [c.compare("close", ">", "sma_20")])
    stores.write_matches(ev, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == ev.count()
    for ts in ("2024-01-01", "2024-01-02"):
        stores.append_run(stores.run_record(ev, "s", ts, "latest"), str(tmp_path / "runs"))
    runs = stores.read_runs(spark, str(tmp_path / "runs"), "s").collect()
    assert runs[0].ts == "2024-01-02" and len(runs) == 2 * ev.filter("matched").count()


def test_stream_of_late_bars(spark, to_bars, tmp_path):
    land, store = str(tmp_path / "land"), PanelStore(spark, str(tmp_path / "store"))
    first = frame("A", np.arange(1.0, 41))
    to_bars(first).write.parquet(land)
    start_upserts(read_stream(spark, land), store, str(tmp_path / "ck")).awaitTermination()
    late = frame("A", np.arange(101.0, 141)).iloc[38:]
    bad = late.assign(symbol="BAD", low=-1.0)
    to_bars(late, bad).write.mode("append").parquet(land)
    start_upserts(read_stream(spark, land), store, str(tmp_path / "ck")).awaitTermination()
    version = store.store.version().number
    store.extend(to_bars(first), "stream", 1)  # a retry
    assert store.store.version().number == version == 2
    got = store.bars().orderBy("date").collect()
    assert len(got) == 40 and got[37].close == 38 and got[39].close == 140
    assert store.panel(0).count() == 40 and store.panel().count() == 0


def test_quality_report_finds_planted_faults(spark, to_bars):
    good = walk("OK", 300, 1)
    bad = walk("BAD", 300, 2)
    bad.loc[5, "low"] = -1.0
    bad.loc[100:, ["open", "high", "low", "close"]] /= 2
    bad.loc[280:, "volume"] = 0.0
    prices = to_bars(good, bad, bad.iloc[[7]])
    universe = spark.createDataFrame([("OK",), ("BAD",), ("LOST",)], "symbol string")
    bench = to_bars(good).select("date", "close")
    day = good.date.iloc[-1]
    log = spark.createDataFrame([('{"ts":1,"as_of":1,"spec":{},"stats":{},"matched":[]}',), ('{"ts":1}',),
                                 ("{nonsense",)], "value string")
    rows = {r.check_name: r for r in quality.report(prices, universe, bench, day, prices, log).collect()}
    assert rows["coverage"].status == "FAIL" and rows["coverage"].bad == 1
    assert rows["integrity"].bad == 1 and rows["duplicates"].bad == 1
    assert rows["liveness"].status == "WARN" and rows["freshness"].status == "PASS"
    assert rows["screen log"].status == "FAIL" and rows["screen log"].bad == 2
    assert rows["rsi_range"].status == "PASS" and rows["benchmark"].status == "PASS"
    jump = quality.jumps(prices).collect()
    assert len(jump) == 1 and jump[0].split_like
    with pytest.raises(ValueError):
        quality.assert_passed(quality.bar_integrity(prices))
    assert isinstance(pd.Timestamp(day), pd.Timestamp)
