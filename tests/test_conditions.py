import datetime as dt

import numpy as np
import pandas as pd
import pytest
from bars import frame, walk
from pyspark.sql import functions as F

from tickloom.functions.steps import add_steps
from tickloom.functions.windows import by_symbol, number_bars
from tickloom.operators import conditions as c
from tickloom.operators.levels import level_steps
from tickloom.operators.screen import (Market, combine, evaluate, screen_stats, signal_bars,
                                       signals)
from tickloom.plans.catalogue import PRESETS


def held(bars, *conditions, **kw):
    return {(r.symbol, r.date) for r in signal_bars(Market(bars, **kw), conditions).collect()}


def last(bars, condition):
    df = signals(Market(bars), [condition], latest=True)
    return bool(df.first()[condition.name])


def pullback():
    close = 100 * 1.0015 ** np.arange(300)
    close[-6:] = close[-7] * np.array([0.995, 0.985, 0.975, 0.968, 0.978, 0.99])
    return frame("PULL", close)


def test_breakdown_is_not_support(to_bars):
    close = 100 * 1.0015 ** np.arange(300)
    close[-8:] = close[-9] * 0.975 ** np.arange(1, 9)
    assert not last(to_bars(frame("DOWN", close)), c.support_at_ma("ema_50"))


def test_touch_of_the_average_is_support(to_bars):
    x = pullback()
    ema = x.close.ewm(span=50, adjust=False).mean()
    x.loc[297, "low"] = ema[297] * 1.001
    bars = to_bars(x)
    assert last(bars, c.support_at_ma("ema_50", 1.5, 5))
    assert last(bars, c.trend("up"))


BASE = [100.0] * 60


@pytest.mark.parametrize("pattern,rows", [
    ("inside_bar", [(100, 105, 95, 102), (101, 104, 96, 101)]),
    ("bullish_engulfing", [(102, 103, 99, 100), (99.5, 104, 99, 103)]),
    ("bearish_engulfing", [(100, 103, 99, 102), (102.5, 103, 98, 99)]),
    ("hammer", [(100, 101, 99, 100), (100, 100.6, 96, 100.5)]),
    ("shooting_star", [(100, 101, 99, 100), (100.5, 104.5, 99.9, 100)]),
])
def test_candles(to_bars, pattern, rows):
    flat = frame("C", BASE, band=0.01)
    dates = pd.bdate_range("2022-01-03", periods=62).date
    more = pd.DataFrame([{"symbol": "C", "date": dates[60 + i], "open": o, "high": h, "low": lo,
                          "close": cl, "volume": 1e6} for i, (o, h, lo, cl) in enumerate(rows)])
    bars = to_bars(flat, more)
    assert ("C", dates[61]) in held(bars, c.candle(pattern))
    others = {"bullish_engulfing": "bearish_engulfing", "bearish_engulfing": "bullish_engulfing"}
    if pattern in others:
        assert ("C", dates[61]) not in held(bars, c.candle(others[pattern]))


def clusters(x, i, k=5, lookback=250, tol=1.0):
    win = x.iloc[max(0, i - lookback): i + 1]
    prices = []
    for col, pick in (("high", max), ("low", min)):
        v = win[col].to_numpy()
        prices += [v[j] for j in range(k, len(v) - k) if v[j] == pick(v[j - k: j + k + 1])]
    groups = []
    for p in sorted(prices):
        if groups and 100 * (p - groups[-1][-1]) / groups[-1][-1] <= tol:
            groups[-1].append(p)
        else:
            groups.append([p])
    return [(float(np.mean(g)), len(g)) for g in groups if len(g) >= 2]


def test_levels_match_brute_force(walk_bars, walks):
    df = add_steps(number_bars(walk_bars), level_steps(), ["levels", "support", "resistance"])
    got = {(r.symbol, r.bar_idx): r for r in df.collect()}
    rng = np.random.default_rng(0)
    for _ in range(150):
        s = f"W{rng.integers(12):02d}"
        i = int(rng.integers(0, 320))
        x = walks[walks.symbol == s].reset_index(drop=True)
        want = clusters(x, i)
        row = got[s, i]
        assert [t.touches for t in row.levels] == [n for _, n in want]
        np.testing.assert_allclose([t.level for t in row.levels], [v for v, _ in want])
        below = [v for v, _ in want if v <= x.close[i]]
        assert (row.support is None) == (not below)
        if below:
            assert row.support == pytest.approx(max(below))


def test_squeeze_matches_interpolated_percentile(walk_bars, walks):
    got = held(walk_bars, c.bb_squeeze(20, 100))
    want = set()
    for s, x in walks.groupby("symbol"):
        width = 400 * x.close.rolling(20).std() / x.close.rolling(20).mean()
        for i in range(len(x)):
            past = width.iloc[max(0, i - 99): i + 1].dropna()
            if len(past) >= 60 and pd.notna(width.iloc[i]) \
                    and width.iloc[i] <= np.percentile(past, 20) + 1e-12:
                want.add((s, x.date.iloc[i]))
    assert got == want


def test_divergence_needs_two_confirmed_pivots(walk_bars, walks):
    both = held(walk_bars, c.divergence("bullish", "rsi", 40))
    assert both
    x = walks[walks.symbol == "W00"].reset_index(drop=True)
    assert not any(d in {x.date[j] for j in range(20)} for s, d in both if s == "W00")


@pytest.mark.parametrize("name", ["support_50ema_uptrend", "link_bullish_divergence", "nr7_squeeze",
                                  "weekly_up_daily_dip", "rs_leader_near_high", "breakout_volume"])
def test_no_look_ahead(walk_bars, walks, name):
    conditions = PRESETS[name]
    cut = walks.date.iloc[250]
    early = held(walk_bars.filter(F.col("date") <= F.lit(cut)), *conditions)
    late = {k for k in held(walk_bars, *conditions) if k[1] <= cut}
    assert early == late


def test_missing_volume_never_matches(spark, walks):
    from tickloom.schema import BARS
    x = walks[walks.symbol == "W00"].copy()
    bars = spark.createDataFrame(x, BARS).withColumn("volume", F.lit(None).cast("double"))
    assert not held(bars, c.volume_spike(0.0))
    assert not held(bars, c.change("volume", 5, "<=", 1e9))


def test_or_logic_and_errors(walk_bars):
    one, two = c.within("rsi", max=30), c.within("rsi", min=70)
    both = signals(Market(walk_bars), [one, two]).filter(combine([one, two], "OR")).count()
    assert both == len(held(walk_bars, one)) + len(held(walk_bars, two))
    for bad in (lambda: c.compare("nothing", ">", 1), lambda: c.compare("close", "=", 1),
                lambda: c.sector_rank(63), lambda: c.sector_rank(63, 1, 1),
                lambda: c.within("rsi"), lambda: c.candle("doji"), lambda: c.sector([]),
                lambda: c.compare("ema_50", ">", 1, timeframe="weekly")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        signals(Market(walk_bars), [c.rel_strength(5, ">", 0)])
    with pytest.raises(ValueError):
        signals(Market(walk_bars), [c.sector(["X"])])


def test_weekly_flag_of_the_last_closed_week(to_bars):
    close = np.r_[np.linspace(100, 150, 100), np.linspace(150, 60, 20)]
    x = frame("W", close)
    cond = c.compare("close", ">", 100, timeframe="weekly")
    got = {d for _, d in held(to_bars(x), cond)}
    week = x.set_index(pd.to_datetime(x.date)).close.resample("W-FRI").last()
    for d in x.date:
        known = week[week.index <= pd.Timestamp(d)]
        assert (d in got) == bool(len(known) and known.iloc[-1] > 100), d
    assert dt.date(2022, 1, 3) not in got


def test_weekly_values_pass_through_the_daily_partitioning(spark, to_bars, tmp_path):
    """The bars are shuffled by symbol once, and no join by week is made."""
    path = str(tmp_path / "bars")
    to_bars(walk("A", 400, 1), walk("B", 400, 2)).write.parquet(path)
    bars = by_symbol(spark.read.parquet(path))
    df = signals(Market(bars), [c.trend("up", "weekly"), c.compare("close", ">", "ema_20", "weekly")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    # one shuffle, in the daily and in the weekly branch alike
    assert plan.count("Exchange hashpartitioning(symbol") <= 2 and "hashpartitioning(symbol#" in plan
    assert "date" not in "".join(x.split("Arguments")[0] for x in plan.split("\n") if "Exchange hashpartitioning" in x
                                 and "," in x.split("hashpartitioning(")[1].split("#")[0])
    assert df.count() == 800


def test_run_statistics_count_what_the_gate_leaves_out(to_bars):
    rich, poor = walk("RICH", 100, 1), walk("POOR", 100, 2)
    rich["volume"], poor["volume"] = 1e7, 10.0
    found = evaluate(Market(to_bars(rich, poor)), [c.compare("close", ">", 0.0), c.compare("close", "<", 0.0)])
    row = screen_stats(found, gate=1.0).first().asDict()
    assert row == {"universe": 2, "liquidity_excluded": 1, "evaluated": 1, "matched": 0, "near_misses": 1}
    assert screen_stats(found).first().liquidity_excluded == 0


def test_equal_widths_are_a_squeeze(to_bars):
    """Each window of 20 holds the same closes in another order: no width lies below another."""
    cents = np.random.default_rng(4).integers(9000, 11000, 20)
    got = held(to_bars(frame("SAME", np.tile(cents, 20) / 100)), c.bb_squeeze(20, 252))
    assert len(got) == 400 - 19 - 59


def test_a_close_that_is_the_average_is_not_above_it(to_bars):
    cents = np.random.default_rng(6).integers(9000, 11000, 1200)
    at = np.arange(199, 1200, 25)
    for i in at:
        cents[i - 1] += -cents[i - 19:i].sum() % 19
        cents[i] = cents[i - 19:i].sum() // 19
    x = frame("EVEN", cents / 100)
    bars, equal = to_bars(x), {("EVEN", x.date[i]) for i in at}
    assert not equal & held(bars, c.compare("close", ">", "sma_20"))
    assert not equal & held(bars, c.compare("close", "<", "sma_20"))
    assert equal <= held(bars, c.compare("close", ">=", "sma_20")) & held(bars, c.compare("close", "<=", "sma_20"))


def test_levels_are_folded_only_where_pivots_change(walk_bars):
    names = ["_pivot_prices", "levels"]
    df = add_steps(number_bars(walk_bars, 60), level_steps(), names).select("symbol", "date", *names)
    rows = df.collect()
    assert sum(r["_pivot_prices"] is not None for r in rows) < 0.6 * len(rows)
    # a table that begins later gives bars that reach no further back the same levels
    cut = walk_bars.filter(F.col("date") >= sorted({r.date for r in rows})[45])
    late = {(r.symbol, r.date): r.levels for r in add_steps(number_bars(cut, 60), level_steps(), ["levels"]).filter(
        "bar_idx >= 255").collect()}
    full = {(r.symbol, r.date): r.levels for r in rows}
    assert late and all(full[k] == v for k, v in late.items())


def test_rounding_is_no_slope(to_bars):
    """The last five closes are the five that leave the 200-bar window, in another order."""
    frames = []
    for i in range(40):
        rng = np.random.default_rng(i)
        close = np.round(100 + np.cumsum(rng.normal(0, 1, 205)), 2)
        frames.append(frame(f"T{i:02d}", np.r_[close[:200], close[:5][::-1]]))
    rows = signals(Market(to_bars(*frames)), [c.compare("sma_200_slope", ">", 0)], ["sma_200_slope"], latest=True).collect()
    assert len(rows) == 40 and all(r.sma_200_slope == 0 for r in rows)
