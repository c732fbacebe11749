import numpy as np
import pandas as pd
import pytest
from bars import frame, walk

from tickloom.functions.ewm import ewm_steps
from tickloom.functions.rolling import mean_steps
from tickloom.functions.steps import add_steps, reach
from tickloom.functions.windows import number_bars
from tickloom.operators import conditions as c
from tickloom.operators.indicators import (daily_book, panel, stochastic_steps, weekly_bars,
                                           weekly_panel)
from tickloom.operators.levels import level_steps
from tickloom.schema import DAILY_FIELDS, OHLCV


def smooth(s, alpha, n):
    return s.ewm(alpha=alpha, adjust=False, min_periods=n).mean()


def running(values, alpha, n):
    """y starts at the first known value and moves by alpha of the distance; shown from n known on."""
    out, y, seen = [], None, 0
    for v in values:
        if v == v:
            y = v if y is None else y + alpha * (v - y)
            seen += 1
        out.append(y if seen >= n else np.nan)
    return out


def by_hand(rows):
    """Bar by bar, from the written definitions."""
    close, high, low = ([r[k] for r in rows] for k in ("close", "high", "low"))
    n = len(rows)
    nan = float("nan")
    step = [nan] + [close[i] - close[i - 1] for i in range(1, n)]
    out = {f"ema_{k}": running(close, 2 / (k + 1), k) for k in (10, 200)}
    out["sma_150"] = [sum(close[i - 149:i + 1]) / 150 if i >= 149 else nan for i in range(n)]
    mean200 = [sum(close[i - 199:i + 1]) / 200 if i >= 199 else nan for i in range(n)]
    out["sma_200_slope"] = [mean200[i] - mean200[i - 5] if i >= 5 else nan for i in range(n)]
    up = running([s if s != s else max(s, 0.0) for s in step], 1 / 14, 14)
    down = running([s if s != s else max(-s, 0.0) for s in step], 1 / 14, 14)
    out["rsi"] = [100 * u / (u + d) if d else nan for u, d in zip(up, down, strict=True)]
    spans = [max([h - lo] + ([abs(h - p), abs(lo - p)] if p is not None else []))
             for h, lo, p in zip(high, low, [None, *close[:-1]], strict=True)]
    out["atr"] = running(spans, 1 / 14, 14)
    out["high_52w"] = [max(high[max(0, i - 251):i + 1]) if i >= 59 else nan for i in range(n)]
    out["pct_from_52w_low"] = [100 * (close[i] - m) / m if i >= 59 else nan
                               for i in range(n) for m in [min(low[max(0, i - 251):i + 1])]]
    out["mom_12_1"] = [100 * (close[i - 21] - close[i - 252]) / close[i - 252] if i >= 252 else nan
                       for i in range(n)]
    return pd.DataFrame(out)


def test_panel_matches_direct_computation(walk_bars):
    got = panel(walk_bars).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    assert set(DAILY_FIELDS) < set(got.columns)
    want = pd.concat([by_hand(x.to_dict("records")) for _, x in got.groupby("symbol")], ignore_index=True)
    for c in want:
        assert (got[c].isna() == want[c].isna()).all(), c
        np.testing.assert_allclose(got[c].dropna(), want[c].dropna(), rtol=1e-9, atol=1e-9)


def test_smoothing_over_several_blocks(spark, to_bars):
    bars = to_bars(walk("LONG", 9000, 3, drift=0.0))
    for alpha, n in ((2 / 11, 10), (1 / 14, 14), (2 / 201, 200)):
        df = add_steps(number_bars(bars), ewm_steps("y", "close", alpha, n), ["y"])
        got = df.select("date", "close", "y").toPandas().sort_values("date")
        want = smooth(got.close, alpha, n)
        np.testing.assert_allclose(got.y.dropna(), want.dropna(), rtol=1e-12)
        assert got.y.isna().sum() == n - 1
    for alpha in (0.0, 1.1):
        with pytest.raises(ValueError):
            ewm_steps("y", "close", alpha, 2)


def test_any_width_and_any_smoothing_factor(to_bars, spark):
    bars = walk("ANY", 400, 7)
    gaps = bars.assign(close=bars.close.where(np.arange(400) % 7 > 1))
    gaps.loc[100:330, "close"] = np.nan
    for data in (bars, gaps.astype({"close": object}).where(gaps.notna(), None)):
        frame_ = number_bars(to_bars(data))
        for alpha, n in ((1 / 3, 5), (0.5, 3), (0.9, 2), (1.0, 1)):
            got = add_steps(frame_, ewm_steps("y", "close", alpha, n), ["y"]).toPandas().sort_values("date")
            want = smooth(pd.Series(data.close, dtype=float), alpha, n)
            np.testing.assert_allclose(got.y.astype(float), want, rtol=1e-12)
    for n in (1, 3, 7, 10, 13, 20, 57, 252):
        got = add_steps(number_bars(to_bars(bars)), mean_steps("y", "close", n), ["y"]).toPandas().sort_values("date")
        np.testing.assert_allclose(got.y, bars.close.rolling(n).mean(), rtol=1e-12)


def test_short_memory_gathers_no_bars(to_bars):
    """Its work a bar does not grow with the window: no list of bars is folded."""
    df = add_steps(number_bars(to_bars(walk("ANY", 80, 7))), ewm_steps("y", "close", 1 / 3, 5), ["y"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan


def test_median_turnover_sorts_what_it_looks_up(walk_bars):
    df = panel(walk_bars, ["turnover_cr", "median_turnover"])
    assert "percentile" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = df.toPandas().sort_values(["symbol", "date"])
    want = got.groupby("symbol").turnover_cr.rolling(20).median().to_numpy()
    np.testing.assert_allclose(got.median_turnover.astype(float), want, rtol=1e-15)


def test_reach_of_steps():
    book = daily_book() | level_steps() | c.bb_squeeze(20, 252).steps() | c.proximity("low", "ema_50", 1.0, 3).steps()
    reads = [*DAILY_FIELDS]
    assert reach(book, ["sma_200_slope"], OHLCV) == 199 + 5
    assert reach(book, ["roc_63", "mom_12_1"], OHLCV) == 252
    assert reach(book, ["ema_10"], OHLCV) is None and reach(book, ["rsi"], OHLCV) is None
    assert reach(book, ["ema_10", "rsi"], reads) == 0 and reach(book, ["high_52w"], OHLCV) == 252
    assert reach(book, ["support"], reads) == 245 + 5
    assert reach(book, [c.proximity("low", "ema_50", 1.0, 3).name], reads) == 2
    assert reach(book, [c.bb_squeeze(20, 252).name], reads) == 251
    assert reach(daily_book(seeded=True), DAILY_FIELDS, [*OHLCV, "_seed"]) == 252


def test_smoothing_over_gaps(spark):
    long = 100 + np.random.default_rng(1).normal(size=9500).cumsum()
    sparse, hole, rare = long.copy(), long.copy(), long.copy()
    sparse[::2] = np.nan
    hole[50:8900] = np.nan
    rare[np.arange(len(rare)) % 997 > 0] = np.nan
    series = {"short": [1, np.nan, 2], "sparse": sparse, "hole": hole, "rare": rare, "none": [np.nan] * 70}
    days = pd.date_range("1970-01-01", periods=9500).date
    bars = spark.createDataFrame([(s, days[i], None if np.isnan(v) else float(v)) for s, x in series.items()
                                  for i, v in enumerate(x)], "symbol string, date date, close double")
    got = add_steps(number_bars(bars), ewm_steps("y", "close", 2 / 11, 1), ["y"]).toPandas().sort_values("date")
    for s, x in series.items():
        np.testing.assert_allclose(got.y[got.symbol == s], smooth(pd.Series(x, dtype=float), 2 / 11, 1), rtol=1e-11)
    np.testing.assert_allclose(got.y[got.symbol == "short"], [1, 1, 1.2136], atol=1e-4)


def test_stochastic_by_hand(to_bars):
    close = [10, 11, 12, 11, 13, 14, 13, 12, 15, 12]
    high, low = [c + 1 for c in close], [c - 1 for c in close]
    df = add_steps(number_bars(to_bars(frame("S", close, close, high, low))),
                   stochastic_steps(5), ["_raw_k", "stoch_k", "stoch_d"])
    got = df.toPandas().sort_values("date")
    h, lo, c = (pd.Series(v, dtype=float) for v in (high, low, close))
    raw = 100 * (c - lo.rolling(5).min()) / (h.rolling(5).max() - lo.rolling(5).min())
    np.testing.assert_allclose(got.stoch_d.dropna(), raw.rolling(3).mean().rolling(3).mean().dropna())


def test_flat_prices_give_null_not_infinity(to_bars):
    flat = frame("F", [100.0] * 80, band=0.0)
    got = panel(to_bars(flat), ["rsi", "stoch_k", "adx", "bb_width_pct"]).toPandas()
    assert got[["rsi", "stoch_k", "adx"]].isna().all().all()
    assert (got.bb_width_pct.dropna() == 0).all()


def test_short_histories_have_no_panel(to_bars):
    got = panel(to_bars(walk("OK", 60, 1), walk("THIN", 59, 2)), ["close"])
    assert [r.symbol for r in got.select("symbol").distinct().collect()] == ["OK"]


def test_weeks_end_on_friday(to_bars):
    x = walk("W", 130, 5)
    got = weekly_bars(to_bars(x)).toPandas().sort_values("date").reset_index(drop=True)
    s = x.set_index(pd.to_datetime(x.date))
    want = s.resample("W-FRI").agg({"open": "first", "high": "max", "low": "min", "close": "last",
                                    "volume": "sum"})
    assert list(pd.to_datetime(got.date)) == list(want.index)
    np.testing.assert_allclose(got[["open", "high", "low", "close", "volume"]], want)
    w = weekly_panel(to_bars(x), ["ema_10", "rsi", "roc_4"]).toPandas().sort_values("date")
    np.testing.assert_allclose(w.roc_4.dropna(), (100 * want.close.pct_change(4)).dropna())
    np.testing.assert_allclose(w.ema_10.dropna(), smooth(want.close, 2 / 11, 10).dropna())
