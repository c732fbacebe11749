"""Made price bars for the tests."""

import numpy as np
import pandas as pd


def frame(symbol, close, open_=None, high=None, low=None, volume=1e6, start="2022-01-03", band=0.004):
    close = np.asarray(close, float)
    open_ = np.r_[close[0], close[:-1]] if open_ is None else np.asarray(open_, float)
    high = np.maximum(open_, close) * (1 + band) if high is None else np.asarray(high, float)
    low = np.minimum(open_, close) * (1 - band) if low is None else np.asarray(low, float)
    return pd.DataFrame({
        "symbol": symbol, "date": pd.bdate_range(start, periods=len(close)).date,
        "open": open_, "high": high, "low": low, "close": close,
        "volume": np.broadcast_to(np.asarray(volume, float), close.shape).copy()})


def walk(symbol, n, seed, drift=0.0003, sd=0.015):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(drift, sd, n)))
    open_ = np.r_[100.0, close[:-1]] * np.exp(rng.normal(0, sd / 2, n))
    high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, sd / 2, n)))
    low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, sd / 2, n)))
    return frame(symbol, close, open_, high, low, rng.lognormal(13, 0.5, n))
