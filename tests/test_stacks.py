"""Columns computed over stacked symbols equal the window steps of the same names."""

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from bars import walk

from tickloom.functions import stacks
from tickloom.functions.steps import add_steps
from tickloom.functions.windows import number_bars
from tickloom.operators.fields import KNOWN, SMOOTHINGS
from tickloom.operators.indicators import SMOOTHED, daily_book, panel
from tickloom.schema import BARS
from tickloom.sources.panels import FIELDS, PanelStore


def some_bars():
    """Full, short and sparse histories, one with missing values and equal closes."""
    holes = walk("HOLES", 400, 5)
    holes.loc[np.arange(400) % 9 == 2, "close"] = np.nan
    holes.loc[:3, "close"] = np.nan
    holes.loc[200:260, ["high", "low"]] = np.nan
    still = walk("STILL", 300, 6)
    still.loc[100:180, ["open", "high", "low", "close"]] = 50.0
    df = pd.concat([walk("A", 420, 1), holes, walk("SHORT", 40, 2), still, walk("S2", 500, 3).iloc[::3]])
    return df.astype(object).where(df.notna(), None)


def sorted_frame(df):
    return df.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)


def test_fields_equal_window_steps(spark):
    bars = spark.createDataFrame(some_bars(), BARS)
    names = [*FIELDS, "_prev_open", "_raw_k", "_band_sd"]
    want = sorted_frame(add_steps(number_bars(bars, 60), daily_book(), names).select("symbol", "date", "bar_idx", "n_bars", *names))
    got = sorted_frame(panel(bars, names))
    assert (got[["symbol", "date", "bar_idx", "n_bars"]] == want[["symbol", "date", "bar_idx", "n_bars"]]).all().all()
    for c in names:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_panel_needs_no_window_stage(walk_bars):
    plan = panel(walk_bars, FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_the_same_smoothings_are_kept():
    assert {out: x for out, (x, _, _) in SMOOTHINGS.items()} == SMOOTHED
    assert set(FIELDS) - {"open", "high", "low", "close", "volume"} <= KNOWN


@pytest.mark.parametrize("rows", (1, 4, 7, 1000))
def test_symbols_stay_whole(rows):
    symbols = ["a"] * 9 + ["b"] + ["c"] * 5 + [None] * 3
    batches = pa.table({"symbol": pa.array(symbols), "x": list(range(18))}).to_batches(max_chunksize=2)
    parts = [t for t, _ in stacks.whole_symbols(batches, rows)]
    assert [x for t in parts for x in t["x"].to_pylist()] == list(range(18))
    seen = [set(t["symbol"].to_pylist()) for t in parts]
    assert sum(len(s) for s in seen) == 4


def test_kept_rows_need_no_window_stage(spark, walk_bars, tmp_path):
    rows = PanelStore(spark, str(tmp_path / "store"))._computed(walk_bars.select(*BARS.names))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_workers_find_the_package(walk_bars):
    panel(walk_bars, ["sma_20"])
    paths = walk_bars.sparkSession.sparkContext.environment["PYTHONPATH"].split(os.pathsep)
    assert any(os.path.isfile(os.path.join(p, "tickloom", "session.py")) for p in paths)
