"""Screens of the latest rows: flags computed over stacked symbols equal the window steps."""

import numpy as np
import pandas as pd
from bars import walk

from tickloom.operators import flags, screen
from tickloom.operators.conditions import BUILDERS, sector
from tickloom.plans import queries as q
from tickloom.schema import BARS

CONDITIONS = list(dict.fromkeys([*q.CONDITIONS.values(), *[c for cs in q.PRESETS.values() for c in cs], *q.EVIDENCE_SCREEN,
                                 sector(("X",))]))


def market(spark):
    # many lengths, so that the last bars lie in many situations; some values are missing
    frames = [walk(f"W{i:02d}", 60 + 23 * i, i, 0.0002 * (i % 5 - 2), 0.004 + 0.003 * (i % 4)) for i in range(24)] + [walk("FEW", 50, 99)]
    for i in (4, 9):
        frames[i].loc[np.arange(len(frames[i])) % 11 == 3, "close"] = np.nan
        frames[i].loc[40:50, ["high", "low"]] = np.nan
    frames[7].loc[60:, ["open", "high", "low", "close"]] = 80.0
    df = pd.concat(frames)
    bars = spark.createDataFrame(df.astype(object).where(df.notna(), None), BARS)
    universe = spark.createDataFrame([(f"W{i:02d}", f"name {i}", "XYZ"[i % 3]) for i in range(20)], "symbol string, name string, industry string")
    index = spark.createDataFrame(walk("I", 700, 50)[["date", "close"]])
    return screen.Market(bars, universe, index)


def test_flags_equal_window_steps(spark, monkeypatch):
    m, fields = market(spark), ["close", "roc_63", "median_turnover", "sma_50_slope"]
    assert {c.kind for c in CONDITIONS} == set(BUILDERS)
    read = lambda: screen.signals(m, CONDITIONS, fields, latest=True).toPandas().sort_values("symbol").reset_index(drop=True)
    got = read()
    with monkeypatch.context() as patch:
        patch.setattr(screen, "can_tell", lambda *_: False)
        want = read()
    assert list(got.columns) == list(want.columns) and len(got) == 24
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-12)
    assert sum(got[c.name].any() for c in CONDITIONS) > 35


def test_a_batch_needs_no_window_stage_over_its_bars(spark, walk_bars):
    plain = [c for c in CONDITIONS if c.kind in flags.KINDS and not c.weekly and not c.needs]
    df = screen.signals(screen.Market(walk_bars), plain, ["roc_63"], latest=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
