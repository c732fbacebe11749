import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tickloom.operators import conditions as c
from tickloom.plans.catalogue import PRESETS, needs_sectors

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("flagship", "adjusted_bars", "asof_join", "weekly_indicators", "indicator_adx", "indicator_any_width",
          "indicator_macd", "nearest_levels", "cross_section", "condition_weekly_trend",
          "condition_bb_squeeze", "preset_minervini_stage2", "evidence", "evidence_weekly", "evidence_ranks", "screen_stats", "kept_runs", "kept_milestones", "kept_panel",
          "kept_match_table", "member_performance", "events", "bootstrap_interval", "indicator_ema_gaps",
          "sizing_risk", "cohort_milestones", "cohort_performance", "check_report")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def normal(df):
    out = pd.DataFrame({c: df[c].map(lambda v: None if pd.isna(v) else (
        float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10]
        if hasattr(v, "year") else v)) for c in sorted(df.columns)}, dtype=object)
    return sorted(map(repr, out.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", ["sr_levels", "nearest_levels"])
def test_levels_in_sql_do_not_hang_on_the_order_of_rows(name):
    """Equal prices are common: the result is the same however the rows come in."""
    rows = []
    for order in ("l_orderkey", "hash(l_orderkey, l_linenumber)", "l_extendedprice desc"):
        con = duckdb.connect()
        con.execute(f"create table lineitem as select * from '{FOLDER}/lineitem.parquet' order by {order}")
        for f in ("supplier", "nation"):
            con.execute(f"create view {f} as select * from '{FOLDER}/{f}.parquet'")
        rows.append(normal(con.execute(entry.oracle_sql()[name]).fetchdf()))
    assert rows[0] == rows[1] == rows[2]


@pytest.mark.parametrize("name", ["screen_near_misses", "screen_shown_matches"])
def test_sorted_rows_do_not_compute_the_panel_again(spark, name):
    """The sort samples its input, which must not be the window stages."""
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan and "Window" not in plan


def test_registry_is_complete():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries)
    own = {k for k in queries if k != "pipeline" and not k.startswith("op")}
    assert own == own & set(sqls)
    assert len(PRESETS) == 31
    assert {f"preset_{p}" for p in PRESETS} <= set(queries)
    used = {x.kind for x in [*sum(PRESETS.values(), [])]}
    assert used < set(c.BUILDERS)


def test_condition_names_follow_their_arguments():
    assert c.sector_rank(63, top=3).name != c.sector_rank(63, bottom=3).name
    assert c.within("rsi", min=40).name != c.within("rsi", max=40).name
    assert c.near_support(3).name == c.near_support(3.0).name
    assert c.near_support(3.0).with_arg("tolerance_pct", 3.5) == c.near_support(3.5)
    assert c.divergence("bullish").with_arg("lookback", 50) == c.divergence("bullish", "rsi", 50)
    assert needs_sectors(PRESETS["sector_leader_pullback"])
    assert not needs_sectors(PRESETS["golden_cross"])
