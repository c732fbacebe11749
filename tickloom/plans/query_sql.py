"""SQL statements for the registered queries (see ``check_sql``)."""

from ..operators.conditions import Condition
from ..operators.event_study import MIX, PRIME, variants
from . import queries as q
from .catalogue import PRESETS
from .check_sql import (BARS, W, WEEKLY_BARS, breadth_select, chain, combined, condition_fields,
                        daily_fields, gated, panel_sql, signal_bars_sql, signal_ctes, statement,
                        tail, weekly_fields, weekly_panel_sql)
from ..operators.screen import DISPLAY_DECIMALS
from ..schema import DAILY_FIELDS, UNIVERSES, WEEKLY_FIELDS

B = BARS.strip()
OHLC = ("open", "high", "low", "close")
BAD = "(" + " or ".join(f"coalesce({c} <= 0, false)" for c in OHLC) + \
      " or coalesce(high < low, false))"


def sql(*ctes: str, select: str) -> str:
    return statement([B, *ctes], select)


def r(*cols: str, d: int = 6) -> str:
    """Rounded columns; ``expr as name`` is allowed."""
    out = []
    for c in cols:
        expr, _, name = c.partition(" as ")
        out.append(f"round({expr}, {d}) + 0.0 as {name or expr}")
    return ", ".join(out)


def times(f: str) -> str:
    return ", ".join(f"{c}*{f}::double as {c}" for c in OHLC)


# ---------------------------------------------------------------- sources
DIRTY = """select symbol, date, open,
 case when day(date) = 17 then low - 1 else high end as high,
 case when day(date) = 13 then -low else low end as low, close, volume from bars"""

EXCHANGE = f"""select * from (select symbol, date, open,
 case when day(date) = 5 then null else high end as high,
 case when day(date) = 7 then 0 else low end as low, close, volume,
 case when day(date) = 9 then null else cast(day(date) as double) end as delivery_pct
 from bars where day(date) <> 3) where not {BAD}"""

ACTIONS = """actions as (select symbol, date as ex_date,
  case when cast(volume/1000 as bigint) % 3 = 0 then 'Dividend'
       else 'Bonus 1:' || (cast(volume/1000 as bigint) % 4 + 2) end as subject,
  'EQ' as series,
  case when cast(volume/1000 as bigint) % 3 <> 0 then
    round_even((cast(volume/1000 as bigint) % 4 + 2)::double /
               (cast(volume/1000 as bigint) % 4 + 3), 6) end as factor
  from bars where day(date) <= 3 and month(date) in (1, 7))"""
CUM = """cum as (select a.symbol, a.ex_date, a.factor, 
  list_reduce(list(b.factor order by b.ex_date desc), lambda x, y: x*y) as cum_factor
  from actions a join actions b on b.symbol = a.symbol and b.ex_date >= a.ex_date
  where a.factor is not null and b.factor is not null group by 1, 2, 3)"""
ADJUSTED = ("select b.symbol, b.date, " + ", ".join(
    f"{c}*coalesce(cum_factor, 1) as {c}" for c in OHLC) + """, volume from bars b asof left join cum c
  on c.symbol = b.symbol and b.date < c.ex_date""")

SUBJECTS = """with s as (select p_partkey, p_size, case
  when p_size % 5 = 0 then 'Bonus ' || (p_size % 4 + 1) || ':' || (p_partkey % 5 + 1)
  when p_size % 5 = 1 then 'Face Value Split (Sub-Division) - From Rs' || (p_size % 9 + 2) ||
    '/- Per Share To Re ' || (p_partkey % 2 + 1) || '/- Per Share'
  when p_size % 5 = 2 then 'Interim Dividend - Rs ' || p_size || ' Per Share'
  when p_size % 5 = 3 then '  BONUS 1 : 1 '
  else 'Annual General Meeting' end as subject from part)
select p_partkey, subject, case
  when p_size % 5 = 0 then round_even((p_partkey % 5 + 1)::double
                                      / ((p_size % 4 + 1) + (p_partkey % 5 + 1)), 6)
  when p_size % 5 = 1 then round_even((p_partkey % 2 + 1)::double / (p_size % 9 + 2), 6)
  when p_size % 5 = 3 then 0.5::double end as factor from s"""


# ---------------------------------------------------------------- screens
def evaluated(conditions, logic: str = "AND", as_of: str | None = None, gate: float = 0.0,
              name: str = "ev") -> list[str]:
    """CTEs ending in ``name``: the latest row per symbol with metrics."""
    metrics = ("ema_50", "rsi", "adx", "vol_ratio", "atr_pct", "roc_21", "roc_63",
               "pct_from_52w_high", "median_turnover")
    ctes, last = signal_ctes(conditions, metrics, gate)
    if as_of:
        ctes[0] = ctes[0].replace("from cents)", f"from cents where dt <= date '{as_of}')", 1)
    passed = " + ".join(f"cast({c.name} as int)" for c in conditions)
    flags = ", ".join(c.name for c in conditions)
    ctes.append(f"""{name} as (select p.symbol, u.name, u.industry, p.date,
  {passed} as conditions_passed, {len(conditions)} as conditions_total,
  {combined(conditions, logic)} as matched, close, 100*(close/ema_50-1) as pct_vs_ema50, rsi, adx,
  vol_ratio, atr_pct, roc_21 as ret_1m_pct, roc_63 as ret_3m_pct, pct_from_52w_high,
  median_turnover as turnover_cr, {flags}
  from (select * exclude (industry) from (select *, null as industry from {last})) p
  left join universe u on u.symbol = p.symbol where i = n - 1{gated(gate)})""")
    if any(n.startswith("sector_rank") for c in conditions for n in c.needs) or any(
            c.kind == "sector" for c in conditions):
        ctes[-1] = ctes[-1].replace(
            f"(select * exclude (industry) from (select *, null as industry from {last}))",
            f"(select * exclude (industry) from {last})")
    else:
        ctes[-1] = ctes[-1].replace(
            f"(select * exclude (industry) from (select *, null as industry from {last}))", last)
    return ctes


METRIC_COLS = ("symbol, name, industry, date, conditions_passed, conditions_total, matched, "
               + r("close", "pct_vs_ema50", "rsi", "adx", "vol_ratio", "atr_pct", "ret_1m_pct",
                   "ret_3m_pct", "pct_from_52w_high", "turnover_cr"))


def screen_sql(select: str, as_of: str | None = None, gate: float = q.GATE) -> str:
    return statement(evaluated(q.NEAR_SCREEN, as_of=as_of, gate=gate), select)


def fields_sql(fields, select: str, extra=None) -> str:
    ctes, last = chain("bars", "d", daily_fields() | (extra or {}), fields)
    return statement([B, *ctes], select.format(p=last))


def _batch_sql() -> str:
    screens = q.BATCH_SCREENS
    every = [c for conds, _ in screens.values() for c in conds]
    ctes, last = signal_ctes(every, ["roc_63"], latest=True)
    ctes += _previous_ctes()
    rows = " union all ".join(
        f"select '{k}' as screen_id, symbol, roc_63 from {last} where i = n - 1 and "
        f"{combined(conds, logic)}" for k, (conds, logic) in screens.items())
    ctes.append(f"found as (select f.*, row_number() over (partition by f.screen_id order by "
                f"roc_63 desc nulls last, f.symbol) as k, v.symbol is null as is_new "
                f"from ({rows}) f left join prev v on v.symbol = f.symbol "
                f"and f.screen_id = 'tsmom_regime')")
    return statement(ctes, "select screen_id, count(*) as matched, string_agg(symbol, ',' "
                           "order by k) filter (k <= 3) as top3, "
                           "sum(cast(is_new as int))::bigint as new_since_last from found "
                           "group by screen_id")


def _previous_ctes() -> list[str]:
    conds = PRESETS["tsmom_regime"]
    f = daily_fields()
    for c in conds:
        f |= condition_fields(c)
    ctes, last = chain("bars_before", "pv", f, [c.name for c in conds])
    return ["bars_before as materialized (select * from bars where date <= date '1998-06-01')",
            *ctes, f"prev as (select symbol from {last} where i = n - 1 and {combined(conds)})"]


def _run_diff_sql() -> str:
    conds = PRESETS["tsmom_regime"]
    ctes = evaluated(conds) + _previous_ctes()
    failing = " || ".join(f"case when not {c.name} then ',{c.name}' else '' end" for c in conds)
    return statement(ctes, f"""select coalesce(e.symbol, p.symbol) as symbol,
 case when coalesce(matched, false) then 'new' else 'dropped' end as change,
 case when coalesce(matched, false) then null when matched is null then 'not_evaluated'
 else substr({failing}, 2) end as failing
 from ev e full join prev p on p.symbol = e.symbol
 where coalesce(matched, false) <> (p.symbol is not null)""")


def _watchlist_sql() -> str:
    conds = PRESETS["tsmom_regime"]
    ctes, last = signal_ctes(conds)
    ctes.append("tags as (select symbol, min(date) as ts, arg_min(close, date) as close_at_tag "
                "from bars where date >= date '1997-01-01' group by 1)")
    return statement(ctes, f"""select 'tsmom_regime' as screen_id, t.symbol,
 round(close_at_tag, 6) as close_at_tag, ts, round(p.close, 6) as current_close,
 round(100*(p.close/close_at_tag - 1), 6) as move_pct, {combined(conds)} as still_holds
 from tags t left join {last} p on p.symbol = t.symbol and p.i = p.n - 1""")


def evidence_values(c: Condition) -> tuple[dict, list[str], str | None]:
    """Fields, value columns and date column that explain a condition."""
    n, k = c.name, c.kind
    hit = f"{n}_hit"
    w = c["lookback"]
    last_at = (f"{n}_at", ((hit,), f"max(case when {hit} then date end) {tail(w or 1)}"))
    if k == "compare":
        return {f"{n}_gap": ((c["left"], c["right"]), f"100*({c['left']}/{c['right']}-1)")}, \
            [c["left"], c["right"], f"{n}_gap"], None
    if k == "proximity":
        t, f = c["target"], c["ref"]
        return {f"{n}_d": ((t, f), f"abs({t}-{f})/{f}*100"),
                f"{n}_m": ((f"{n}_d",), f"min({n}_d) {tail(w)}"),
                f"{n}_at": ((f"{n}_d",), f"arg_min(date, {n}_d) {tail(w)}")}, [f"{n}_m"], f"{n}_at"
    if k == "trend":
        return {}, ["close", *(("ema_20", "ema_40", "ema_20_slope") if c.weekly
                               else ("ema_50", "ema_200", "ema_50_slope"))], None
    if k == "support_at_ma":
        m = c["ma"]
        return {f"{n}_d": ((m,), f"case when low < {m} then 0 else abs(low-{m})/{m}*100 end"),
                f"{n}_h": ((m,), f"100*(close/{m}-1)"),
                f"{n}_dm": ((f"{n}_d",), f"min({n}_d) {tail(w)}"),
                f"{n}_hm": ((f"{n}_h",), f"min({n}_h) {tail(w)}")}, \
            [f"{n}_dm", f"{n}_hm", f"{n}_h"], None
    if k in ("cross", "threshold_cross", "candle"):
        return {last_at[0]: last_at[1]}, [], last_at[0]
    if k == "gap":
        return {last_at[0]: last_at[1],
                f"{n}_g": ((hit, "gap_pct"), f"arg_max(case when {hit} then gap_pct end, "
                           f"case when {hit} then date end) {tail(w)}")}, [f"{n}_g"], last_at[0]
    if k == "volume_spike":
        return {}, ["vol_ratio"], None
    if k == "within":
        return {}, [c["field"]], None
    if k == "change":
        return {}, [f"{n}_x"], None
    if k == "near_support":
        return {f"{n}_d": (("support",), "100*(close/support-1)")}, ["support", f"{n}_d"], None
    if k == "near_resistance":
        return {f"{n}_d": (("resistance",), "100*(resistance-close)/close")}, \
            ["resistance", f"{n}_d"], None
    if k == "breakout_resistance":
        return {f"{n}_lv": ((f"{n}_then",), f"case when i - {w} >= 30 then {n}_then end")}, \
            [f"{n}_lv", "close"], None
    if k == "rel_strength":
        x = c["window"]
        return {f"{n}_s": (("close",), f"100*(close/lag(close,{x}) {W}-1)"),
                f"{n}_b": (("benchmark",), f"100*(benchmark/lag(benchmark,{x}) {W}-1)")}, \
            [f"{n}_s", f"{n}_b", f"{n}_x"], None
    if k == "persistence":
        x = c["field"]
        return {f"{n}_lo": ((x,), f"min({x}) {tail(c['bars'])}"),
                f"{n}_hi": ((x,), f"max({x}) {tail(c['bars'])}")}, [f"{n}_lo", f"{n}_hi"], None
    if k == "divergence":
        def p(j, part):
            return f"case when len({n}_l) >= 2 then {n}_l[{j}].{part} end"
        return {f"{n}_p1": ((f"{n}_l",), p(-2, "p")), f"{n}_o1": ((f"{n}_l",), p(-2, "o")),
                f"{n}_p2": ((f"{n}_l",), p(-1, "p")), f"{n}_o2": ((f"{n}_l",), p(-1, "o")),
                f"{n}_first": ((f"{n}_l",), f"i - {p(-2, 'at')}"),
                f"{n}_back": ((f"{n}_l",), f"i - {p(-1, 'at')}"),
                f"{n}_at": ((f"{n}_back",), f"case when {n}_back is not null then "
                            f"list(date) {tail(60)} end")}, \
            [f"{n}_p1", f"{n}_o1", f"{n}_p2", f"{n}_o2"], f"{n}_at[-1 - {n}_back]"
    if k == "tight_range":
        return {}, [f"{n}_span"], None
    if k == "flat_base":
        return {}, [f"{n}_span", "pct_from_52w_high"], None
    if k == "bb_squeeze":
        return {f"{n}_w": (("bb_width_pct",), f"list(bb_width_pct) {tail(w)}"),
                f"{n}_s": ((f"{n}_w",), f"case when bb_width_pct is not null then "
                           f"100.0::double*len(list_filter({n}_w, lambda x: x < bb_width_pct))"
                           f"/len(list_filter({n}_w, lambda x: x is not null)) end")}, \
            ["bb_width_pct", f"{n}_s"], None
    raise KeyError(k)


def _evidence_sql() -> str:
    conds = q.EVIDENCE_SCREEN
    f = daily_fields()
    wanted: list[str] = []
    plans = []
    for c in conds:
        extra, values, at = evidence_values(c)
        f |= condition_fields(c) | extra
        wanted += [c.name, *values, *([at.partition("[")[0]] if at else []), *extra]
        plans.append((c, values, at))
    ctes, last = chain("bars", "d", f, dict.fromkeys(wanted))
    widest = max(len(v) for _, v, _ in plans)
    rows = []
    for i, (c, values, at) in enumerate(plans):
        cols = [f"round(cast({v} as double), 6) as v{j + 1}" for j, v in enumerate(values)]
        cols += [f"null::double as v{j + 1}" for j in range(len(values), widest)]
        words = f"coalesce('first_date=' || ({c.name}_at[-1 - {c.name}_first])::date, '')" if c.kind == "divergence" else "''"
        rows.append(f"select symbol, date, {i} as cond_id, {c.name} as passed, "
                    f"{at or 'null'}::date as at, {', '.join(cols)}, {words} as words from {last} where i = n - 1")
    return statement([B, *ctes], " union all ".join(rows))


def _weekly_evidence_sql() -> str:
    """Weekly values of a symbol's latest week whose Friday isn't after the bar."""
    conds = [c for c in q.WEEKLY_EVIDENCE_SCREEN if c.weekly]
    f, wanted, plans = weekly_fields(), [], []
    for c in conds:
        extra, values, at = evidence_values(c)
        f |= condition_fields(c) | extra
        wanted += [c.name, *values, *([at] if at else []), *extra]
        plans.append((c, values, at))
    ctes, last = chain("weekly_bars", "w", f, dict.fromkeys(wanted), 0)
    widest = max(len(v) for _, v, _ in plans)
    rows = []
    for i, (c, values, at) in enumerate(plans):
        cols = [f"round(cast(w.{v} as double), 6) + 0.0 as v{j + 1}" for j, v in enumerate(values)]
        cols += [f"null::double as v{j + 1}" for j in range(len(values), widest)]
        rows.append(f"select b.symbol, b.date, {i} as cond_id, coalesce(w.{c.name}, false) as passed, "
                    f"{f'w.{at}' if at else 'null'}::date as at, {', '.join(cols)}, '' as words from deep b asof left join "
                    f"{last} w on w.symbol = b.symbol and w.date <= b.date")
    names = ", ".join(f"'{x}'" for x in q.SECTORS)
    rows.append(f"select b.symbol, b.date, {len(plans)} as cond_id, coalesce(industry in ({names}), false) as passed, null::date "
                f"as at, {', '.join(f'null::double as v{j + 1}' for j in range(widest))}, coalesce('sector=' || industry, '') as "
                "words from deep b left join universe u on u.symbol = b.symbol")
    deep = "deep as materialized (select symbol, date from (select *, count(*) over (partition by symbol) as n from bars) where n >= 60)"
    return statement([B, WEEKLY_BARS, deep, *ctes], " union all ".join(rows))


def _rank_evidence_sql() -> str:
    conds = q.RANK_EVIDENCE_SCREEN
    ctes, last = signal_ctes(conds, ["mom_12_1", "atr_pct"])
    values = [("ret_63", "ret_63_pctl"), ("mom_12_1", "mom_12_1_pctl"),
              ("atr_pct", "atr_pct_pctl"), ("sector_rank_63", "n_sectors_63", "sector_ret_63"),
              ("pct_above_200dma", "pct_at_20d_high")]
    ctes.append("lead3 as (select d, string_agg(industry || ' (' || printf('%.2f', sector_ret_63) || '%)', ', ' order by "
                "sector_ret_63 desc, industry) as leaders from (select *, row_number() over (partition by d order by "
                "sector_ret_63 desc, industry) as k from sr_63) where k <= 3 group by d)")
    rows = []
    for i, (c, vals) in enumerate(zip(conds, values)):
        cols = [f"round(cast({v} as double), 6) as v{j + 1}" for j, v in enumerate(vals)]
        cols += [f"null::double as v{j + 1}" for j in range(len(vals), 3)]
        words = ("coalesce(concat_ws(';', case when n_sectors_63 is not null then 'leaders=' || leaders end, 'sector=' || industry), '')"
                 if c.kind == "sector_rank" else "''")
        rows.append(f"select symbol, date, {i} as cond_id, {c.name} as passed, null::date as at, "
                    f"{', '.join(cols)}, {words} as words from {last} left join lead3 on lead3.d = {last}.date")
    return statement(ctes, " union all ".join(rows))


# ---------------------------------------------------------------- event study
HORIZONS = (5, 20, 60)


def forward_fields(horizons=HORIZONS) -> dict:
    f = {"entry": (("open",), f"case when lead(open) {W} > 0 then lead(open) {W} end")}
    for h in horizons:
        f[f"fwd_{h}"] = (("entry",), f"lead(close,{h}) {W}/entry - 1")
    return f


def baseline_ctes(gate: float, horizons=HORIZONS, p: str = "fb") -> list[str]:
    ctes, last = chain("bars", p, daily_fields() | forward_fields(horizons),
                       [f"fwd_{h}" for h in horizons] + ["median_turnover"] * bool(gate))
    test = f"coalesce(median_turnover >= {gate}, false)" if gate else "true"
    rows = " union all ".join(
        f"select date, {h} as horizon, avg(case when {test} then fwd_{h} end) as baseline "
        f"from {last} group by date" for h in horizons)
    return [*ctes, f"{p}_base as materialized ({rows})"]


def event_ctes(screens: dict, gate: float, cooldown: int = 20, horizons=HORIZONS,
               cost: float = 0.3) -> list[str]:
    every = list(dict.fromkeys(c for conds, _ in screens.values() for c in conds))
    f = daily_fields() | forward_fields(horizons)
    for c in every:
        f |= condition_fields(c)
    ctes, last = chain("bars", "d", f, [c.name for c in every] + ["entry"]
                       + [f"fwd_{h}" for h in horizons] + ["median_turnover"] * bool(gate))
    sig = " union all ".join(
        f"select '{k}' as screen_id, symbol, i from {last} where {combined(conds, logic)}{gated(gate)}"
        for k, (conds, logic) in screens.items())
    ctes += [
        f"sig as materialized ({sig})",
        f"nxt as materialized (select s.*, n.i as nx from (select *, i + {cooldown} as lim from sig) s "
        f"asof left join sig n on n.screen_id = s.screen_id and n.symbol = s.symbol and s.lim < n.i)",
        "kept as (select screen_id as ks, symbol as ky, min(i) as ki from sig group by 1, 2 "
        "union all select x.screen_id, x.symbol, x.nx from kept join nxt x on x.screen_id = ks "
        "and x.symbol = ky and x.i = ki where x.nx is not null)",
        *baseline_ctes(gate, horizons),
        f"ev_rows as materialized (" + " union all ".join(
            f"select ks as screen_id, ky as symbol, p.date as signal_date, {h} as horizon, "
            f"fwd_{h} as gross, fwd_{h} - {cost}::double/100 as net from kept join {last} p on "
            f"p.symbol = ky and p.i = ki where entry is not null" for h in horizons) + ")",
        "ev_long as materialized (select e.*, b.baseline, gross - baseline as excess_gross, "
        "net - baseline as excess_net from ev_rows e left join fb_base b on b.date = e.signal_date "
        "and b.horizon = e.horizon)",
    ]
    return ctes


def with_bars(ctes: list[str], select: str) -> str:
    return statement([B, *ctes], select)


def _horizon_stats_sql() -> str:
    parts = ["count(*) as n_events", "count(distinct signal_date) as event_dates",
             "count(*) < 30 as insufficient"]

    def shown(expr: str, name: str) -> str:
        return f"case when count(*) >= 30 then round({expr}, 6) end as {name}"

    parts += [shown("avg(gross)", "event_gross_mean"), shown("avg(net)", "event_net_mean"),
              shown("avg(baseline)", "baseline_mean")]
    for m in ("excess_gross", "excess_net"):
        parts += [shown(f"avg({m})", f"{m}_mean"),
                  shown(f"avg(cast({m} > 0 as int))", f"{m}_hit_rate"),
                  shown(f"avg(case when {m} <= {m}_p5 then {m} end)", f"{m}_worst5pct_mean"),
                  shown(f"max({m}_p5)", f"{m}_p5"), shown(f"max({m}_median)", f"{m}_median"),
                  shown(f"max({m}_p95)", f"{m}_p95")]
    ctes = event_ctes(q.STUDY_SCREENS, q.GATE)
    ctes += ["done as (select * from ev_long where excess_gross is not null and excess_net is not null)",
             "tails as (select screen_id, horizon, " + ", ".join(
                 f"quantile_cont({m}, {p}) as {m}_{k}" for m in ("excess_gross", "excess_net")
                 for k, p in (("p5", 0.05), ("median", 0.5), ("p95", 0.95)))
             + " from done group by 1, 2)"]
    return with_bars(ctes, f"select screen_id, horizon, {', '.join(parts)} from done "
                           f"join tails using (screen_id, horizon) group by 1, 2")


def _bootstrap_sql() -> str:
    h = f"mod({42 * MIX[0]} + b*{MIX[1]} + k*{MIX[2]}, {PRIME})"
    ctes = event_ctes(q.STUDY_SCREENS, q.GATE)
    ctes += ["by_date as (select screen_id, horizon, signal_date, avg(excess_net) as x from ev_long "
             "where excess_gross is not null and excess_net is not null group by 1, 2, 3)",
             "numbered as materialized (select screen_id, horizon, x, row_number() over (partition by screen_id, "
             "horizon order by signal_date) - 1 as k, count(*) over (partition by screen_id, horizon) as n from by_date)",
             f"h0 as (select screen_id, horizon, n, b, {h} as h from numbered, range(1000) r(b))"]
    for i, m in enumerate(MIX):
        ctes.append(f"h{i + 1} as (select screen_id, horizon, n, b, mod(h*(h + {m}) + {m}, {PRIME}) as h from h{i})")
    ctes.append(f"means as (select d.screen_id, d.horizon, b, avg(x) as mean from h{len(MIX)} d join numbered m on "
                "m.screen_id = d.screen_id and m.horizon = d.horizon and m.k = mod(h, d.n) group by 1, 2, 3)")
    return with_bars(ctes, "select screen_id, horizon, round(quantile_cont(mean, 0.05), 6) as lo5, "
                           "round(quantile_cont(mean, 0.95), 6) as hi95 from means group by 1, 2")


def _ema_gaps_sql() -> str:
    cols = {k: 2 / (k + 1) for k in (10, 50)}
    seed = ", ".join(f"x as y{k}" for k in cols)
    step = ", ".join(f"case when g.x is null or w.y{k} is null then coalesce(w.y{k}, g.x) else (power({1 - a}, w.gap)*w.y{k} "
                     f"+ {a}*g.x) / (power({1 - a}, w.gap) + {a}) end" for k, a in cols.items())
    shown = ", ".join(f"case when count(g.x) over (partition by g.symbol order by g.i) >= {k} then round(w.y{k}, 6) end "
                      f"as ema_{k}" for k in cols)
    return with_bars([
        "gaps as materialized (select symbol, date, case when day(date) not in (3, 4, 17) then close end as x, "
        "row_number() over (partition by symbol order by date) - 1 as i from bars)",
        f"walk as (select symbol as s, i as at, 1 as gap, {seed} from gaps where i = 0 union all select g.symbol, g.i, "
        f"case when g.x is null then w.gap + 1 else 1 end, {step} from walk w join gaps g on g.symbol = w.s and g.i = w.at + 1)"],
        f"select g.symbol, g.date, {shown} from gaps g join walk w on w.s = g.symbol and w.at = g.i")


def _any_width_sql() -> str:
    extra = {f"ema_{n}": (("close",), ("ewm", "close", f"2.0/{n + 1}", n)) for n in (5, 2)}
    extra |= {f"sma_{n}": (("close",), f"case when count(close) {tail(n)} >= {n} then avg(close) {tail(n)} end") for n in (7, 33)}
    return fields_sql([*extra], f"select symbol, date, {r(*extra)} from {{p}}", extra)


def _kept_runs_sql() -> str:
    """Matches of the newest bars, and those of the bars up to a date."""
    conds = PRESETS["tsmom_regime"]
    f = daily_fields()
    for c in conds:
        f |= condition_fields(c)
    ctes, selects = [B], []
    for k, (ts, where) in enumerate((("1997-06-30", f"where date <= date '{q.AS_OF}'"), ("1998-12-31", ""))):
        more, last = chain(f"bars_{k}", f"r{k}_", f, [c.name for c in conds], 0)
        ctes += [f"bars_{k} as materialized (select * from bars {where})", *more]
        selects.append(f"select 'tsmom_regime' as screen_id, '{ts}' as ts, '{ts}' as as_of, symbol, round(close, 6) as close "
                       f"from {last} where i = n - 1 and {combined(conds)} and symbol in (select symbol from bars group by 1 "
                       "having count(*) >= 60)")
    return statement(ctes, " union all ".join(selects))


def _gated_sql() -> str:
    rows = " union all ".join(f"select '{u}' as universe_id, {g} as gate" for u, g in UNIVERSES)
    return fields_sql(["median_turnover"], f"select universe_id, count(*) filter (median_turnover >= gate/5) as liquid "
                                           f"from (select * from {{p}} where i = n - 1) cross join ({rows}) group by 1")


def _sensitivity_sql() -> str:
    screens = variants(q.GRID_SCREEN)
    ctes = event_ctes(screens, 0.0, horizons=(20,))
    listed = " union all ".join(f"select '{k}' as screen_id" for k in screens)
    ctes += [f"listed as ({listed})",
             "cells as (select screen_id, count(*) as n_events, case when count(*) >= 30 then "
             "avg(excess_net) end as mean from ev_long where excess_gross is not null group by 1)",
             "grid as (select l.screen_id, coalesce(n_events, 0) as n_events, mean from listed l "
             "left join cells using (screen_id))",
             "varied as (select split_part(screen_id, '|', 1)::int as condition_index, "
             "split_part(screen_id, '|', 2) as param, split_part(screen_id, '|', 3)::int as step, "
             "n_events, mean as mean_excess_net, (select mean from grid where screen_id = 'base') "
             "as base_mean from grid where screen_id <> 'base')"]
    same = ("(mean_excess_net > 0) = (base_mean > 0) and abs(mean_excess_net) >= "
            "0.25*abs(base_mean)")
    return with_bars(ctes, f"""select condition_index, param, step, n_events,
 {r('mean_excess_net', 'base_mean')},
 coalesce(count(mean_excess_net) over g > 0 and base_mean <> 0 and
   bool_and(case when mean_excess_net is not null then {same} end) over g, false) as robust
 from varied window g as (partition by condition_index, param)""")


# ---------------------------------------------------------------- sizing
def sizing_ctes(method: str, max_positions: int = 15) -> list[str]:
    ctes, last = chain("bars", "d", daily_fields(), ["atr", "atr_pct", "roc_63"])
    cap = q.CAPITAL
    target = {
        "risk": f"floor({cap}*1.0/100/(2*atr))*entry",
        "equal": f"{cap}*(1.0/count(*) over (partition by portfolio_id))",
        "inverse_vol": f"{cap}*((1.0/atr_pct)/sum(1.0/atr_pct) over (partition by portfolio_id))",
    }[method]
    t = method
    return [*ctes, f"""{t}_cand as materialized (select cast(n_regionkey as varchar) as portfolio_id,
  row_number() over (partition by n_regionkey order by roc_63 desc nulls last, p.symbol) as rank,
  p.symbol, p.close as entry, atr, atr_pct, n_name as sector from {last} p
  join universe u on u.symbol = p.symbol join nation on n_name = u.industry where i = n - 1)""",
            f"""{t}_tgt as materialized (select *, {target}::double as target,
  row_number() over (partition by portfolio_id order by rank) as k from {t}_cand
  where rank <= {max_positions} and atr > 0)""",
            f"""{t}_fold as (
  select portfolio_id as pid, 0::bigint as k, 0::double as used,
    []::struct(s varchar, v double)[] as placed, 0::bigint as shares, 0::double as worth,
    null::varchar as reason from (select distinct portfolio_id from {t}_tgt)
  union all
  select pid, k, used + case when reason is null then worth else 0 end,
    case when reason is null then list_append(placed, {{'s': sector, 'v': worth}}) else placed end,
    shares, worth, reason from (
    select *, case when shares <= 0 and lft <= 0 then 'capital_spent'
      when shares <= 0 and room <= 0 then 'sector_full'
      when shares <= 0 then 'zero_shares'
      when worth < 5000 then 'small_ticket' end as reason from (
      select *, shares*entry as worth from (
        select *, floor(least(target, {cap}*15/100, greatest(room, 0), greatest(lft, 0))/entry)::bigint
          as shares from (
          select f.pid, c.k, f.used, f.placed, c.sector, c.entry, c.target,
            {cap}*30/100 - coalesce(list_sum([x.v for x in f.placed if x.s = c.sector]), 0) as room,
            {cap} - f.used as lft from {t}_fold f join {t}_tgt c on c.portfolio_id = f.pid
            and c.k = f.k + 1)))))""",
            f"""{t}_pos as materialized (select c.portfolio_id, c.rank::int as rank, c.symbol,
    c.sector, c.entry,
    case when f.reason is null and f.k is not null then f.shares end as shares,
    case when f.reason is null and f.k is not null then f.worth end as value,
    case when f.reason is null and f.k is not null then 100*f.worth/{cap} end as pct_of_capital,
    case when f.reason is null and f.k is not null then c.entry - 2*c.atr end as stop_level,
    case when f.reason is null and f.k is not null then f.shares*2*c.atr end as risk,
    case when c.rank > {max_positions} then 'over_count'
         when c.atr is null or c.atr <= 0 then 'no_atr' else f.reason end as reason,
    '{method}' as method
  from {t}_cand c left join {t}_tgt g on g.portfolio_id = c.portfolio_id and g.rank = c.rank
  left join {t}_fold f on f.pid = c.portfolio_id and f.k = g.k and f.k > 0)"""]


def _sizing_sql(method: str) -> str:
    return with_bars(sizing_ctes(method), "select portfolio_id, rank, symbol, sector, "
                     + r("entry", d=4) + ", shares, "
                     + r("value", "pct_of_capital", "stop_level", "risk", d=4)
                     + f", reason, method from {method}_pos")


def _sizing_summary_sql() -> str:
    a = sizing_ctes("risk")
    b = [c for c in sizing_ctes("equal") if c.startswith("equal_")]
    return with_bars([*a, *b, "pos as (select * from risk_pos union all select * from equal_pos)",
                      "sec as (select portfolio_id, method, sector, sum(value) as value, "
                      "min(case when reason is null then rank end) as first from pos "
                      "where reason is null group by 1, 2, 3)",
                      "big as (select portfolio_id, method, arg_max(sector, row(value, -first)) as "
                      "largest_sector from sec group by 1, 2)"],
                     f"""select portfolio_id, method, round(coalesce(sum(value), 0), 4) as deployed,
 round({q.CAPITAL} - coalesce(sum(value), 0), 4) as cash,
 round(coalesce(sum(risk), 0), 4) as portfolio_risk, any_value(largest_sector) as largest_sector,
 count(*) filter (reason is null) as n_positions
 from pos left join big using (portfolio_id, method) group by 1, 2""")


# ---------------------------------------------------------------- cohorts
COHORTS = f"""cohorts as (select n_name as cohort_id, 'screen_' || n_regionkey as screen_id,
  'all' as universe_id, case when n_nationkey % 3 = 0 then 'replay' else 'forward' end as mode,
  cast(date '{q.COHORT_ANCHOR}' + n_nationkey*20 as date) as anchor from nation),
members as (select industry as cohort_id, symbol,
  round_even(1.0::double/count(*) over (partition by industry), 6) as weight from universe),
entered as materialized (select c.*, e.entry_date, case when e.entry_date is null then 'pending'
  else 'active' end as status from cohorts c left join (select m.cohort_id, min(b.date) as entry_date
  from members m join cohorts c using (cohort_id) join bars b on b.symbol = m.symbol
  and b.date > c.anchor group by 1) e using (cohort_id)),
num as materialized (select *, row_number() over (partition by symbol order by date) - 1 as i,
  count(*) over (partition by symbol) as n from bars),
lastbar as (select symbol, close as last_close, date as last_date from num where i = n - 1 and n >= 60),
ent as materialized (select m.cohort_id, m.symbol, m.weight, e.entry_date, l.last_close, l.last_date,
  p.i as ei, case when p.i > 0 and p.open > 0 then p.open end as entry_price
  from members m join entered e using (cohort_id) left join lastbar l on l.symbol = m.symbol
  left join num p on p.symbol = m.symbol and p.date = e.entry_date and p.n >= 60
  where e.entry_date is not null),
hz as (select unnest([5, 20, 60]) as horizon),
mret as materialized (select ent.*, horizon, coalesce(x.close, last_close)/entry_price - 1 as ret,
  (entry_price is not null and x.close is null and last_close is not null)
    or last_date is null as stale
  from ent cross join hz left join num x on x.symbol = ent.symbol and x.i = ei - 1 + horizon),
cal as (select date, row_number() over (order by date) - 1 as day from (select distinct date from bars))"""
MILESTONES = """tot as (select cohort_id, entry_date, horizon, count(*) as n_symbols,
  count(*) filter (stale) as n_stale, sum(case when ret is not null then weight*ret end)
  / nullif(sum(case when ret is not null then weight end), 0) as gross from mret group by 1, 2, 3),
mile as materialized (select cohort_id, t.horizon, n_symbols, n_stale, gross,
  gross - 0.3::double/100 as net, baseline, gross - baseline as excess_gross,
  gross - 0.3::double/100 - baseline as excess_net from tot t join cal c on c.date = t.entry_date
  left join cal s on s.day = c.day - 1 left join fb_base b on b.date = s.date and b.horizon = t.horizon
  where c.day - 1 + t.horizon <= (select max(day) from cal))"""
MILE_COLS = "cohort_id, horizon, n_symbols, n_stale, " + r(
    "gross", "net", "baseline", "excess_gross", "excess_net")


def cohort_sql(select: str, *more: str) -> str:
    return with_bars([COHORTS, *more], select)


def mile_sql(select: str, *more: str) -> str:
    return with_bars([COHORTS, *baseline_ctes(0.0), MILESTONES, *more], select)


CARD = """, count(*) as n_cohorts, sum(n_symbols)::bigint as n_names,
  not (sum(n_symbols) >= 20 and count(excess_net) > 0) as insufficient,
  case when sum(n_symbols) >= 20 then avg(excess_net) end as mean_excess_net,
  case when sum(n_symbols) >= 20 then median(excess_net) end as median_excess_net,
  case when sum(n_symbols) >= 20 then avg(cast(excess_net > 0 as int)) end as hit_rate"""


def _scorecard_sql() -> str:
    study = event_ctes({"screen_0": q.STUDY_SCREENS["pullback"]}, 0.0)
    return with_bars([COHORTS, *study, MILESTONES, f"""card as (select screen_id, universe_id, mode,
  horizon{CARD} from mile join entered using (cohort_id) group by 1, 2, 3, 4)""",
                      "isx as (select screen_id, horizon, avg(excess_net) as in_sample_mean "
                      "from ev_long group by 1, 2)"],
                     "select screen_id, universe_id, mode, horizon, n_cohorts, n_names, "
                     "insufficient, " + r("mean_excess_net", "median_excess_net", "hit_rate",
                                          "in_sample_mean")
                     + " from card left join isx using (screen_id, horizon)")


def _retirement_sql() -> str:
    return mile_sql(f"""select 'screen' as screen_id, 'all' as universe_id, n_cohorts, days_elapsed,
 n_cohorts >= 6 and days_elapsed >= 90 as eligible,
 case when not (n_cohorts >= 6 and days_elapsed >= 90) or insufficient then 'insufficient_evidence'
   when mean_excess_net < 0 or hit_rate < 0.45 then 'retire' else 'retain' end as verdict,
 {r('mean_excess_net', 'hit_rate')} from (select count(*) as n_cohorts,
   datediff('day', min(entry_date), date '{q.AS_OF}')::int as days_elapsed from entered
   where mode = 'forward') cross join (select 1 as one{CARD.replace('count(*) as n_cohorts, ', '')}
   from mile join entered using (cohort_id) where mode = 'forward' and horizon = 20)""")


def perf_ctes(end: object = None) -> str:
    """Curves from entry to the last day, or the last one at or before ``end``."""
    return PERF.replace("from cal where date <= date 'END'", f"from cal where date <= date '{end}'" if end else "from cal")


PERF = f"""perf as materialized (select m.cohort_id, m.symbol, m.weight, m.entry_price, c.day, c.date,
    b.close, s.day as start_day, e.day as end_day, m.last_date < e.date as stale
  from ent m join cal s on s.date = m.entry_date
  join (select date, day from cal where date <= date 'END' order by date desc limit 1) e
    on e.date > m.entry_date
  join cal c on c.day between s.day and e.day
  asof join bars b on b.symbol = m.symbol and b.date <= c.date
  where m.entry_price is not null),
curves as materialized (select *, 100*close/entry_price as curve from perf),
line as materialized (select cohort_id, day, date, start_day, end_day,
  sum(weight*curve)/sum(weight) as curve from curves group by all),
dmove as (select date, avg(ret) as ret from (select date, close/lag(close) {W} - 1 as ret
  from (select * from num where n >= 60)) group by 1),
idx as materialized (select l.*, 100*product(1 + case when day = start_day then 0 else coalesce(ret, 0) end)
   over (partition by cohort_id order by day) as baseline,
   100*benchmark/first_value(benchmark) over (partition by cohort_id order by day) as benchmark
  from line l left join dmove using (date) left join bench using (date))"""


def drawdown_ctes(source: str, keys: str, name: str) -> list[str]:
    return [
        f"{name}_p as (select *, max(curve) over (partition by {keys} order by day) as top from {source})",
        f"{name}_d as materialized (select *, curve/top - 1 as dd from {name}_p)",
        f"{name}_t as (select {keys}, arg_min(day, row(dd, day)) as trough_day, min(dd) as "
        f"max_drawdown, arg_min(top, row(dd, day)) as top from {name}_d group by {keys})",
        f"{name} as materialized (select t.*, (select min(c.day) from {source} c where "
        + " and ".join(f"c.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
        + f" and c.curve = t.top) as peak_day from {name}_t t)",
    ]


def _performance_sql() -> str:
    return cohort_sql(f"""select cohort_id, n_bars, {r('gross', 'gross - 0.3::double/100 as net',
        'gross - base as excess_gross_baseline', 'gross - base as excess_net_baseline',
        'gross - ix as excess_gross_benchmark', 'gross - ix as excess_net_benchmark',
        'sd*sqrt(252) as annualized_vol',
        'case when n_bars >= 60 then mean/nullif(sd, 0)*sqrt(252) end as sharpe', 'max_drawdown')},
 peak_day, trough_day, {r('hit_rate_positive', 'hit_rate_vs_baseline')}
 from ends join dd using (cohort_id) join (select cohort_id,
   avg(cast(curve/100 - 1 > 0 as int)) as hit_rate_positive,
   avg(cast(curve/100 - 1 > base as int)) as hit_rate_vs_baseline
   from curves join ends using (cohort_id) where day = end_day group by 1) using (cohort_id)""",
                      perf_ctes(q.END), *drawdown_ctes("line", "cohort_id", "dd"),
                      """mv as (select *, curve/lag(curve) over (partition by cohort_id order by day) - 1
                         as ret1 from idx)""",
                      """ends as materialized (select cohort_id, any_value(end_day - start_day + 1) as n_bars,
   max(curve) filter (day = end_day)/100 - 1 as gross,
   max(baseline) filter (day = end_day)/100 - 1 as base,
   max(benchmark) filter (day = end_day)/100 - 1 as ix, stddev_samp(ret1) as sd, avg(ret1) as mean
   from mv group by 1)""")


# ---------------------------------------------------------------- quality
SUSPECT = """clean_store as (select symbol, date, open, high,
    case when day(date) = 13 and month(date) = 1 then 0.0 else low end as low,
    case when day(date) = 20 and month(date) = 7 then close/2 else close end as close,
    case when date >= date '1998-08-01' then 0.0 else volume end as volume from bars),
store as materialized (select * from (select * from clean_store union all select * from clean_store
  where day(date) = 28 and month(date) = 2)
  where symbol not in (select symbol from universe where industry = 'NATION_5'))"""


def check_sql(name: str, inner: str, status: str, value: str, bad: str) -> str:
    return (f"select '{name}' as check_name, {status} as status, round(cast({value} as double), 6) as value, "
            f"cast({bad} as bigint) as bad from ({inner})")


def grade(ok: str, other: str) -> str:
    return f"case when {ok} then 'PASS' else '{other}' end"


JUMPS = ("select * from (select symbol, date, lag(close) over (partition by symbol order by date) as "
         "prev_close, close from store) where abs(close/prev_close - 1) > 0.4")
CHECKS = {
    "check_coverage": check_sql(
        "coverage", "select (select count(distinct symbol) from store) as got, "
        "(select count(*) from universe) as want, (select count(*) from universe where symbol not in "
        "(select symbol from store)) as gone",
        "case when 100.0*got/want >= 97 then 'PASS' when 100.0*got/want >= 90 then 'WARN' else 'FAIL' end",
        "100.0::double*got/want", "gone"),
    "check_freshness": check_sql(
        "freshness", "select datediff('day', max(date), date '1998-12-03') as age from store",
        grade("age <= 5", "FAIL"), "age", "age > 5"),
    "check_history_depth": check_sql(
        "depth", "select datediff('day', min(date), max(date))/365.25::double as span from store",
        grade("span >= 4.5", "WARN"), "span", "not span >= 4.5"),
    "check_symbol_depth": check_sql(
        "symbol_depth", "select count(*) filter (n < 250) as thin, count(*) as tot from "
        "(select symbol, count(*) as n from store group by 1)",
        grade("thin <= 0.05*tot", "WARN"), "tot", "thin"),
    "check_bar_integrity": check_sql(
        "integrity", f"select count(*) filter ({BAD}) as bad, count(*) as n from store",
        grade("bad = 0", "FAIL"), "n", "bad"),
    "check_duplicates": check_sql(
        "duplicates", "select sum(n - 1) as bad, sum(n) as n from (select count(*) as n from store "
        "group by symbol, date)", grade("bad = 0", "FAIL"), "n", "bad"),
    "check_volume_liveness": check_sql(
        "liveness", "select count(*) filter (z > 0.5) as bad, count(*) as n from (select symbol, "
        "avg(cast(volume = 0 as int)) as z from (select *, row_number() over (partition by symbol "
        "order by date desc) as k from store) where k <= 20 group by 1)",
        grade("bad = 0", "WARN"), "n", "bad"),
    "check_adjustment_smell": check_sql(
        "jumps", f"select (select count(*) from ({JUMPS})) as bad, "
        "(select count(distinct symbol) from store) as n",
        grade("bad <= greatest(2, n // 100)", "WARN"), "n", "bad"),
}
BENCH_CHECK = check_sql(
    "benchmark", "select count(*) as n, datediff('day', max(date), date '{d}') as age from bench",
    "case when n = 0 then 'FAIL' when age <= 5 then 'PASS' else 'WARN' end", "n",
    "not (n > 0 and age <= 5)")


def spot_ctes(source: str) -> list[str]:
    ctes, last = chain(source, "k", daily_fields(), ["rsi", "ema_50"])
    return [f"longest as (select symbol from (select symbol, count(*) as c from {source} group by 1) "
            f"where c >= 60)", *ctes,
            f"spot as (select symbol, rsi, close, ema_50, count(rsi) over z as kr, count(ema_50) over z "
            f"as ke from {last} where symbol in (select symbol from longest) window z as "
            f"(partition by symbol order by date desc))",
            "spot1 as (select symbol, bool_or(kr <= 250 and not (rsi between 0 and 100)) as rb, "
            "avg(case when ke <= 250 then abs(close/ema_50 - 1) end) as g from spot group by 1)"]


SPOT = (check_sql("rsi_range", "select count(*) as n, count(*) filter (rb) as bad from spot1",
                  grade("bad = 0", "FAIL"), "n", "bad") + " union all "
        + check_sql("ema_distance",
                    "select count(*) as n, count(*) filter (g > 0.15) as bad from spot1",
                    grade("bad = 0", "WARN"), "n", "bad"))
DIFF = """diff as materialized (select a.symbol, a.date, a.close as close_a, b.close as close_b,
  abs(100*(b.close/a.close - 1)) as pct_diff from bars a join (select symbol, date,
  close*(1 + (day(date) - 15)/2000.0::double) as close from bars where day(date) > 5) b
  on b.symbol = a.symbol and b.date = a.date)"""
CROSS_CHECK = check_sql("cross-source", "select count(*) as n, count(*) filter (pct_diff > 0.5) as bad from diff",
                        grade("n > 0 and bad = 0", "WARN"), "n", "bad")
RUN_LOG = check_sql(
    "screen log", "select count(*) as n, count(*) filter (day(cast(o_orderdate as date)) in (4, 11)) "
    "as bad from orders", "case when n = 0 then 'WARN' when bad = 0 then 'PASS' else 'FAIL' end",
    "n", "bad")


def statements() -> dict[str, str]:
    out = {
        "flagship": statement(evaluated(q.FLAGSHIP), "select symbol, name, industry, date, "
                              + r("close", "vol_ratio", "ret_3m_pct") + " from ev where matched"),
        "read_bars": sql(select="select * from bars"),
        "clean_bars": sql(select=f"select * from ({DIRTY}) where not {BAD}"),
        "upsert_bars": sql(select=f"""select symbol, date, {times('2')}, volume from bars
 where date >= date '1996-06-01' union all select * from bars where date < date '1996-06-01'"""),
        "replace_symbols": sql(
            "owed as (select cast(s_suppkey as varchar) as symbol from supplier where s_acctbal < 2000)",
            select=f"""select * from bars where symbol not in (select symbol from owed) union all
 select symbol, date, {times('0.5')}, volume from bars where symbol in (select symbol from owed)
 and date >= date '1995-01-01'"""),
        "exchange_rows": sql(select=EXCHANGE),
        "append_days": sql(
            "edge as (select max(date) as d from bars where date <= date '1997-06-30')",
            select=f"""select * from bars where date <= date '1997-06-30' union all
 select symbol, date, {times('3')}, volume from bars, edge where date > d"""),
        "adjustment_factor": SUBJECTS,
        "corporate_actions": sql(ACTIONS, select="select * from actions"),
        "cumulative_factors": sql(ACTIONS, CUM, select="select symbol, ex_date, factor, "
                                                       "cum_factor from cum"),
        "adjusted_bars": sql(ACTIONS, CUM, select=ADJUSTED),
        "universe_index_list": sql(select="select symbol, name, industry from universe"),
        "universe_full_listing": sql(select="select symbol, name, null::varchar as industry from "
                                            "universe where industry <> 'NATION_5'"),
        "universe_curated": sql(select="select symbol, name, null::varchar as industry from universe "
                                       "where industry in ('NATION_3', 'NATION_7', 'NATION_11')"),
        "benchmark": sql(select="select date, round(benchmark, 6) as close from bench"),
        "benchmark_filled": sql(select="select d.date, round(b.benchmark, 6) as close from (select "
                                       "distinct date from bars) d asof left join (select * from bench "
                                       "where day(date) = 1) b on b.date <= d.date"),
        "asof_join": sql(select="""select cast(l_suppkey as varchar) as symbol, l.date, l_orderkey,
 l_linenumber, b.close, b.date as bar_date from (select *, cast(o_orderdate as date) as date,
 cast(l_suppkey as varchar) as sy from lineitem join orders on o_orderkey = l_orderkey) l
 asof left join bars b on b.symbol = l.sy and b.date <= l.date"""),
        "store_freshness": sql(select="select max(date) as latest, datediff('day', max(date), "
                                      "date '1998-12-03')::int as age_days, datediff('day', max(date), "
                                      "date '1998-12-03') <= 5 as fresh from bars"),
        "deep_symbols": sql(select="select symbol, count(*) as bars from bars group by 1 having count(*) >= 530"),
        "shared_calendar": sql(select="select date, (row_number() over (order by date) - 1)::int as day "
                                      "from (select distinct date from bars)"),
        "weekly_bars": sql(WEEKLY_BARS, select="select * from weekly_bars"),
        "weekly_indicators": weekly_panel_sql(WEEKLY_FIELDS),
        "pivots": fields_sql(["pivot_high", "pivot_low"], "select symbol, date, pivot_high, pivot_low "
                             "from {p} where pivot_high or pivot_low"),
        "nearest_levels": panel_sql(["close", "support", "resistance"]),
        "asof_universe_rows": sql(select="""select d.date as as_of, b.symbol, b.date, b.close from (select
 distinct date from bars) d join (select distinct symbol as s from bars) on true
 asof join bars b on b.symbol = s and b.date <= d.date"""),
        "screen_match_table": screen_sql(f"select {METRIC_COLS} from ev where matched", str(q.AS_OF)),
        "kept_match_table": screen_sql(f"select {METRIC_COLS} from ev where matched", str(q.AS_OF)),
        "screen_shown_matches": screen_sql(
            "select symbol, name, industry, date, conditions_passed, conditions_total, matched, "
            + ", ".join(f"round_even({x}, {d}) as {x}" for x, d in DISPLAY_DECIMALS.items())
            + " from ev where matched"),
        "screen_top_matches": screen_sql("select symbol, round(ret_3m_pct, 6) as ret_3m_pct from ev where "
                                         "matched order by ret_3m_pct desc nulls last, symbol limit 10"),
        "screen_near_misses": screen_sql(f"select {METRIC_COLS} from ev where conditions_passed = "
                                         "conditions_total - 1"),
        "screen_stats": screen_sql(
            f"select count(*) as universe, count(*) filter (not ok) as liquidity_excluded, count(*) filter (ok) as "
            "evaluated, count(*) filter (ok and matched) as matched, count(*) filter (ok and not matched and "
            "conditions_passed = conditions_total - 1) as near_misses from (select *, "
            f"coalesce(turnover_cr >= {q.GATE}, false) as ok from ev)", gate=0.0),
        "screen_sector_gap": sql(select="select true as needs_sector, count(industry) as "
                                        "symbols_with_sector, count(industry) = 0 as gap from universe"),
        "screen_recent_bars": fields_sql(
            ["ema_50", "support"], "select symbol, date, " + r("close", "low", "high", "ema_50", "support")
            + " from {p} where i >= n - 60"),
        "screen_quality_flags": sql(
            "cut as (select symbol, date, case when date >= date '1998-06-01' then close*0.5 else close "
            "end as close from bars)",
            "mv as (select *, row_number() over (partition by symbol order by date) as k, count(*) over "
            "(partition by symbol) as n, abs(100*(close/lag(close) over (partition by symbol order by date)"
            "-1)) as mv from cut)",
            "per as (select symbol, max(case when k > n - 59 then mv end) as mx, arg_max(date, case when "
            "k > n - 59 then mv end) as jd, any_value(n) as n, max(date) as lb from mv where n >= 60 group by 1)",
            select="select symbol, coalesce(mx > 40, false) as jump, case when mx > 40 then jd end as "
                   "jump_date, n < 530 as thin_history, lb < (select max(date) from bars) as stale from per"),
        "screen_liquidity_gate": signal_bars_sql([q.trend("up")], gate=0.3),
        "screen_batch": _batch_sql(),
        "screen_run_diff": _run_diff_sql(),
        "screen_watchlist": _watchlist_sql(),
        "evidence": _evidence_sql(),
        "evidence_ranks": _rank_evidence_sql(),
        "evidence_weekly": _weekly_evidence_sql(),
        "panel_all_fields": panel_sql(DAILY_FIELDS),
        "kept_panel": panel_sql(q.KEPT_FIELDS),
        "kept_runs": _kept_runs_sql(),
        "kept_milestones": mile_sql("select cohort_id, horizon, n_symbols, n_stale, " + r("gross", "net") + " from mile"),
        "gated_universes": _gated_sql(),
        "indicator_any_width": _any_width_sql(),
        "event_baseline": with_bars(baseline_ctes(q.GATE), "select date, horizon, round(baseline, 6) as "
                                                           "baseline from fb_base"),
        "daily_baseline": fields_sql(
            ["prev_close", "median_turnover"], "select date, round(avg(case when median_turnover >= "
            f"{q.GATE} then close/prev_close - 1 end), 6) as ret from {{p}} group by date"),
        "events": with_bars(event_ctes(q.STUDY_SCREENS, q.GATE),
                            "select screen_id, symbol, signal_date, " + ", ".join(
                                f"round(max(case when horizon = {h} then {m} end), 6) as {m}_{h}"
                                for m in ("gross", "net", "baseline", "excess_gross", "excess_net")
                                for h in HORIZONS) + " from ev_long group by 1, 2, 3"),
        "horizon_stats": _horizon_stats_sql(),
        "bootstrap_interval": _bootstrap_sql(),
        "indicator_ema_gaps": _ema_gaps_sql(),
        "event_timeline": with_bars(event_ctes(q.STUDY_SCREENS, q.GATE),
                                    "select screen_id, strftime(signal_date, '%Y-%m') as month, "
                                    "count(*) as n_events from ev_long where horizon = 5 group by 1, 2"),
        "sensitivity_grid": _sensitivity_sql(),
        "sizing_candidates": with_bars(
            sizing_ctes("risk", 10), "select portfolio_id, rank::int as rank, symbol, "
            + r("entry", "atr", "atr_pct") + ", sector, case when rank > 10 then 'over_count' "
            "when atr is null or atr <= 0 then 'no_atr' end as reason from risk_cand"),
        "sizing_summary": _sizing_summary_sql(),
        "cohort_equal_weights": cohort_sql("select * from members"),
        "cohort_value_weights": "select s_nationkey as cohort_id, cast(s_suppkey as varchar) as symbol, "
                                "round_even((s_acctbal + 2000)/sum(s_acctbal + 2000) over (partition by "
                                "s_nationkey), 6) as weight from supplier",
        "cohort_resolve_as_of": cohort_sql(
            "select cohort_id, as_of, case when as_of < (select max(date) from bars) then (select "
            "max(date) from bars b where b.date <= as_of) end as resolved_as_of from (select cohort_id, "
            "cast(anchor + interval 30 month as date) as as_of from cohorts)"),
        "cohort_entry_dates": cohort_sql("select cohort_id, anchor, entry_date, status from entered"),
        "cohort_member_returns": cohort_sql("select cohort_id, symbol, round(weight, 6) as weight, "
                                            "entry_date, horizon, round(ret, 6) as ret, stale from mret"),
        "cohort_milestones": mile_sql(f"select {MILE_COLS} from mile"),
        "cohort_freeze": mile_sql(f"select {MILE_COLS} from mile where horizon <> 5"),
        "cohort_status": mile_sql("select cohort_id, case when status = 'active' and cohort_id in (select "
                                  "cohort_id from mile where horizon = 60) then 'completed' else status "
                                  "end as status from entered"),
        "cohort_snapshot": cohort_sql(
            "select cohort_id, count(*) as n_symbols, count(ret) as n_marked, round(g, 6) as gross, "
            "round(g - 0.3::double/100, 6) as net from (select *, sum(case when ret is not null then "
            "weight*ret end) over (partition by cohort_id)/sum(case when ret is not null then weight end) "
            "over (partition by cohort_id) as g from (select *, last_close/entry_price - 1 as ret from ent)) "
            "group by cohort_id, g"),
        "cohort_delete": cohort_sql(
            "select cohort_id, case when length(cohort_id) > 8 then 'deleted' else status end as status, "
            "case when length(cohort_id) > 8 then 'no longer followed' end as delete_reason from entered "
            "where mode <> 'replay' and status <> 'pending'"),
        "cohort_deleted_forward": cohort_sql(
            "select screen_id, universe_id, count(*) as n_deleted, 'closed' as reasons from entered where "
            "mode = 'forward' and status <> 'pending' group by 1, 2"),
        "cohort_scorecard": _scorecard_sql(),
        "cohort_retirement": _retirement_sql(),
        "equity_curves": cohort_sql("select cohort_id, date, " + r("curve", "baseline", "benchmark")
                                    + " from idx", perf_ctes()),
        "member_performance": cohort_sql(
            "select cohort_id, symbol, " + r("share", "entry_price", "close as end_price") + ", stale, "
            + r("ret as return_gross", "ret - 0.3::double/100 as return_net", "ret - base as excess_gross",
                "ret - base as excess_net", "share*ret as contribution_gross",
                "max_drawdown") + " from (select *, weight/sum(weight) over (partition by cohort_id) as "
            "share, curve/100 - 1 as ret from curves where day = end_day) join mdd using (cohort_id, symbol) "
            "left join (select cohort_id, baseline/100 - 1 as base from idx where day = end_day) using (cohort_id)",
            perf_ctes(), *drawdown_ctes("curves", "cohort_id, symbol", "mdd")),
        "cohort_performance": _performance_sql(),
        "check_missing_symbols": sql(SUSPECT, select="select symbol from universe where symbol not in "
                                                     "(select symbol from store)"),
        "check_jumps": sql(SUSPECT, select="select symbol, date, " + r(
            "prev_close", "close", "100*(close/prev_close-1) as move_pct", "close/prev_close as ratio")
            + ", abs(close/prev_close-0.5) < 0.03 or abs(close/prev_close-0.2) < 0.02 or "
            "abs(close/prev_close-0.1) < 0.01 or abs(close/prev_close-0.25) < 0.02 as split_like "
            f"from ({JUMPS})"),
        "check_benchmark": sql(select=BENCH_CHECK.format(d="1998-12-10")),
        "check_spot_checks": with_bars(spot_ctes("bars"), SPOT),
        "check_cross_source": sql(DIFF, select="select count(*) as n, round(median(pct_diff), 6) as "
                                               "median_diff, round(max(pct_diff), 6) as max_diff, count(*) "
                                               "filter (pct_diff > 0.5) as bad from diff"),
        "check_source_divergence": sql(DIFF, select="select symbol, date, " + r(
            "close_a", "close_b", "pct_diff") + " from diff"),
        "check_run_log": RUN_LOG,
        "check_report": with_bars(
            [SUSPECT, DIFF.replace("from bars a", "from (select symbol, date, max(close) as close from store group by 1, 2) a"), *spot_ctes("store")], "select check_name, status, bad from (" + " union all ".join(
                [*CHECKS.values(), BENCH_CHECK.format(d="1998-12-03"), SPOT, CROSS_CHECK]) + ")"),
    }
    for name, select in CHECKS.items():
        out[name] = sql(SUSPECT, select=select)
    for method in ("risk", "inverse_vol", "equal"):
        out[f"sizing_{method}"] = _sizing_sql(method)
    fwd = daily_fields() | forward_fields()
    ctes, last = chain("bars", "d", fwd, [f"fwd_{h}" for h in HORIZONS])
    out["forward_returns"] = with_bars(ctes, " union all ".join(
        f"select symbol, date, {h} as horizon, round(fwd_{h}, 6) as gross from {last}" for h in HORIZONS))
    ctes, last = chain("bars", "d", daily_fields(), ["sma_200", "prior_high"])
    out["breadth"] = with_bars(ctes, f"select date, {r('pct_above_200dma', 'pct_at_20d_high')}, n_symbols "
                                     f"from ({breadth_select(last)})")
    ctes, last = chain("bars", "d", daily_fields(), ["support"])
    out["sr_levels"] = with_bars(ctes, "select l.symbol, b.date, round(level, 10) as level, touches::int as "
                                       f"touches from d2_lev l join {last} b on b.symbol = l.symbol and b.i = l.i")
    ctes, last = signal_ctes([q.rs_percentile(">=", 0), q.rs_percentile(">=", 0, basis="mom_12_1"),
                              q.atr_pct_percentile(">=", 0), q.sector_rank(63, top=1)])
    out["cross_section"] = statement(ctes, "select symbol, date, industry, round(ret_63, 6) as ret_63, "
                                     "ret_63_pctl, mom_12_1_pctl, atr_pct_pctl, round(sector_ret_63, 6) as "
                                     f"sector_ret_63, sector_rank_63, n_sectors_63 from {last}")
    for name, fields in q.INDICATORS.items():
        out[f"indicator_{name}"] = panel_sql(fields, q.decimals_of(fields))
    for name, condition in q.CONDITIONS.items():
        out[f"condition_{name}"] = signal_bars_sql([condition])
    for name in PRESETS:
        out[f"preset_{name}"] = signal_bars_sql(q.preset_conditions(name))
    return out
