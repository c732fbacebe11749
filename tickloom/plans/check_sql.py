"""SQL statements of the same results for an independent engine (DuckDB).

A statement is a chain of CTEs over the order-line bars. Recursive smoothing is
written as a recursion over the bar position, levels as gaps and islands over a
range join, ranks with window functions: none of it shares its method with the
DataFrame plans it checks.
"""

from collections.abc import Iterable, Sequence

from ..operators.conditions import Condition
from ..schema import EMA_PERIODS, ROC_PERIODS, SMA_PERIODS, WEEKLY_EMA_PERIODS

BARS = """
px as (select l_suppkey as sk, cast(l_shipdate as date) as dt,
         sum(cast(round(l_extendedprice) as bigint)) as h,
         cast(sum(l_quantity) as bigint) as q
       from lineitem group by 1, 2),
moves as (select sk, dt, q, (h % 401) - 200 as bp, h % 97 as u, h % 89 as v,
            case when h % 13 = 0 then 300 when h % 17 = 0 then -300 else 0 end as gp from px),
path as (select *, sum(bp) over (partition by sk order by dt
                                 rows unbounded preceding) as cum from moves),
cents as (select sk, dt, q, u, v,
            cast(round(10000*exp(cast(cum as double)/10000.0)) as bigint) as c0,
            cast(round(10000*exp(cast(cum-bp+gp as double)/10000.0)) as bigint) as o0 from path),
bars as materialized (
  select cast(sk as varchar) as symbol, dt as date, o0/100.0::double as open,
    (greatest(o0,c0)+u)/100.0::double as high, (least(o0,c0)-v)/100.0::double as low,
    c0/100.0::double as close, cast(q*1000 as double) as volume from cents),
universe as (select cast(s_suppkey as varchar) as symbol, s_name as name, n_name as industry
  from supplier left join nation on s_nationkey = n_nationkey),
bench as (select date, avg(close) as benchmark from bars group by date)"""

W = "over (partition by symbol order by date)"


def tail(n: int) -> str:
    return f"over (partition by symbol order by date rows between {n - 1} preceding and current row)"


def rolling(agg: str, x: str, n: int, least: int | None = None) -> str:
    return (f"case when count({x}) {tail(n)} >= {n if least is None else least} "
            f"then {agg}({x}) {tail(n)} end")


# field -> (columns read, expression), or (columns read, ("ewm", input, alpha, min_periods))
def _ewm(x: str, alpha: str, n: int):
    return ((x,), ("ewm", x, alpha, n))


def _pct(a: str, b: str) -> str:
    return f"100*({a}/nullif({b},0)-1)"


def daily_fields() -> dict:
    f = {
        "prev_close": (("close",), f"lag(close) {W}"),
        "prev_open": (("open",), f"lag(open) {W}"),
        "prev_high": (("high",), f"lag(high) {W}"),
        "prev_low": (("low",), f"lag(low) {W}"),
        "gain": (("close", "prev_close"), "case when prev_close is not null "
                 "then greatest(close-prev_close, 0) end"),
        "loss": (("close", "prev_close"), "case when prev_close is not null "
                 "then greatest(prev_close-close, 0) end"),
        "avg_gain": _ewm("gain", "1.0/14", 14),
        "avg_loss": _ewm("loss", "1.0/14", 14),
        "rsi": (("avg_gain", "avg_loss"), "100-100/(1+avg_gain/nullif(avg_loss,0))"),
        "tr": (("prev_close",), "greatest(high-low, abs(high-prev_close), abs(low-prev_close))"),
        "atr": _ewm("tr", "1.0/14", 14),
        "atr_pct": (("atr",), "100*atr/close"),
        "pdm": (("prev_high", "prev_low"), "case when high-prev_high > prev_low-low "
                "and high-prev_high > 0 then high-prev_high else 0 end"),
        "mdm": (("prev_high", "prev_low"), "case when prev_low-low > high-prev_high "
                "and prev_low-low > 0 then prev_low-low else 0 end"),
        "pdm_avg": _ewm("pdm", "1.0/14", 14),
        "mdm_avg": _ewm("mdm", "1.0/14", 14),
        "plus_di": (("pdm_avg", "atr"), "100*pdm_avg/nullif(atr,0)"),
        "minus_di": (("mdm_avg", "atr"), "100*mdm_avg/nullif(atr,0)"),
        "dx": (("plus_di", "minus_di"), "100*abs(plus_di-minus_di)/nullif(plus_di+minus_di,0)"),
        "adx": _ewm("dx", "1.0/14", 14),
        "adx_slope": (("adx",), f"adx - lag(adx,5) {W}"),
        "hh14": (("high",), rolling("max", "high", 14)),
        "ll14": (("low",), rolling("min", "low", 14)),
        "raw_k": (("hh14", "ll14"), "100*(close-ll14)/nullif(hh14-ll14,0)"),
        "stoch_k": (("raw_k",), rolling("avg", "raw_k", 3)),
        "stoch_d": (("stoch_k",), rolling("avg", "stoch_k", 3)),
        "ema_12": _ewm("close", "2.0/13", 12),
        "ema_26": _ewm("close", "2.0/27", 26),
        "macd": (("ema_12", "ema_26"), "ema_12-ema_26"),
        "macd_signal": _ewm("macd", "2.0/10", 9),
        "macd_hist": (("macd", "macd_signal"), "macd-macd_signal"),
        "sd20": (("close",), rolling("stddev_samp", "close", 20)),
        "bb_upper": (("sma_20", "sd20"), "sma_20+2*sd20"),
        "bb_lower": (("sma_20", "sd20"), "sma_20-2*sd20"),
        "bb_width_pct": (("bb_upper", "bb_lower", "sma_20"), "100*(bb_upper-bb_lower)/sma_20"),
        "vol_avg_20": (("volume",), rolling("avg", "volume", 20)),
        "vol_ratio": (("vol_avg_20",), "volume/nullif(vol_avg_20,0)"),
        "turnover_cr": (("close",), "close*volume/1e7"),
        "median_turnover": (("turnover_cr",), rolling("median", "turnover_cr", 20)),
        "high_52w": (("high",), rolling("max", "high", 252, 60)),
        "low_52w": (("low",), rolling("min", "low", 252, 60)),
        "pct_from_52w_high": (("high_52w",), _pct("close", "high_52w")),
        "pct_from_52w_low": (("low_52w",), _pct("close", "low_52w")),
        "mom_12_1": (("close",), _pct(f"lag(close,21) {W}", f"lag(close,252) {W}")),
        "pivot_high": (("high",), _pivot("high", "max")),
        "pivot_low": (("low",), _pivot("low", "min")),
        "support": (("pivot_high", "pivot_low"), "levels"),
        "resistance": (("pivot_high", "pivot_low"), "levels"),
        "benchmark": ((), "benchmark"),
        "industry": ((), "industry"),
        "bar_range": (("high",), "high-low"),
        "range_min_before": (("bar_range",), "case when count(bar_range) over six = 6 "
                             "then min(bar_range) over six end"),
        "gap_pct": (("prev_close",), _pct("open", "prev_close")),
        "prior_high": (("high",), "case when count(high) over twenty = 20 "
                       "then max(high) over twenty end"),
    }
    for n in EMA_PERIODS:
        f[f"ema_{n}"] = _ewm("close", f"2.0/{n + 1}", n)
        f[f"ema_{n}_slope"] = ((f"ema_{n}",), f"ema_{n} - lag(ema_{n},5) {W}")
    for n in SMA_PERIODS:
        f[f"sma_{n}"] = (("close",), rolling("avg", "close", n))
        f[f"sma_{n}_slope"] = ((f"sma_{n}",), f"sma_{n} - lag(sma_{n},5) {W}")
    for n in ROC_PERIODS:
        f[f"roc_{n}"] = (("close",), _pct("close", f"lag(close,{n}) {W}"))
    return f


def _pivot(x: str, agg: str) -> str:
    return f"coalesce(count({x}) over mid = 11 and {x} = {agg}({x}) over mid, false)"


def weekly_fields() -> dict:
    d = daily_fields()
    f = {k: d[k] for k in ("prev_close", "gain", "loss", "avg_gain", "avg_loss", "rsi")}
    for n in WEEKLY_EMA_PERIODS:
        f[f"ema_{n}"] = _ewm("close", f"2.0/{n + 1}", n)
        f[f"ema_{n}_slope"] = ((f"ema_{n}",), f"ema_{n} - lag(ema_{n},3) {W}")
    for n in (4, 13):
        f[f"roc_{n}"] = (("close",), _pct("close", f"lag(close,{n}) {W}"))
    return f


WINDOWS = """ window mid as (partition by symbol order by date
  rows between 5 preceding and 5 following),
 six as (partition by symbol order by date rows between 6 preceding and 1 preceding),
 twenty as (partition by symbol order by date rows between 20 preceding and 1 preceding)"""

BASE = {"symbol", "date", "open", "high", "low", "close", "volume", "i", "n"}


def chain(source: str, prefix: str, fields: dict, wanted: Iterable[str], min_bars: int = 60
          ) -> tuple[list[str], str]:
    """CTEs that add ``wanted`` to ``source`` level by level; returns them with the
    name of the last one."""
    level: dict[str, int] = {}

    def depth(name: str) -> int:
        if name in BASE:
            return 0
        if name not in level:
            level[name] = 1 + max((depth(r) for r in fields[name][0]), default=0)
        return level[name]

    for name in wanted:
        depth(name)
    last = f"{prefix}0"
    ctes = [f"{last} as materialized (select * from (select *, row_number() {W} - 1 as i, "
            f"count(*) over (partition by symbol) as n from {source}) where n >= {min_bars})"]
    for d in range(1, max(level.values(), default=0) + 1):
        names = sorted(x for x, k in level.items() if k == d)
        plain = [x for x in names if isinstance(fields[x][1], str)
                 and x not in ("support", "resistance", "benchmark", "industry")]
        ewms = [x for x in names if not isinstance(fields[x][1], str)]
        cols, joins, now = [f"{last}.*"], "", f"{prefix}{d}"
        cols += [f"{fields[x][1]} as {x}" for x in plain]
        if ewms:
            rec = f"{now}_ewm"
            seed = ", ".join(fields[x][1][1] + f" as {x}" for x in ewms)
            step = ", ".join(
                f"case when r.{x} is null then b.{s} when b.{s} is null then r.{x} "
                f"else r.{x} + ({a})*(b.{s} - r.{x}) end"
                for x in ewms for (_, s, a, _n) in [fields[x][1]])
            ctes.append(
                f"{rec} as (select symbol as rs, i as ri, {seed} from {last} where i = 0 "
                f"union all select b.symbol, b.i, {step} from {rec} r join {last} b "
                f"on b.symbol = r.rs and b.i = r.ri + 1)")
            joins += f" join {rec} on rs = {last}.symbol and ri = {last}.i"
            ctes.append(
                f"{now}_e as materialized (select {last}.*, " + ", ".join(
                    f"case when count({last}.{s}) {tail(1 << 20)} >= {m} then {rec}.{x} end as {x}"
                    for x in ewms for (_, s, _a, m) in [fields[x][1]])
                + f" from {last}{joins})")
            last, joins = f"{now}_e", ""
            cols[0] = f"{last}.*"
        if "support" in names or "resistance" in names:
            ctes += _levels(last, now)
            cols += [f"{now}_sr.support", f"{now}_sr.resistance"]
            joins += f" left join {now}_sr on {now}_sr.symbol = {last}.symbol and {now}_sr.i = {last}.i"
        if "benchmark" in names:
            cols.append("bench.benchmark")
            joins += f" left join bench on bench.date = {last}.date"
        if "industry" in names:
            cols.append("universe.industry")
            joins += f" left join universe on universe.symbol = {last}.symbol"
        if plain and joins:  # window names need unambiguous columns: separate step
            ctes.append(f"{now}_j as (select " + ", ".join(
                [c for c in cols if c not in {f"{fields[x][1]} as {x}" for x in plain}])
                + f" from {last}{joins})")
            last, joins = f"{now}_j", ""
            cols = [f"{last}.*"] + [f"{fields[x][1]} as {x}" for x in plain]
        ctes.append(f"{now} as materialized (select {', '.join(cols)} from {last}{joins}"
                    f"{WINDOWS if plain else ''})")
        last = now
    return ctes, last


def _levels(p: str, now: str) -> list[str]:
    return [
        f"{now}_piv as (select symbol, i as j, 0 as kind, high as price from {p} where pivot_high "
        f"union all select symbol, i, 1, low from {p} where pivot_low)",
        # equal prices are common: both windows need the same total order
        f"{now}_near as (select b.symbol, b.i, b.close, v.price, v.j, v.kind, lag(v.price) over "
        f"(partition by b.symbol, b.i order by v.price, v.j, v.kind) as before from {p} b join {now}_piv v "
        f"on v.symbol = b.symbol and v.j between b.i - 245 and b.i - 5)",
        f"{now}_isl as (select *, sum(case when before is null or 100*(price-before)/before > 1 "
        f"then 1 else 0 end) over (partition by symbol, i order by price, j, kind "
        f"rows unbounded preceding) as isl from {now}_near)",
        f"{now}_lev as materialized (select symbol, i, isl, any_value(close) as close, "
        f"sum(price::decimal(18, 6))::double / count(*) as level, count(*) as touches from {now}_isl group by symbol, i, isl "
        f"having count(*) >= 2)",
        f"{now}_sr as materialized (select symbol, i, max(level) filter (level <= close) as support, "
        f"min(level) filter (level > close) as resistance from {now}_lev group by symbol, i)",
    ]


# ---------------------------------------------------------------- conditions
def _any(hit: str, n: int) -> str:
    return f"coalesce(max(cast(coalesce({hit}, false) as int)) {tail(n)} = 1, false)"


def _all(hit: str, n: int, full: bool) -> str:
    held = f"min(cast(coalesce({hit}, false) as int)) {tail(n)} = 1"
    return f"({held} and i >= {n - 1})" if full else f"({held})"


def condition_fields(c: Condition) -> dict:
    """Fields for one condition; the one named ``c.name`` is the result."""
    k, n = c.kind, c.name
    hit = f"{n}_hit"
    if k == "compare":
        reads = (c["left"],) + ((c["right"],) if isinstance(c["right"], str) else ())
        return {n: (reads, f"coalesce({c['left']} {c['op']} {c['right']}, false)")}
    if k == "within":
        parts = [f"{c['field']} >= {c['min']}"] * (c["min"] is not None)
        parts += [f"{c['field']} <= {c['max']}"] * (c["max"] is not None)
        return {n: ((c["field"],), f"coalesce({' and '.join(parts)}, false)")}
    if k == "volume_spike":
        return {n: (("vol_ratio",), f"coalesce(vol_ratio >= {c['min_ratio']}, false)")}
    if k == "trend":
        f, s = ("ema_20", "ema_40") if c.weekly else ("ema_50", "ema_200")
        o = ">" if c["direction"] == "up" else "<"
        return {n: ((f, s, f"{f}_slope"),
                    f"coalesce(close {o} {f} and {f} {o} {s} and {f}_slope {o} 0, false)")}
    if k == "proximity":
        t, r = c["target"], c["ref"]
        return {hit: ((t, r), f"abs({t}-{r})/nullif({r},0)*100 <= {c['tolerance_pct']}"),
                n: ((hit,), _any(hit, c["lookback"]))}
    if k == "support_at_ma":
        m, t, lb = c["ma"], c["tolerance_pct"], c["lookback"]
        return {hit: ((m,), f"abs(low-{m})/{m}*100 <= {t} or low < {m}"),
                f"{n}_held": ((m,), f"close >= {m}*(1-{float(t)}::double/100)"),
                f"{n}_known": ((m,), f"{m} is not null"),
                n: ((hit, f"{n}_held", f"{n}_known"),
                    f"{_any(hit, lb)} and {_all(f'{n}_held', lb, False)} and "
                    f"{_all(f'{n}_known', lb, False)} and coalesce(close > {m}, false)")}
    if k in ("cross", "threshold_cross"):
        x = f"({c['fast']}-{c['slow']})" if k == "cross" else c["field"]
        lvl = 0 if k == "cross" else c["level"]
        reads = (c["fast"], c["slow"]) if k == "cross" else (c["field"],)
        o, p = (">", "<=") if c["direction"] == "above" else ("<", ">=")
        return {hit: (reads, f"lag({x}) {W} {p} {lvl} and {x} {o} {lvl}"),
                n: ((hit,), _any(hit, c["lookback"]))}
    if k == "change":
        x = c["field"]
        return {f"{n}_x": ((x,), _pct(x, f"lag({x},{c['window']}) {W}")),
                n: ((f"{n}_x",), f"coalesce({n}_x {c['op']} {c['value_pct']}, false)")}
    if k == "near_support":
        return {n: (("support",),
                    f"coalesce(100*(close-support)/support <= {c['tolerance_pct']}, false)")}
    if k == "near_resistance":
        return {n: (("resistance",),
                    f"coalesce(100*(resistance-close)/close <= {c['tolerance_pct']}, false)")}
    if k == "breakout_resistance":
        lb = c["lookback"]
        return {f"{n}_then": (("resistance",), f"lag(resistance,{lb}) {W}"),
                n: ((f"{n}_then",), f"coalesce(i-{lb} >= 30 and close > {n}_then*"
                    f"(1+{float(c['buffer_pct'])}::double/100), false)")}
    if k == "rel_strength":
        w = c["window"]
        return {f"{n}_x": (("benchmark",), f"100*(close/lag(close,{w}) {W} - "
                           f"benchmark/lag(benchmark,{w}) {W})"),
                n: ((f"{n}_x",), f"coalesce({n}_x {c['op']} {c['value_pct']}, false)")}
    if k == "candle":
        reads, sql = CANDLES[c["pattern"]]
        return {hit: (reads, sql), n: ((hit,), _any(hit, c["lookback"]))}
    if k in ("tight_range", "flat_base"):
        b = c["bars"]
        span = f"{n}_span"
        f = {span: (("high",), f"case when i >= {b - 1} then 100*(max(high) {tail(b)} - "
                    f"min(low) {tail(b)})/min(low) {tail(b)} end")}
        extra = ""
        reads = (span,)
        if k == "flat_base":
            reads, extra = (span, "pct_from_52w_high"), \
                f" and pct_from_52w_high >= -{c['max_from_52w_high_pct']}"
        return f | {n: (reads, f"coalesce({span} <= {c['max_range_pct']}{extra}, false)")}
    if k == "bb_squeeze":
        lb = c["lookback"]
        return {f"{n}_q": (("bb_width_pct",), f"case when count(bb_width_pct) {tail(lb)} >= 60 "
                           f"then quantile_cont(bb_width_pct, {c['percentile'] / 100}) {tail(lb)} end"),
                n: ((f"{n}_q",), f"coalesce(bb_width_pct <= {n}_q, false)")}
    if k == "gap":
        m = c["min_gap_pct"]
        test = f"gap_pct >= {m}" if c["direction"] == "up" else f"gap_pct <= -{m}"
        return {hit: (("gap_pct",), test), n: ((hit,), _any(hit, c["lookback"]))}
    if k == "sector":
        names = ", ".join(f"'{s}'" for s in c["names"])
        return {n: (("industry",), f"coalesce(industry in ({names}), false)")}
    if k == "persistence":
        return {hit: ((c["field"],), f"{c['field']} {c['op']} {c['value']}"),
                n: ((hit,), _all(hit, c["bars"], True))}
    if k == "divergence":
        bull = c["direction"] == "bullish"
        flag, price = ("pivot_low", "low") if bull else ("pivot_high", "high")
        osc, lb = c["oscillator"], c["lookback"]
        frame = (f"over (partition by symbol order by date rows between {lb - 6} preceding "
                 f"and 5 preceding)")
        item = f"list({{'at': i, 'p': {price}, 'o': {osc}}}) filter ({flag})"
        a, b = f"{n}_l[-2]", f"{n}_l[-1]"
        test = f"{b}.p < {a}.p and {b}.o > {a}.o" if bull else f"{b}.p > {a}.p and {b}.o < {a}.o"
        return {f"{n}_l": ((flag, osc), f"{item} {frame}"),
                n: ((f"{n}_l",), f"coalesce(len({n}_l) >= 2 and {b}.at - {a}.at >= 5 "
                    f"and {test}, false)")}
    if k == "rs_percentile":
        r = "mom_12_1" if c["basis"] == "mom_12_1" else f"ret_{c['window']}"
        return {n: ((f"{r}_pctl",), f"coalesce({r}_pctl {c['op']} {c['value']}, false)")}
    if k == "atr_pct_percentile":
        return {n: (("atr_pct_pctl",), f"coalesce(atr_pct_pctl {c['op']} {c['value']}, false)")}
    if k == "sector_rank":
        w = c["window"]
        test = (f"sector_rank_{w} <= {c['top']}" if c["top"] is not None
                else f"sector_rank_{w} > n_sectors_{w} - {c['bottom']}")
        return {n: ((f"sector_rank_{w}", f"n_sectors_{w}"), f"coalesce({test}, false)")}
    if k == "breadth":
        o = ">=" if c["direction"] == "positive" else "<"
        return {n: (("pct_above_200dma",), f"coalesce(pct_above_200dma {o} 50, false)")}
    raise KeyError(k)


_BODY = "abs(close-open)"
CANDLES = {
    "inside_bar": (("prev_high", "prev_low"), "high < prev_high and low > prev_low"),
    "nr7": (("range_min_before",), "bar_range < range_min_before"),
    "bullish_engulfing": (("prev_open", "prev_close"),
                          "prev_close < prev_open and close > open and open <= prev_close "
                          "and close >= prev_open"),
    "bearish_engulfing": (("prev_open", "prev_close"),
                          "prev_close > prev_open and close < open and open >= prev_close "
                          "and close <= prev_open"),
    "hammer": (("high",), f"high > low and least(open,close)-low >= 2*{_BODY} "
               "and high-greatest(open,close) <= 0.3::double*(high-low)"),
    "shooting_star": (("high",), f"high > low and high-greatest(open,close) >= 2*{_BODY} "
                      "and least(open,close)-low <= 0.3::double*(high-low)"),
}


def signal_ctes(conditions: Sequence[Condition], fields: Sequence[str] = (), gate: float = 0.0,
                latest: bool = False) -> tuple[list[str], str]:
    """CTEs ending in a table with one boolean per condition and ``fields``. Ranks
    are those of the bar's date, or with ``latest`` of the last date of all."""
    on = "(select max(d) from days)" if latest else "p.date"
    conditions = list(dict.fromkeys(conditions))
    f = daily_fields()
    daily = [c for c in conditions if not c.weekly]
    weekly = [c for c in conditions if c.weekly]
    ctes = [BARS.strip()]
    wanted = list(fields) + ["median_turnover"] * bool(gate)
    needs = set().union(*[c.needs for c in conditions]) if conditions else set()
    ranks = sorted(n.partition(":")[2] for n in needs if n.startswith("rank:"))
    sectors = sorted(n.partition(":")[2] for n in needs if n.startswith("sector_rank:"))
    late = [c for c in daily if c.kind in
            ("rs_percentile", "atr_pct_percentile", "sector_rank", "breadth")]
    for c in daily:
        f |= condition_fields(c)
        if c not in late:
            wanted.append(c.name)
    for r in set(ranks + [f"ret_{w}" for w in sectors]):
        if r.startswith("ret_"):
            f[r] = (("close",), _pct("close", f"lag(close,{int(r[4:])}) {W}"))
        wanted.append(r)
    if sectors:
        wanted.append("industry")
    if "breadth" in needs:
        wanted += ["sma_200", "prior_high"]
    more, last = chain("bars", "d", f, wanted)
    ctes += more
    if weekly:
        wf = weekly_fields()
        for c in weekly:
            wf |= condition_fields(c)
        ctes.append(WEEKLY_BARS)
        more, wlast = chain("weekly_bars", "w", wf, [c.name for c in weekly], 0)
        ctes += more
        # a symbol's latest week whose Friday is not after the bar
        ctes.append(f"with_weeks as materialized (select b.*, " + ", ".join(
            f"coalesce(w.{c.name}, false) as {c.name}" for c in weekly)
            + f" from {last} b asof left join {wlast} w on w.symbol = b.symbol and w.date <= b.date)")
        last = "with_weeks"
    if ranks or sectors:
        ctes.append(f"days as (select distinct date as d from {last})")
        ctes.append(f"grid as materialized (select days.d, p.* from days join (select distinct "
                    f"symbol as s from {last}) on true asof join {last} p on p.symbol = s "
                    f"and p.date <= days.d)")
        for r in ranks:
            ctes.append(
                f"rk_{r} as materialized (select d, symbol, round_even(100*((rank() over "
                f"(partition by d order by {r}) - 1) + (count(*) over (partition by d, {r}) + 1)/2.0)"
                f"/count(*) over (partition by d), 2) as {r}_pctl from grid where {r} is not null)")
            ctes.append(f"j_{r} as materialized (select p.*, {r}_pctl from {last} p left join "
                        f"rk_{r} k on k.d = {on} and k.symbol = p.symbol)")
            last = f"j_{r}"
        for w in sectors:
            ctes.append(f"sm_{w} as (select d, industry, avg(ret_{w}) as m from grid "
                        f"where industry is not null group by 1, 2 having avg(ret_{w}) is not null)")
            ctes.append(f"sr_{w} as materialized (select d, industry, m as sector_ret_{w}, "
                        f"rank() over (partition by d order by m desc) as sector_rank_{w}, "
                        f"count(*) over (partition by d) as n_sectors_{w} from sm_{w})")
            ctes.append(f"js_{w} as materialized (select p.*, sector_ret_{w}, sector_rank_{w}, "
                        f"n_sectors_{w} from {last} p left join sr_{w} k on k.d = {on} "
                        f"and k.industry = p.industry)")
            last = f"js_{w}"
    if "breadth" in needs:
        ctes.append(f"gauge as ({breadth_select(last)})")
        ctes.append(f"with_gauge as (select p.*, last_value(g.pct_above_200dma ignore nulls) over "
                    f"(partition by p.symbol order by p.date) as pct_above_200dma, "
                    f"last_value(g.pct_at_20d_high ignore nulls) over (partition by p.symbol order by p.date) "
                    f"as pct_at_20d_high from {last} p "
                    f"left join gauge g on g.date = p.date)")
        last = "with_gauge"
    if late:
        cols = ", ".join(f"{condition_fields(c)[c.name][1]} as {c.name}" for c in late)
        ctes.append(f"late as materialized (select *, {cols} from {last})")
        last = "late"
    return ctes, last


WEEKLY_BARS = """weekly_bars as materialized (select symbol,
  cast(date + ((5 - isodow(date) + 7) % 7)::int as date) as date,
  arg_min(open, bars.date) as open, max(high) as high, min(low) as low,
  arg_max(close, bars.date) as close, sum(volume) as volume
  from bars where close is not null group by 1, 2)"""


def breadth_select(p: str) -> str:
    return (f"select date, 100*avg(case when sma_200 is not null then "
            f"cast(close > sma_200 as int) end) as pct_above_200dma, "
            f"100*avg(case when prior_high is not null then cast(high >= prior_high as int) end) "
            f"as pct_at_20d_high, count(sma_200) as n_symbols from {p} group by date")


def statement(ctes: Sequence[str], select: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + select


def combined(conditions: Sequence[Condition], logic: str = "AND") -> str:
    return "(" + f" {logic.lower()} ".join(c.name for c in conditions) + ")"


def gated(gate: float) -> str:
    return f" and coalesce(median_turnover >= {gate}, false)" if gate else ""


def signal_bars_sql(conditions: Sequence[Condition], logic: str = "AND", gate: float = 0.0) -> str:
    ctes, last = signal_ctes(conditions, gate=gate)
    return statement(ctes, f"select symbol, date from {last} where "
                           f"{combined(conditions, logic)}{gated(gate)}")


def panel_sql(fields: Sequence[str], decimals: int = 6) -> str:
    ctes, last = chain("bars", "d", daily_fields(), fields)
    cols = ", ".join(f"round({x}, {decimals}) + 0.0 as {x}" for x in fields)
    return statement([BARS.strip(), *ctes], f"select symbol, date, {cols} from {last}")


def weekly_panel_sql(fields: Sequence[str], decimals: int = 6) -> str:
    ctes, last = chain("weekly_bars", "w", weekly_fields(), fields, 0)
    cols = ", ".join(f"round({x}, {decimals}) + 0.0 as {x}" for x in fields)
    return statement([BARS.strip(), WEEKLY_BARS, *ctes],
                     f"select symbol, date, {cols} from {last}")
