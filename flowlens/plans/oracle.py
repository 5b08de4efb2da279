"""SQL counterparts of the registered queries, for another engine on the same tables.

They state each result in the most direct relational form (as-of joins, global windows,
plain quantile aggregates) and share nothing with the Spark plans but the definitions.
``BLOCKS`` are common table expressions in dependency order; ``_sql`` puts the ones a
query needs in front of it.
"""

from __future__ import annotations

import re

from flowlens import schemas
from flowlens.operators import backtest as bt
from flowlens.plans import queries as reg

Q5 = "[0.1, 0.25, 0.5, 0.75, 0.9]"


def r6(e: str, name: str) -> str:
    return f"round({e}, 6) as {name}"


def q5(q: str = "q") -> str:
    return ", ".join(r6(f"{q}[{i}]", f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90), 1))


def half_up(e: str, digits: int) -> str:
    k = f"cast({10**digits} as double)"
    return f"floor(({e}) * {k} + 0.5) / {k}"


def cdf(x: str) -> str:
    t = f"(1 / (1 + cast(0.2316419 as double) * abs({x})))"
    poly = (
        f"{t} * (cast(0.319381530 as double) + {t} * (cast(-0.356563782 as double) + {t} * (cast(1.781477937 as double)"
        f" + {t} * (cast(-1.821255978 as double) + {t} * cast(1.330274429 as double)))))"
    )
    tail = f"exp(-0.5 * ({x}) * ({x})) / sqrt(2 * pi()) * {poly}"
    return f"(case when ({x}) < 0 then {tail} else 1 - {tail} end)"


def pdf(x: str) -> str:
    return f"(exp(-0.5 * ({x}) * ({x})) / sqrt(2 * pi()))"


def p_success(q: str, t: str) -> str:
    levels = (0.10, 0.25, 0.50, 0.75, 0.90)
    arms = [f"when {t} < {q}[1] then 0.98", f"when {t} > {q}[5] then 0.02", f"when {t} >= {q}[5] then 1 - 0.9"]
    for j in (4, 3, 2, 1):
        lo, hi = levels[j - 1], levels[j]
        arms.append(f"when {t} >= {q}[{j}] then 1 - ({lo} + ({t} - {q}[{j}]) / ({q}[{j + 1}] - {q}[{j}]) * cast({hi - lo} as double))")
    return f"cast(least(greatest(case {' '.join(arms)} end, 0.02), 0.98) as double)"


def kelly(p: str, b: str) -> str:
    return f"(({p}) * ({b}) - (1 - ({p}))) / ({b})"


def values(sets: list[dict]) -> str:
    rows = []
    for i, given in enumerate(sets):
        m = {"run_id": i, **bt.COMMON, **bt.SHIPPED.get(given["strategy_type"], bt.SHIPPED["vol_regime"]), **given}
        cells = []
        for f in schemas.PARAMS.fields:
            v, kind = m[f.name], f.dataType.simpleString()
            cells.append(f"'{v}'" if kind == "string" else f"cast({str(v).lower()} as {kind})")
        rows.append(f"({', '.join(cells)})")
    return f"select * from (values {', '.join(rows)}) v({', '.join(schemas.PARAMS.names)})"


def quantile_model(source: str, group: str) -> str:
    return f"select {group}, count(*) as n, quantile_cont(observed_return, {Q5}) as q from {source} group by {group}"


CELL = "concat_ws('|', option_type, side, trend_alignment, dte_bucket)"
BUCKET = "case when dte <= 7 then 'weekly' when dte <= 30 then 'short' when dte <= 60 then 'medium' else 'long' end"
SIDE_UP = "((option_type = 'Call' and side = 'BUY') or (option_type = 'Put' and side = 'SELL'))"
CONTRA = "((trend_alignment = 'BULL_ALIGNED' and option_type = 'Put') or (trend_alignment = 'BEAR_ALIGNED' and option_type = 'Call'))"
IN_BANDS = (
    "labeled and vol_oi_ratio between 0.05 and 10 and implied_vol between 5 and 200 and premium between 10 and 100000"
    " and underlier_price > 5 and observed_return between -1 and 5"
)
AS_OF = "timestamp '2001-06-30'"
RATIO = f"case when open_interest > 0 then {half_up('volume / cast(open_interest as double)', 2)} else cast(0 as double) end"
WEEKLY = "not (dayofweek({0}) = 5 and day({0}) between 15 and 21)"
OVER = "over (partition by ticker order by bar_date rows between {0} preceding and current row)"


def hist_vol(dev: str, least: int, default: float) -> str:
    return (
        "select ticker, coalesce(case when count(*) >= " + str(least) + f" then {dev}(ret) end * sqrt(252) * 100, {default}) as hv from ("
        "select *, ln(close / lag(close) over (partition by ticker order by bar_date)) as ret from ("
        "select *, max(bar_date) over (partition by ticker) as mx from bars) where bar_date > mx - 92) group by ticker"
    )


def bs(s: str, k: str, t: str, v: str) -> tuple[str, str]:
    d1 = f"((ln({s} / {k}) + (0.045 + {v} * {v} / 2) * {t}) / ({v} * sqrt({t})))"
    return d1, f"({d1} - {v} * sqrt({t}))"


NUMS = (
    "strike", "volume", "open_interest", "vol_oi_ratio", "implied_vol", "underlier_price", "premium", "dte", "moneyness", "iv_hv_ratio", "vix_level", "log_premium",
)
CATS = ("option_type", "side", "trend_alignment", "dte_bucket")
PARAM_ROWS = values(reg.SETS)
RULES = f"""
 case strategy_type
  when 'whale_quality' then base and implied_vol between 15 and 150 and p_success >= prob_threshold
       and q[5] - q[1] <= max_quantile_spread and q[3] >= min_median_return
  when 'contrarian_trend' then base and implied_vol between 15 and 150 and {CONTRA} and p_success >= prob_threshold
  when 'vol_regime' then base and case when implied_vol < 30 then p_success >= prob_threshold
       else q[5] - q[1] <= max_quantile_spread and p_success >= greatest(prob_threshold - 0.05, 0.30) end
  when '_legacy_quantile_confidence' then p_success >= prob_threshold and q[5] - q[1] <= max_quantile_spread
  when '_legacy_trend_breakout' then p_success >= prob_threshold and q[3] >= min_median_return
       and ((option_type = 'Call' and trend_alignment = 'BULL_ALIGNED') or (option_type = 'Put' and trend_alignment = 'BEAR_ALIGNED'))
  when '_legacy_iv_regime_adaptive' then case when implied_vol < 30 then p_success >= prob_threshold
       else p_success >= greatest(prob_threshold, 0.50) end
  else false end"""


def eligible(tier: str) -> str:
    return f"""select * from (
 select *, (is_synthetic = 1 or ticker in (select ticker from {tier})) and vol_oi_ratio >= vol_oi_floor and dte between 14 and 60 as base
 from pred cross join params) where {RULES}"""


def tier(target: float, rows: int, rate: float) -> str:
    return f"""select ticker, avg(case when observed_return >= {target} then 1.0 else 0.0 end) as win_rate, count(*) as n from labeled
 where labeled and is_synthetic = 0 and ts >= (select max(ts) from labeled where labeled) - interval 365 day
 group by ticker having count(*) >= {rows} and avg(case when observed_return >= {target} then 1.0 else 0.0 end) >= {rate}"""


def walk_model(train_rule: str) -> str:
    own = f"select k, cell, count(*) as n, quantile_cont(observed_return, {Q5}) as q from walk join folds on {train_rule} group by k, cell"
    every = f"select k, quantile_cont(observed_return, {Q5}) as q from walk join folds on {train_rule} group by k"
    return f"""select w.*, list_sort(coalesce(o.q, e.q)) as q from walk w
 left join ({own}) o on o.k = w.fold and o.cell = w.cell and o.n >= 30
 join ({every}) e on e.k = w.fold where w.fold >= 0"""


def labels(pending: str) -> str:
    return f"""with w as (select t.id, max_by(b.close, b.bar_date) as settle, min(b.close) as low, max(b.close) as high
   from trades t join bars b on t.ticker = b.ticker and b.bar_date between t.trade_date and t.trade_date + 10 group by t.id),
 g as (select t.*, w.settle is not null and t.underlier_price is not null and {pending} as labeled,
   case when {SIDE_UP} then settle - underlier_price else underlier_price - settle end / underlier_price as gain,
   case when {SIDE_UP} then low - underlier_price else underlier_price - high end / underlier_price as worst
   from trades t left join w on t.id = w.id)
 select * exclude (gain, worst), case when labeled then cast(gain >= 0.03 as int) end as label_success,
  case when labeled then round(gain, 4) end as observed_return, case when labeled then round(worst, 4) end as max_adverse_return,
  case when labeled then trade_date + 10 end as evaluation_date, {BUCKET} as dte_bucket from g"""


BLOCKS = {
    "bars": """with x as (
  select concat('T0', cast(l_suppkey % 10 as varchar)) as ticker, cast(l_shipdate as date) as bar_date,
   cast(80 as double) + (cast(round(l_extendedprice * 100) as bigint) % 4000) / cast(100 as double) as px, l_quantity as qty,
   row(l_orderkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint) % 4000) as o from lineitem)
 select ticker, bar_date, min_by(px, o) as open, max(px) as high, min(px) as low, max_by(px, o) as close,
  cast(sum(qty) as bigint) as volume from x group by ticker, bar_date""",
    "vix": "select bar_date as vix_date, (close - 70) * cast(0.8 as double) as vix from bars where ticker = 'T00'",
    "raw": f"""with x as (
  select o_orderkey as k, cast(round(o_totalprice * 100) as bigint) as c, o_custkey as ck, o_orderstatus as st,
   cast(cast(o_orderdate as date) as timestamp) + to_seconds(o_orderkey % 86400) as ts from orders),
 y as (select k as id, ts, cast(ts as date) as trade_date, concat('T0', cast(ck % 10 as varchar)) as ticker,
  80 + cast(2.5 as double) * (c % 17) as strike, case when k % 2 = 0 then 'Call' else 'Put' end as option_type,
  1 + c % 5000 as volume, (c // 7) % 1000 as open_interest, cast(10 + c % 120 as double) as implied_vol,
  cast(50 + c % 20000 as double) as premium, case k % 3 when 0 then 'BUY' when 1 then 'SELL' else 'MID' end as side,
  cast(7 + (c // 11) % 60 as int) as dte,
  case (c // 13) % 4 when 0 then 'BULL_ALIGNED' when 1 then 'BEAR_ALIGNED' when 2 then 'BULL_CONTRARIAN' else 'NEUTRAL' end as trend_alignment,
  case when st = 'F' then 0 else 1 end as is_synthetic, cast(42 + 100 * (k % 5) as int) as ensemble_id from x)
 select *, trade_date + dte as expiration, {RATIO} as vol_oi_ratio, cast(1.1 as double) as commission_per_contract,
  {WEEKLY.format('(trade_date + dte)')} as is_weekly from y""",
    "trades": "select r.*, b.close as underlier_price from raw r asof left join bars b on r.ticker = b.ticker and r.trade_date >= b.bar_date",
    "chain": f"""with x as (select *, cast(round(l_extendedprice * 100) as bigint) as c, cast(date_trunc('month', l_shipdate) as date) as snap,
   l_linenumber - 4 as s, case when l_linenumber = 4 and cast(l_quantity as bigint) % 2 = 1 then 0 else 10 end as hw from lineitem)
 select concat('T0', cast(l_suppkey % 10 as varchar)) as ticker, snap as snapshot_date,
  snap + cast(7 * ((l_partkey * 7 + l_linenumber) % 14) as integer) as expiration, cast(90 + 5 * (l_partkey % 5) as double) as strike,
  case when l_linestatus = 'O' then 'Call' else 'Put' end as option_type,
  case when l_linenumber = 7 then 0 else cast(l_quantity as bigint) end as volume, l_orderkey % 20 as open_interest,
  (c % 1000) / cast(100 as double) as last_price, (c % 1000 + 5 * s - hw) / cast(100 as double) as bid,
  (c % 1000 + 5 * s + hw) / cast(100 as double) as ask, cast(0.05 as double) + (l_partkey % 150) / cast(100 as double) as implied_vol,
  cast(snap as timestamp) + to_seconds(l_orderkey % 86400) as last_trade_ts, l_orderkey as k1, l_linenumber as k2, c as k3 from x""",
    "ratioed": f"""select *, {RATIO} as vol_oi_ratio from (select * replace (case when max(volume) over w <= 0 and max(open_interest) over w > 0
  then open_interest else volume end as volume) from chain window w as (partition by ticker, snapshot_date)) where volume > 0""",
    "near": """select c.* from chain c join (select ticker, snapshot_date, expiration from (
  select *, row_number() over (partition by ticker, snapshot_date, inside order by expiration) as r,
   row_number() over (partition by ticker, snapshot_date order by expiration) as ra, max(inside) over (partition by ticker, snapshot_date) as anyin from (
   select distinct ticker, snapshot_date, expiration, expiration - snapshot_date between 0 and 90 as inside from chain))
  where case when anyin then inside and r <= 6 else ra <= 4 end) s using (ticker, snapshot_date, expiration)""",
    "near_ratioed": f"""select *, {RATIO} as vol_oi_ratio from (select * replace (case when max(volume) over w <= 0 and max(open_interest) over w > 0
  then open_interest else volume end as volume) from near window w as (partition by ticker, snapshot_date)) where volume > 0""",
    "labeled": labels(f"t.ts <= {AS_OF} - interval 10 day"),
    "settled": labels("true"),
    "feat": f"select *, {CELL} as cell from labeled where {IN_BANDS}",
    "halved": "select *, ((id % 1000003) * 7919 + 42 * 104729) % 1009 < 201 as is_test from feat",
    "cells": f"{quantile_model('halved where not is_test', 'cell')} union all "
    f"select '*', count(*), quantile_cont(observed_return, {Q5}) from halved where not is_test",
    "scored_all": "select h.*, coalesce(c.q, (select q from cells where cell = '*')) as q from halved h "
    "left join cells c on h.cell = c.cell and c.n >= 30",
    "scored": "select * from scored_all where is_test",
    "hv": hist_vol("stddev_samp", 5, 0.0),
    "walk": f"""select *, {CELL} as cell, case when idx < 500 then -1 else (idx - 500) // 500 end as fold from (
  select *, row_number() over (order by ts, id) - 1 as idx from labeled where labeled)""",
    "folds": "select fold as k, min(trade_date) as first_day from walk where fold >= 0 group by fold",
    "wfm": walk_model("walk.fold < folds.k"),
    "pred": f"select *, {p_success('q', '0.025')} as p_success from wfm",
    "params": PARAM_ROWS,
    "tier_a": tier(0.03, 10, 0.30),
    "tier_b": tier(0.10, 10, 0.27),
    "elig": eligible("tier_a"),
    "elig_b": eligible("tier_b"),
    "liq": "select * from elig where dte between min_dte and max_dte and (min_open_interest <= 0 or open_interest >= min_open_interest)",
    "sized": f"""with a as (select *, strategy_type = '_legacy_iv_regime_adaptive' and implied_vol >= 30 as wide,
   case when hard_stop_loss > 1 then hard_stop_loss / 100 else hard_stop_loss end as hard from liq),
 b as (select *, case when wide then least(kelly_cap, 0.12) else kelly_cap end as cap,
   greatest(case when hard > 0 then hard * case when wide then 1.15 else 1.0 end else least(abs(q[1] * stop_lambda), 1) end, 0.01) as stop from a),
 c as (select *, least(greatest(least({kelly('p_success', '(greatest(profit_threshold, 0.01) / stop)')}, cap), 0) * kelly_multiplier, cap) as kel from b),
 d as (select *, case when kel * stop > max_risk_pct_per_trade then max_risk_pct_per_trade / stop else kel end as kelly_fraction from c)
 select *, initial_capital * kelly_fraction as position_usd from d where kelly_fraction >= min_kelly_fraction""",
    "exited": """with a as (select *, observed_return - case when use_costs and premium > 0
   then 2 * commission_per_contract / (premium * 100) else 0 end as net from sized),
 b as (select *, case when max_adverse_return <= -stop then 'stop_hit' when net >= profit_threshold then 'profit_hit'
   when net <= -stop then 'stop_hit' else 'hold_to_horizon' end as exit_reason from a)
 select *, case exit_reason when 'stop_hit' then -stop when 'profit_hit' then profit_threshold else greatest(net, -0.5) end - slippage_pct
  as trade_return from b""",
    "stopped": """select *, trade_date + greatest(1, dte - 2) < evaluation_date as time_stopped,
  case when trade_date + greatest(1, dte - 2) < evaluation_date then trade_date + greatest(1, dte - 2) else evaluation_date end as left_date,
  case when trade_date + greatest(1, dte - 2) < evaluation_date then greatest(max_adverse_return, -stop * 0.25) - slippage_pct
   else trade_return end as booked_return from exited""",
    "book": """select *, position_usd * trade_return as planned_pnl, position_usd * booked_return as realised_pnl,
  concat(ticker, ' ', cast(expiration as varchar), ' ', upper(left(option_type, 1)), cast(strike as varchar)) as contract from stopped""",
    "equity": """with d as (select run_id, initial_capital, cast(unnest(generate_series((select min(trade_date) from pred),
   (select max(evaluation_date) from pred), interval 1 day)) as date) as date from params),
 b as (select run_id, greatest(left_date, trade_date + 1) as date, sum(realised_pnl) as pnl from book group by all)
 select d.run_id, d.date, d.initial_capital,
  round(d.initial_capital + sum(coalesce(b.pnl, 0)) over (partition by d.run_id order by d.date), 2) as equity
 from d left join b on d.run_id = b.run_id and d.date = b.date""",
    "fallen": """select *, case when peak > 0 then (peak - equity) / peak * 100 else 0 end as drawdown_pct from (
  select *, greatest(max(equity) over (partition by run_id order by date), initial_capital) as peak from equity)""",
    "risk": """with r as (select *, case when lag(equity) over w > 0 then (equity - lag(equity) over w) / lag(equity) over w end as r
   from fallen window w as (partition by run_id order by date)),
 s as (select run_id, count(r) as n, avg(r) as mean, stddev_samp(r) as sd, avg(case when r < 0 then r * r end) as down,
   count(*) filter (r <> 0) as active_days, greatest(max(drawdown_pct), 0) as max_drawdown_pct, count(*) as days,
   max_by(equity, date) as final_equity, max(initial_capital) as cap from r group by run_id),
 t as (select *, case when n > 1 and sd > 0 then mean / sd * sqrt(252) else 0 end as sharpe from s)
 select *, case when n <= 1 then 0 when down is null then sharpe * 2 else coalesce(mean / sqrt(down) * sqrt(252), 0) end as sortino from t""",
    "tmet": """with t as (select run_id, count(*) as n, count(*) filter (planned_pnl > 0) as wins, sum(planned_pnl) filter (planned_pnl > 0) as won,
   -sum(planned_pnl) filter (planned_pnl < 0) as lost, avg(planned_pnl) filter (planned_pnl > 0) as aw,
   -avg(planned_pnl) filter (planned_pnl < 0) as al from book group by run_id)
 select p.run_id, p.strategy_type, coalesce(n, 0) as trades, coalesce(wins / cast(n as double) * 100, 0) as win_rate_pct,
  coalesce(coalesce(aw, 0) / al, 0) as win_loss_ratio, coalesce(coalesce(won, 0) / lost, 0) as profit_factor
 from params p left join t on p.run_id = t.run_id""",
    "summary": """select m.*, k.sharpe, k.sortino, k.max_drawdown_pct, k.active_days, (final_equity - cap) / cap * 100 as pnl_pct,
  case when final_equity > 0 then (pow(final_equity / cap, cast(365 as double) / greatest(days - 1, 1)) - 1) * 100 else 0 end as cagr_pct
 from tmet m join risk k on m.run_id = k.run_id""",
    "ranked": """select *, case when trades < 20 then cast(trades - 100 as double) when pnl_pct < 0 then -50 + pnl_pct * 0.1
  else 0.5 * least(greatest(sharpe * 40, 0), 100) + 0.25 * least(greatest(pnl_pct * 2, 0), 100) + 0.15 * least(trades / cast(2 as double), 100)
   + 0.1 * least(win_rate_pct, 100) - greatest(abs(max_drawdown_pct) - 15, 0) * 1.5 end as score from summary""",
    "newest": """select * from (select *, max(bar_date) over (partition by ticker) as mx from bars) where bar_date > mx - 365""",
    "sma": f"""select ticker, close, n, case when n >= 50 then s50 end as sma50, case when n >= 200 then s200 end as sma200 from (
  select ticker, bar_date, mx, close, avg(close) {OVER.format(49)} as s50, avg(close) {OVER.format(199)} as s200,
   count(*) over (partition by ticker) as n from newest) where bar_date = mx""",
    "flags": "select ticker, close > sma50 as above50, close > sma200 as above200 from sma",
    "gk": f"""with v as (select *, 0.5 * pow(ln(high / low), 2) - (2 * ln(cast(2 as double)) - 1) * pow(ln(close / open), 2) as v from bars)
 select *, case when count(v) {OVER.format(19)} >= 5 then sqrt(greatest(avg(v) {OVER.format(19)}, 1e-6)) * sqrt(252) else 0.25 end as gk_vol from v""",
    "trended": f"""with s as (select *, case when count(*) {OVER.format(19)} = 20 then avg(close) {OVER.format(19)} else close end as s20,
   case when count(*) {OVER.format(49)} = 50 then avg(close) {OVER.format(49)} else close end as s50 from gk)
 select *, case when close > s20 and s20 > s50 then 'BULL_ALIGNED' when close < s20 and s20 < s50 then 'BEAR_ALIGNED' else 'NEUTRAL' end as trend from s""",
    "moves": f"""with f as (select ticker, snapshot_date, min(expiration) as expiration from chain group by all),
 c as (select ticker, snapshot_date, strike, option_type, min_by(row(bid, ask), row(k1, k2, k3)) as qt from chain
   join f using (ticker, snapshot_date, expiration) group by all),
 l as (select ticker, snapshot_date, strike, max(case when option_type = 'Call' then (qt[1] + qt[2]) / 2 end) as cm,
   max(case when option_type = 'Put' then (qt[1] + qt[2]) / 2 end) as pm from c group by all),
 s as (select f.ticker, f.snapshot_date, b.close as spot from f asof left join bars b on f.ticker = b.ticker and f.snapshot_date >= b.bar_date),
 a as (select ticker, snapshot_date, min_by(row(strike, cm + pm), row(abs(strike - spot), strike)) as atm from l
   join s using (ticker, snapshot_date) where cm is not null and spot is not null group by all)
 select s.ticker, s.snapshot_date, s.spot, a.atm[1] as atm_strike, {half_up('coalesce(a.atm[2], 0)', 2)} as expected_move
 from s left join a on s.ticker = a.ticker and s.snapshot_date = a.snapshot_date""",
    "flow": f"""select r.*, m.spot as underlier_price, coalesce(m.expected_move, 0) as expected_move, f.above50, f.above200 from near_ratioed r
 left join moves m using (ticker, snapshot_date) left join flags f using (ticker) where vol_oi_ratio >= 2""",
    "grid": """select t.*, v.vix, o.option_type, o.mult, d.dte,
  floor(close * mult / case when close > 200 then 5 when close > 50 then 2.5 else 1 end + 0.5)
   * cast(case when close > 200 then 5 when close > 50 then 2.5 else 1 end as double) as strike
 from (select t.*, row_number() over (partition by ticker order by bar_date) as rn from trended t) t
 left join (select vix_date, case when vix > 0 then vix end as vix from vix) v on v.vix_date = t.bar_date
 cross join (values ('Call', cast(0.95 as double)), ('Call', 1.0), ('Call', 1.05), ('Put', 0.9), ('Put', 0.95), ('Put', 1.0)) o(option_type, mult)
 cross join (values (7), (30)) d(dte)""",
    "modelled": """select *, greatest(gk_vol * (0.7 + 0.3 * sqrt(coalesce(vix, 20) / 20)) + skew, 0.10) as iv, dte / cast(365 as double) as years from (
  select *, 0.15 * ln(strike / close) * ln(strike / close) - 0.10 * ln(strike / close) * sqrt(cast(30 as double) / dte) as skew from grid)""",
    "priced": """with d as (select *, (ln(close / strike) + (0.045 + iv * iv / 2) * years) / (iv * sqrt(years)) as d1 from modelled),
 e as (select *, d1 - iv * sqrt(years) as d2 from d),
 p as (select *, 100 * case when option_type = 'Call' then close * {c1} - strike * exp(-0.045 * years) * {c2}
   else strike * exp(-0.045 * years) * {n2} - close * {n1} end as premium from e)
 select *, 0.015 + 0.04 * abs(ln(strike / close)) + 0.02 / sqrt(dte / cast(30 as double)) as spread_pct,
  case trend when 'BULL_ALIGNED' then 'BUY' when 'BEAR_ALIGNED' then 'SELL' else 'MID' end as side from p where premium >= 15""".format(
        c1=cdf("d1"), c2=cdf("d2"), n1=cdf("-d1"), n2=cdf("-d2")
    ),
    "entered": """select *, premium * spread_pct / 2 as hs, case side when 'BUY' then premium + premium * spread_pct / 2
   when 'SELL' then premium - premium * spread_pct / 2 else premium end as entry_price,
  cast(dte <= 7 and case when option_type = 'Call' then close > strike else strike > close end as int) as early_exercise_risk from priced""",
    "marked": """with f as (select e.*, n.rn - e.rn as day, n.close as spot_now, greatest(1, e.dte - (n.rn - e.rn)) / cast(365 as double) as t2,
   greatest(n.gk_vol * (0.7 + 0.3 * sqrt(coalesce(e.vix, 20) / 20)) + e.skew, 0.10) as v2 from entered e
   join (select ticker, close, gk_vol, row_number() over (partition by ticker order by bar_date) as rn from gk) n
   on n.ticker = e.ticker and n.rn between e.rn + 1 and e.rn + 10),
 g as (select *, (ln(spot_now / strike) + (0.045 + v2 * v2 / 2) * t2) / (v2 * sqrt(t2)) as e1 from f),
 h as (select *, e1 - v2 * sqrt(t2) as e2 from g),
 i as (select *, 100 * case when option_type = 'Call' then spot_now * {c1} - strike * exp(-0.045 * t2) * {c2}
   else strike * exp(-0.045 * t2) * {n2} - spot_now * {n1} end as value from h)
 select *, case when side = 'BUY' then value - hs - entry_price else entry_price - value - hs end / entry_price as pnl from i""".format(
        c1=cdf("e1"), c2=cdf("e2"), n1=cdf("-e1"), n2=cdf("-e2")
    ),
    "long": """select is_synthetic, unnest(['vol_oi_ratio', 'implied_vol', 'dte', 'premium', 'strike', 'underlier_price', 'commission_per_contract',
   'observed_return', 'max_adverse_return']) as feature, unnest([vol_oi_ratio, implied_vol, cast(dte as double), premium, strike, underlier_price,
   commission_per_contract, observed_return, max_adverse_return]) as value from labeled""",
    "levels": """select feature, level, count(*) filter (is_synthetic = 1) as s, count(*) filter (is_synthetic = 0) as r from (
  select is_synthetic, unnest(['option_type', 'side', 'is_weekly', 'trend_alignment']) as feature,
   unnest([option_type, side, cast(is_weekly as varchar), trend_alignment]) as level from labeled) group by all""",
    "ks": """with h as (select feature, value, count(*) filter (is_synthetic = 1) as s, count(*) filter (is_synthetic = 0) as r from long
   where value is not null and feature <> 'commission_per_contract' group by all),
 c as (select feature, sum(s) over w as cs, sum(r) over w as cr, sum(s) over (partition by feature) as ts, sum(r) over (partition by feature) as tr
   from h window w as (partition by feature order by value)),
 d as (select feature, cast(max(ts) as bigint) as n1, cast(max(tr) as bigint) as n2, max(abs(cs / cast(ts as double) - cr / cast(tr as double))) as d from c group by feature),
 l as (select *, (sqrt(cast(n1 as double) * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(cast(n1 as double) * n2 / (n1 + n2))) * d as lam from d)
 select *, case when lam < 0.2 then 1 else least(greatest(list_sum([case when j % 2 = 1 then 2 else -2 end * exp(-2 * cast(j as double) * j * lam * lam)
   for j in range(1, 101)]), 0), 1) end as p from l""",
    "chi2": """with t as (select *, sum(s) over (partition by feature) as ts, sum(r) over (partition by feature) as tr,
   count(*) over (partition by feature) as levels from levels),
 e as (select *, (s + r) * cast(ts as double) / (ts + tr) as es, (s + r) * cast(tr as double) / (ts + tr) as er from t),
 o as (select feature, levels, es, er, case when levels = 2 then abs(s - es) - least(0.5, abs(s - es)) else abs(s - es) end as ds,
   case when levels = 2 then abs(r - er) - least(0.5, abs(r - er)) else abs(r - er) end as dr from e)
 select feature, levels, levels - 1 as dof, sum(ds * ds / es + dr * dr / er) as chi2 from o group by all""",
    "chi2p": """select *, case when chi2 = 0 then 1
  when dof % 2 = 0 then exp(-chi2 / 2) * list_sum([pow(chi2 / 2, i) / factorial(cast(i as int)) for i in range(0, dof // 2)])
  else 2 * (1 - {c}) + 2 * {p} * case when dof < 3 then 0 else list_sum([pow(chi2, i - 0.5) / list_product([2 * j - 1 for j in range(1, i + 1)])
   for i in range(1, (dof - 1) // 2 + 1)]) end end as p from chi2""".format(c=cdf("sqrt(chi2)"), p=pdf("sqrt(chi2)")),
}


def _mentioned(text: str) -> list[str]:
    return [name for name in BLOCKS if re.search(rf"\b(from|join) {name}\b", text)]


def _needed(text: str) -> list[str]:
    found: set[str] = set()
    queue = _mentioned(text)
    while queue:
        name = queue.pop()
        if name not in found:
            found.add(name)
            queue += _mentioned(BLOCKS[name])
    return [name for name in BLOCKS if name in found]


def _sql(body: str) -> str:
    names = _needed(body)
    return ("with " + ",\n".join(f"{n} as ({BLOCKS[n]})" for n in names) + "\n" if names else "") + body


D = "cast({0} as varchar) as {0}"
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}"
K = "k1, k2, k3"


def d(*names: str) -> str:
    return ", ".join(D.format(n) for n in names)


def ts(*names: str) -> str:
    return ", ".join(TS.format(n) for n in names)


def tri(name: str, alias: str | None = None) -> str:
    return f"case when {name} then 1 when not {name} then 0 else -1 end as {alias or name}"


def six(*names: str) -> str:
    return ", ".join(r6(n, n) for n in names)


SNAP = "ticker, snapshot_date, expiration"
TRADE = "id, ticker, strike, option_type, side, vol_oi_ratio, underlier_price"
QUOTE = f"ticker, strike, option_type, volume, open_interest, {K}"
PCR = f"case when call_volume > 0 then {half_up('put_volume / cast(call_volume as double)', 4)} else 1.0 end as put_call_ratio"


def expiries(n: int) -> str:
    return f"""(select *, row_number() over (partition by ticker, snapshot_date order by expiration) as rn from (
 select {SNAP}, cast(coalesce(sum(volume) filter (option_type = 'Call'), 0) as bigint) as call_volume,
  cast(coalesce(sum(volume) filter (option_type <> 'Call'), 0) as bigint) as put_volume from chain group by all)) where rn <= {n}"""


def pct(a: str, b: str) -> str:
    return f"coalesce({a} * cast(100 as double) / nullif({b}, 0), 0)"


def classify(hv: str) -> str:
    v = f"(case when coalesce({hv}, 0) <= 0 then 0.04 else {hv} / 100 * sqrt(cast(10 as double) / 252) end)"
    return f"""select id, case when q[5] - q[1] >= wide then 'VOL_EXPANSION' when abs(q[3]) < turn then 'SIDEWAYS'
  when q[3] > 0 then 'BULLISH_BREAKOUT' else 'BEARISH_BREAKDOWN' end as regime,
 round(least(greatest(100 * case when q[5] - q[1] >= wide then abs(q[5] - q[1] - wide) / wide
  else least(abs(q[5] - q[1] - wide) / wide, abs(abs(q[3]) - turn) / turn) end, 0), 100), 2) as confidence
 from (select s.*, 1.5 * {v} as wide, 0.25 * {v} as turn from scored s left join hv h on h.ticker = s.ticker)"""


def kelly_q(q: str, p: str) -> str:
    odds = f"greatest(greatest({q}[5] - {q}[3], 1e-6) / greatest({q}[3] - {q}[1], 1e-6), 0.01)"
    return kelly(p, odds)


def auc(source: str, by: str = "") -> str:
    part = f"partition by {by}" if by else ""
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""select {keys}round(coalesce(sum(pos * (cum - neg / cast(2 as double))) / nullif(cast(sum(pos) as double) * sum(neg), 0), 0), 6) as roc_auc from (
 select *, sum(neg) over ({part} order by s) as cum from (
  select {keys}round(q[3], 9) as s, count(*) filter (observed_return >= 0.03) as pos, count(*) filter (observed_return < 0.03) as neg from {source} group by all)) {group}"""


_d1, _d2 = bs("underlier_price", "strike", "(dte / cast(365 as double))", "(implied_vol / 100)")
_tr = "from (select *, {0} as d1, dte / cast(365 as double) as t, implied_vol / 100 as v from trades)".format(_d1)
_disc = "exp(-0.045 * t)"
_s, _d2x = "underlier_price", "(d1 - v * sqrt(t))"


def elig(*names: str) -> str:
    """Run numbers start at 0 among the selected sets."""
    inside = ", ".join(repr(n) for n in names)
    return (
        f"select rank as run_id, strategy_type, id from (select e.*, p.rank from elig_b e join (select run_id, cast(row_number() over (order by run_id) - 1 as bigint) as rank "
        f"from params where strategy_type in ({inside})) p on p.run_id = e.run_id)"
    )


RAW_BUMP = "list_transform(q, lambda x, i: case when i = 2 then x + observed_return else x end)"

BODIES = {
    "load_chain": f"select {QUOTE}, {d('snapshot_date', 'expiration')}, last_price, bid, ask, {six('implied_vol')}, "
    "case when option_type = 'Call' then strftime(last_trade_ts, '%Y-%m-%d %H:%M:%S') else '' end as last_trade_ts from chain",
    "load_bars": f"select ticker, {d('bar_date')}, open, high, low, close, volume from bars",
    "select_expirations": f"""select {d('snapshot_date')}, ticker, {d('expiration')}, n from (
 select *, row_number() over (partition by ticker, snapshot_date, inside order by expiration) as r,
  row_number() over (partition by ticker, snapshot_date order by expiration) as ra, max(inside) over (partition by ticker, snapshot_date) as anyin from (
  select {SNAP}, count(*) as n, expiration - snapshot_date between 0 and 90 as inside from chain group by all))
 where case when anyin then inside and r <= 6 else ra <= 4 end""",
    "scan_trades": f"select {TRADE}, {ts('ts')} from trades where is_synthetic = 1 and option_type = 'Call'",
    "page_trades": f"select {TRADE}, {TS.format('ts')} from (select * from labeled where ticker = 'T03' and labeled order by ts desc, id desc limit 50 offset 25)",
    "append_trades": f"select id, ticker, {ts('ts')}, strftime(date_trunc('month', ts), '%Y-%m-%d') as trade_month, ensemble_id, 0 as labeled, is_synthetic from trades",
    "append_new_trades": f"""select {TRADE}, {ts('ts')} from trades t where not exists (select 1 from trades o where o.is_synthetic = 1 and o.ts = t.ts
 and o.ticker = t.ticker and o.strike = t.strike and o.option_type = t.option_type and o.ensemble_id = t.ensemble_id)""",
    "sanitize_floats": "select id, case when open_interest = 0 or volume < 50 then -1 else vol_oi_ratio end as vol_oi_ratio, premium from trades",
    "model_runs_latest": f"""select concat('cells-', cast(year(ts) as varchar)) as model_version, count(*) as samples_count,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') as run_ts, {r6('avg(observed_return)', 'mean_return')} from feat group by year(ts) order by max(ts) desc limit 5""",
    "coerce_numeric": f"""select ticker, strike, option_type, case when volume = 13 then 0 else cast(volume as double) end as volume,
 cast(open_interest as double) as open_interest, {K}, {d('snapshot_date')}, {six('implied_vol')} from chain""",
    "offhours_volume": f"""select ticker, strike, option_type, case when ticker = 'T04' then case when max(open_interest) over w > 0 then open_interest else 0 end
 when max(volume) over w = 0 and max(open_interest) over w > 0 then open_interest else volume end as volume, open_interest, {K}, {d('snapshot_date')}
 from chain window w as (partition by ticker, snapshot_date)""",
    "vol_oi_ratio": f"select ticker, strike, option_type, cast(volume as double) as volume, cast(open_interest as double) as open_interest, {K}, {d('snapshot_date')}, vol_oi_ratio from ratioed",
    "min_ratio_filter": f"select ticker, strike, option_type, cast(volume as double) as volume, cast(open_interest as double) as open_interest, {K}, {d('snapshot_date')}, vol_oi_ratio from ratioed where vol_oi_ratio >= 2",
    "infer_side": f"""select {K}, last_price, bid, ask, case when bid = ask then 'MID' when last_price >= ask then 'BUY' when last_price <= bid then 'SELL'
 when last_price > (bid + ask) / 2 then 'BUY' when last_price < (bid + ask) / 2 then 'SELL' else 'MID' end as side from chain""",
    "dte": f"select {K}, {d('snapshot_date')}, case when open_interest = 0 then 0 else cast(expiration - snapshot_date as int) end as dte from chain",
    "is_weekly": f"""select {K}, cast(e as varchar) as expiration, cast({WEEKLY.format('e')} as int) as is_weekly
 from (select *, expiration + cast(strike % 7 as int) as e from chain)""",
    "notional_premium": f"select {K}, volume, {half_up('volume * case when open_interest > 0 then last_price else 0 end * 100', 2)} as premium from chain",
    "trade_time_ny": f"select {K}, strftime(timezone('America/New_York', timezone('UTC', last_trade_ts)), '%Y-%m-%d %H:%M:%S') as trade_time_ny from chain",
    "trend_simple": f"""select ticker, {tri('above50')}, {tri('above200')}, case when coalesce(above50, false) and coalesce(above200, false) then 'BULL_ALIGNED'
 when not coalesce(above50, false) and not coalesce(above200, false) then 'BEAR_ALIGNED' else 'NEUTRAL' end as trend from flags""",
    "trend_contextual": f"""select {K}, ticker, option_type, {tri('above50')}, {tri('above200')}, case when above50 is null then 'UNKNOWN'
 when bull and option_type = 'Call' then 'BULL_ALIGNED' when bear and option_type <> 'Call' then 'BEAR_ALIGNED'
 when bull and option_type <> 'Call' then 'BULL_CONTRARIAN' else 'NEUTRAL' end as trend_alignment
 from (select *, above50 and coalesce(above200, true) as bull, not above50 or not coalesce(above200, true) as bear from flow)""",
    "whale_flag": f"""select {K}, vol_oi_ratio, cast(vol_oi_ratio >= 5 as int) as is_whale, round(ln(1 + vol_oi_ratio), 4) as log_ratio,
 round(ln(1 + case when vol_oi_ratio * 2000 > 9990 then 50 else vol_oi_ratio * 2000 end), 4) as log_ratio_tamed from ratioed""",
    "expected_move_bounds": f"""select {K}, underlier_price, expected_move, {half_up('coalesce(underlier_price, 0) + expected_move', 2)} as expected_move_upper,
 {half_up('coalesce(underlier_price, 0) - expected_move', 2)} as expected_move_lower from flow""",
    "table_filters": f"""select {K}, ticker, dte, premium, case when open_interest > 2 then cast(open_interest as double) else -1 end as open_interest from (
 select *, cast(expiration - snapshot_date as int) as dte, {half_up('volume * last_price * 100', 2)} as premium, {WEEKLY.format('expiration')} as weekly from ratioed)
 where ticker not in ('T00', 'T07') and dte >= 14 and premium >= 500 and (open_interest <= 2 or open_interest >= 5) and not weekly""",
    "ledger_filters": "select run_id, id, ticker, exit_reason from book where contains(upper(ticker), 'T0') and exit_reason = 'hold_to_horizon'",
    "join_ticker_vol": """select id, t.ticker, round(coalesce(hv, 0), 6) as hv, round(case when hv > 0 then implied_vol / hv else 1 end, 6) as iv_hv_ratio
 from trades t left join (select * from hv where ticker <> 'T05') h on t.ticker = h.ticker""",
    "label_range_join": "select t.id, cast(b.bar_date as varchar) as bar_date, b.close from trades t join bars b on t.ticker = b.ticker and b.bar_date between t.trade_date and t.trade_date + 10",
    "join_vix_on_date": f"select id, {d('trade_date')}, round(case when vix > 0 then vix else 20 end, 6) as vix from trades t left join vix v on t.trade_date = v.vix_date",
    "next_event_join": """select id, de as days_to_earnings, cast(coalesce(abs(de) <= 3, false) as int) as near_earnings, df as days_to_fomc, cast(coalesce(abs(df) <= 1, false) as int) as near_fomc from (
 select t.id, cast(coalesce(en.e - t.trade_date, ep.e - t.trade_date) as int) as de, cast(coalesce(fn.e - t.trade_date, fp.e - t.trade_date) as int) as df from trades t
 asof left join (select ticker, max(bar_date) as e from bars group by ticker, date_trunc('quarter', bar_date)) en on t.ticker = en.ticker and t.trade_date <= en.e
 asof left join (select ticker, max(bar_date) as e from bars group by ticker, date_trunc('quarter', bar_date)) ep on t.ticker = ep.ticker and t.trade_date > ep.e
 asof left join (select 1 as one, min(bar_date) as e from bars group by date_trunc('month', bar_date)) fn on fn.one = 1 and t.trade_date <= fn.e
 asof left join (select 1 as one, min(bar_date) as e from bars group by date_trunc('month', bar_date)) fp on fp.one = 1 and t.trade_date > fp.e)""",
    "asof_price": f"select {K}, c.ticker, {d('snapshot_date')}, coalesce(b.close, 0) as spot from chain c asof left join bars b on c.ticker = b.ticker and c.snapshot_date >= b.bar_date",
    "atm_pair_join": f"""select c.ticker, cast(c.snapshot_date as varchar) as snapshot_date, cast(c.expiration as varchar) as expiration, c.strike,
 c.qt[1] as call_bid, c.qt[2] as call_ask, p.qt[1] as put_bid, p.qt[2] as put_ask from
 (select {SNAP}, strike, min_by(row(bid, ask), row({K})) as qt from chain where option_type = 'Call' group by all) c
 join (select {SNAP}, strike, min_by(row(bid, ask), row({K})) as qt from chain where option_type = 'Put' group by all) p
 using ({SNAP}, strike)""",
    "universe_semi": "select id, ticker from labeled where ticker in (select ticker from tier_b)",
    "params_cross": """select g.run_id, g.strategy_type, g.kelly_multiplier, g.stop_lambda, count(*) as n, cast(sum(volume) as bigint) as volume from trades cross join (values
 (0, 'whale_quality', cast(0.4 as double), cast(0.5 as double)), (1, 'whale_quality', 0.4, 1.0), (2, 'whale_quality', 0.8, 0.5), (3, 'whale_quality', 0.8, 1.0),
 (4, 'vol_regime', 0.4, 0.5), (5, 'vol_regime', 0.4, 1.0), (6, 'vol_regime', 0.8, 0.5), (7, 'vol_regime', 0.8, 1.0)) g(run_id, strategy_type, kelly_multiplier, stop_lambda) group by all""",
    "scan_summary": f"""select {d('snapshot_date')}, {half_up('a', 2)} as avg_vol_oi, m as max_vol_oi, call_volume, put_volume, {PCR}, whale_count from (
 select snapshot_date, avg(vol_oi_ratio) as a, max(vol_oi_ratio) as m, cast(coalesce(sum(volume) filter (option_type = 'Call'), 0) as bigint) as call_volume,
  cast(coalesce(sum(volume) filter (option_type <> 'Call'), 0) as bigint) as put_volume, count(*) filter (vol_oi_ratio >= 5) as whale_count from ratioed where vol_oi_ratio >= 2 group by all)""",
    "pcr_by_expiration": f"select ticker, {d('snapshot_date', 'expiration')}, {PCR} from {expiries(10)}",
    "pcr_pivot": f"""select {d('snapshot_date', 'expiration')}, {', '.join(f"coalesce(max(r) filter (ticker = '{t}'), -1) as {t.lower()}" for t in reg.TICKERS)}
 from (select *, {PCR.replace('put_call_ratio', 'r')} from {expiries(10)}) where ticker in ({', '.join(repr(t) for t in reg.TICKERS)}) group by snapshot_date, expiration""",
    "volume_concentration": f"select ticker, {d('snapshot_date', 'expiration')}, call_volume, put_volume, call_volume + put_volume as total_volume from {expiries(8)}",
    "trade_stats": """select count(*) as total_trades, count(*) filter (labeled) as labeled_trades, count(*) filter (labeled and observed_return >= 0.03) as successful_trades,
 round(count(*) filter (labeled and observed_return >= 0.03) / cast(greatest(count(*) filter (labeled), 1) as double), 4) as success_ratio from labeled""",
    "dataset_span": """select cast(min(trade_date) as varchar) as data_start, cast(max(trade_date) as varchar) as data_end, count(*) as data_count,
 cast(max(trade_date) - min(trade_date) as int) as data_span_days from trades where is_synthetic = 1""",
    "tier_a_universe": f"select ticker, {six('win_rate')}, n from tier_b",
    "ensemble_counts": "select ensemble_id, count(*) as n from trades group by all",
    "live_summary": f"""select count(*) as n, round(avg(p), 6) as avg_p, max_by(row(id, ticker, p), row(p, -id))[1] as top_id, max_by(row(id, ticker, p), row(p, -id))[2] as top_ticker,
 max(p) as top_p from (select *, round({p_success('q', '0.03')}, 6) as p from scored)""",
    "sma_flags": f"select ticker, {tri('above50')}, {tri('above200')} from flags",
    "technicals": f"""select ticker, price, s50 as sma50, coalesce(s200, -1) as sma200, {tri('price > s50', 'above50')}, {tri('price > s200', 'above200')},
 case when price > s50 and coalesce(price > s200, true) then 'BULLISH' when price > s50 or coalesce(price > s200, false) then 'MIXED' else 'BEARISH' end as trend from (
 select ticker, {half_up('close', 2)} as price, {half_up('sma50', 2)} as s50, {half_up('sma200', 2)} as s200 from sma where n >= 50)""",
    "iv_rank": f"""with r as (select ticker, bar_date, ln(close / lag(close) over (partition by ticker order by bar_date)) as ret from newest),
 h as (select ticker, bar_date, case when count(ret) {OVER.format(29)} = 30 then stddev_samp(ret) {OVER.format(29)} * sqrt(252) * 100 end as hv from r),
 c as (select *, last_value(hv) over (partition by ticker order by bar_date rows between unbounded preceding and unbounded following) as cur, count(*) over (partition by ticker) as bars from h)
 select ticker, coalesce(round(case when max(bars) >= 35 then max(cur) end, 2), 0) as current_iv,
 coalesce(round(case when max(bars) >= 35 and max(hv) <> min(hv) then (max(cur) - min(hv)) / (max(hv) - min(hv)) * 100 end, 1), 0) as iv_rank,
 coalesce(round(case when max(bars) >= 35 then count(*) filter (hv <= cur) / cast(count(hv) as double) * 100 end, 1), 0) as iv_percentile from c group by ticker""",
    "hist_vol": f"select hv.ticker, {r6('hv.hv', 'hv')}, {r6('p.hv', 'hv_pop')} from hv join ({hist_vol('stddev_pop', 10, 25.0)}) p on p.ticker = hv.ticker",
    "latest_vix": f"select {r6('max_by(vix, vix_date)', 'vix')} from vix",
    "garman_klass": f"select ticker, {d('bar_date')}, {six('gk_vol')} from gk",
    "trend_sma20_50": f"select ticker, {d('bar_date')}, trend from trended",
    "vix_regime": f"select {d('vix_date')}, {six('vix')}, case when vix < 15 then 'low' when vix < 22 then 'med' when vix < 30 then 'high' else 'extreme' end as vix_regime from vix",
    "market_regime": f"""select ticker, {d('bar_date')}, coalesce(case when c is not null then concat(case when close > c then 'trend_up' else 'trend_down' end,
 case when gk_vol > g then '_vol_expansion' else '_vol_contraction' end) end, 'none') as market_regime from (
 select *, lag(close, 200) over w as c, lag(gk_vol, 20) over w as g from gk window w as (partition by ticker order by bar_date))""",
    "first_per_ticker": f"""select ticker, vol_oi_ratio, cast(volume as double) as volume, cast(open_interest as double) as open_interest, {K} from (
 select *, row_number() over (partition by ticker order by vol_oi_ratio desc, snapshot_date, expiration, strike, option_type, {K}) as r from ratioed)
 where r = 1 order by vol_oi_ratio desc, ticker limit 8""",
    "row_slice": f"select id, ticker, {TS.format('ts')}, idx from (select *, row_number() over (order by ts, id) - 1 as idx from trades) where idx >= 500 and idx < 1200",
    "lookback_filter": f"select id, ticker, {ts('ts')} from trades where ts >= (select max(ts) from trades) - interval 365 day",
    "iv_smile": f"""select ticker, {d('snapshot_date', 'expiration')}, strike, option_type, {half_up('implied_vol * 100', 2)} as iv from (
 select *, dense_rank() over (partition by ticker, snapshot_date order by expiration) as r from chain) where r <= 2 and implied_vol > 0 and implied_vol < 5""",
    "smile_curve": f"""select ticker, {d('snapshot_date', 'expiration')}, strike, {half_up('implied_vol * 100', 2)} as iv from (
 select *, dense_rank() over (partition by ticker, snapshot_date order by expiration) as r from chain) where r <= 2 and implied_vol > 0 and implied_vol < 5 and option_type = 'Call'""",
    "expected_move": f"select ticker, {d('snapshot_date')}, coalesce(spot, 0) as spot, coalesce(atm_strike, -1) as atm_strike, expected_move from moves",
    "bs_price": f"""select id, option_type, strike, round(case when option_type = 'Call' then {_s} * {cdf('d1')} - strike * {_disc} * {cdf(_d2x)}
 else strike * {_disc} * {cdf(f'-{_d2x}')} - {_s} * {cdf('-d1')} end, 6) as price {_tr}""",
    "greeks": f"""select id, round(case when option_type = 'Call' then {cdf('d1')} else {cdf('d1')} - 1 end, 6) as delta, round({pdf('d1')} / ({_s} * v * sqrt(t)), 6) as gamma,
 round({_s} * {pdf('d1')} * sqrt(t), 6) as vega, round(-{_s} * {pdf('d1')} * v / (2 * sqrt(t)) + case when option_type = 'Call' then -0.045 * strike * {_disc} * {cdf(_d2x)}
 else 0.045 * strike * {_disc} * {cdf(f'-{_d2x}')} end, 6) as theta, round(case when option_type = 'Call' then strike * t * {_disc} * {cdf(_d2x)}
 else -strike * t * {_disc} * {cdf(f'-{_d2x}')} end, 6) as rho {_tr}""",
    "atm_iv_skew": f"select ticker, {d('bar_date')}, option_type, mult, dte, {six('skew', 'iv')} from modelled",
    "contract_grid": f"select ticker, {d('bar_date')}, option_type, mult, dte, strike from grid",
    "entry_cost": f"""select ticker, option_type, mult, dte, {d('bar_date')}, strike, side, {six('premium', 'spread_pct', 'entry_price')},
 cast(1.1 as double) as commission, early_exercise_risk from entered""",
    "mark_path": f"""select ticker, {d('bar_date')}, option_type, day, count(*) as n, {r6('avg(value)', 'avg_value')}, {r6('min(pnl)', 'min_pnl')},
 {r6('max(pnl)', 'max_pnl')}, {r6('avg(pnl)', 'avg_pnl')} from marked group by all""",
    "path_outcome": f"""select ticker, option_type, mult, dte, {d('bar_date')}, round(fin, 6) as observed_return, round(least(greatest(mae, -1), 0), 6) as max_adverse_return,
 cast(fin >= 0.05 as int) as label_success, round(fin - (case when option_type = 'Call' then {cdf('d1')} else {cdf('d1')} - 1 end) * (ex / close - 1), 4) as delta_hedged_return,
 round(case when option_type = 'Call' then {cdf('e1')} else {cdf('e1')} - 1 end, 6) as delta_exit, round({pdf('e1')} / (ex * v2 * sqrt(t2)), 6) as gamma_exit, round(ex * {pdf('e1')} * sqrt(t2), 6) as vega_exit,
 round(-ex * {pdf('e1')} * v2 / (2 * sqrt(t2)) - 0.045 * owed, 6) as theta_exit, round(t2 * owed, 6) as rho_exit from (
 select *, strike * exp(-0.045 * t2) * case when option_type = 'Call' then {cdf('e2')} else -{cdf('-e2')} end as owed from (
 select ticker, option_type, mult, dte, bar_date, close, d1, strike, min(pnl) as mae, least(greatest(max_by(pnl, day), -1), 3) as fin, max_by(spot_now, day) as ex,
  max_by(e1, day) as e1, max_by(e2, day) as e2, max_by(v2, day) as v2, max_by(t2, day) as t2 from marked group by ticker, option_type, mult, dte, bar_date, close, d1, strike having count(*) > 1))""",
    "features": f"""with h as (select ticker, bar_date, case when count(ret) {OVER.format(62)} >= 5 then stddev_samp(ret) {OVER.format(62)} * sqrt(252) * 100 else 0 end as hv from (
  select *, ln(close / lag(close) over (partition by ticker order by bar_date)) as ret from bars))
 select id, {BUCKET} as dte_bucket, round((strike - underlier_price) / underlier_price, 6) as moneyness, round(case when h.hv > 0 then implied_vol / h.hv else 1 end, 6) as iv_hv_ratio,
 round(coalesce(v.vix, 20), 6) as vix_level, round(ln(1 + greatest(premium, 0)), 6) as log_premium from trades t asof left join h on t.ticker = h.ticker and t.trade_date >= h.bar_date
 asof left join (select *, 1 as one from vix) v on v.one = 1 and t.trade_date >= v.vix_date""",
    "training_filter": f"select id, observed_return from labeled where is_synthetic = 1 and {IN_BANDS}",
    "label_trades": f"""select id, {tri('labeled')}, coalesce(cast(label_success as double), -9) as label_success, coalesce(observed_return, -9) as observed_return,
 coalesce(max_adverse_return, -9) as max_adverse_return, coalesce(cast(evaluation_date as varchar), '') as evaluation_date from labeled""",
    "label_merge": f"""select id, {tri('labeled')}, coalesce(cast(label_success as double), -9) as label_success, coalesce(observed_return, -9) as observed_return,
 coalesce(max_adverse_return, -9) as max_adverse_return, coalesce(cast(evaluation_date as varchar), '') as evaluation_date from labeled""",
    "stream_settle": f"""select id, {tri('labeled')}, coalesce(cast(label_success as double), -9) as label_success, coalesce(observed_return, -9) as observed_return,
 coalesce(max_adverse_return, -9) as max_adverse_return from settled where trade_date + 11 <= (select max(x) from (select max(ts) as x from trades union all select max(bar_date) from bars))""",
    "append_indexed": f"""select id, ticker, {ts('ts')}, strike, option_type, ensemble_id from trades t where id % 3 <> 0 or not exists (
 select 1 from trades u where u.id % 3 <> 0 and u.ts = t.ts and u.ticker = t.ticker and u.strike = t.strike and u.option_type = t.option_type and u.ensemble_id = t.ensemble_id)""",
    "asof_tick": f"""with q as (select *, concat('T0', user_id % 10) as ticker from events where event_type in ('view', 'click', 'error')),
 r as (select *, concat('T0', user_id % 10) as ticker from events where event_type in ('purchase', 'signup'))
 select r.event_id, r.ticker, coalesce(q.value, -1) as quote, coalesce(q.event_id, -1) as quote_id from r asof left join q on r.ticker = q.ticker and r.ts >= q.ts""",
    "interval_join": f"""with i as (select event_id, user_id % 10 as k, ts as a, ts + to_seconds({list(reg.SPANS)}[event_id % {len(reg.SPANS)} + 1]) as b from events where event_type = 'signup'),
 p as (select *, user_id % 10 as k from events where event_type in ('purchase', 'view'))
 select i.event_id as interval_id, concat('T0', i.k) as ticker, count(*) as n, round(sum(p.value), 6) as total, min(p.event_id) as least
 from i join p on p.k = i.k and p.ts between i.a and i.b group by all""",
    "boosted_histogram": f"""with t as (select *, (strike - underlier_price) / underlier_price as moneyness from halved where not is_test),
 n as (select observed_return as y, unnest({list(reg.BOOSTED)}) as feature, unnest([{', '.join(f'cast({c} as double)' for c in reg.BOOSTED)}]) as v from t),
 e as (select feature, list_distinct(list_transform(quantile_cont(v, [{', '.join(f'{i} / cast(31 as double)' for i in range(1, 31))}]), lambda x: round(x, 9))) as edges from n where v is not null group by feature),
 c as (select observed_return as y, unnest({list(CATS)}) as feature, unnest([{', '.join(CATS)}]) as v from t),
 l as (select feature, v, row_number() over (partition by feature order by count(*) desc, v) as r from c where v is not null group by feature, v),
 b as (select y, feature, case when v is null then 0 else 1 + len(list_filter(edges, lambda x: x < v)) end as bin from n join e using (feature)
  union all select y, c.feature, case when c.v is null then 0 when r <= 30 then r else 31 end from c left join l on c.feature = l.feature and c.v = l.v),
 s as (select unnest({Q5}) as quantile, unnest(quantile_cont(observed_return, {Q5})) as start from t)
 select cast(s.quantile as double) as quantile, feature, cast(bin as int) as bin, count(*) as n, count(*) filter (y < start) as under from b cross join s group by all""",
    "garman_klass_fine": f"""with h as (select concat('T0', user_id % 10) as ticker, date_trunc('hour', ts) as hour, min_by(value, row(ts, event_id)) as open,
  max_by(value, row(ts, event_id)) as close, max(value) as high, min(value) as low from events group by all),
 v as (select *, 0.5 * pow(ln(high / low), 2) - (2 * ln(cast(2 as double)) - 1) * pow(ln(close / open), 2) as v from h)
 select ticker, {ts('hour')}, round(case when count(v) over w >= 5 then sqrt(greatest(avg(v) over w, 1e-6)) * sqrt(252) else 0.25 end, 6) as gk_vol
 from v window w as (partition by ticker order by hour rows between 19 preceding and current row)""",
    "sma_flags_fine": f"""with h as (select concat('T0', user_id % 10) as ticker, date_trunc('hour', ts) as hour, max_by(value, row(ts, event_id)) as close from events group by all),
 r as (select * from (select *, max(hour) over (partition by ticker) as mx from h) where hour > mx - interval 20 day),
 a as (select ticker, hour, mx, close, count(*) over (partition by ticker) as n, avg(close) over (partition by ticker order by hour rows between 49 preceding and current row) as s50,
  avg(close) over (partition by ticker order by hour rows between 199 preceding and current row) as s200 from r),
 f as (select ticker, case when n >= 50 then close > s50 end as above50, case when n >= 200 then close > s200 end as above200 from a where hour = mx)
 select ticker, {tri('above50')}, {tri('above200')} from f""",
    "impute_fills": f"""with h as (select ticker, bar_date, case when count(ret) {OVER.format(62)} >= 5 then stddev_samp(ret) {OVER.format(62)} * sqrt(252) * 100 else 0 end as hv from (
  select *, ln(close / lag(close) over (partition by ticker order by bar_date)) as ret from bars)),
 t as (select t.*, (strike - underlier_price) / underlier_price as moneyness, case when h.hv > 0 then implied_vol / h.hv else 1 end as iv_hv_ratio,
   coalesce(v.vix, 20) as vix_level, ln(1 + greatest(premium, 0)) as log_premium
  from (select * from halved where not is_test) t asof left join h on t.ticker = h.ticker and t.trade_date >= h.bar_date
  asof left join (select *, 1 as one from vix) v on v.one = 1 and t.trade_date >= v.vix_date),
 n as (select unnest({list(NUMS)}) as feature, unnest([{', '.join(f'cast({c} as double)' for c in NUMS)}]) as v from t),
 c as (select unnest({list(CATS)}) as feature, unnest([{', '.join(CATS)}]) as v from t),
 m as (select feature, v, row_number() over (partition by feature order by count(*) desc, v) as r from c where v is not null group by feature, v)
 select feature, round(quantile_cont(v, 0.5), 6) as median, '' as mode from n where v is not null group by feature
 union all select feature, cast(-1 as double) as median, v as mode from m where r = 1""",
    "relabel_on_read": f"""select id, {tri('labeled')}, case when labeled then cast(observed_return >= 0.1 as int) + 0e0 else -9 end as label_success,
 coalesce(observed_return, -9) as observed_return, coalesce(max_adverse_return, -9) as max_adverse_return from labeled""",
    "pending_labels": f"select id, {ts('ts')}, is_synthetic from labeled where (is_synthetic = 0 or not labeled) and ts <= {AS_OF} - interval 10 day",
    "dedup_12h": f"""with recursive k as (select user_id, event_type, min(ts) as ts from events group by all
 union all select k.user_id, k.event_type, (select min(e.ts) from events e where e.user_id = k.user_id and e.event_type = k.event_type and e.ts > k.ts + interval 12 hour) as ts
 from k where k.ts is not null)
 select min(e.event_id) as event_id, e.user_id, e.event_type, strftime(e.ts, '%Y-%m-%d %H:%M:%S') as ts from events e
 join k on e.user_id = k.user_id and e.event_type = k.event_type and e.ts = k.ts group by e.user_id, e.event_type, e.ts""",
    "split_80_20": "select id, cast(is_test as int) as is_test from halved",
    "fit_cell_quantiles": f"select cell, n, {q5()} from cells",
    "score": f"select id, cell, {q5()} from scored",
    "monotonic_quantiles": f"select id, {q5()} from (select id, list_sort({RAW_BUMP}) as q from scored)",
    "monotonic_violations": f"""select count(*) as n, count(*) filter (b <> list_sort(b)) as violations, round(count(*) filter (b <> list_sort(b)) / cast(count(*) as double), 6) as share
 from (select {RAW_BUMP} as b from scored)""",
    "pinball_loss": f"""select quantile, round(avg(greatest(quantile * (y - p), (quantile - 1) * (y - p))), 6) as pinball_loss from (
 select observed_return as y, unnest(q) as p, unnest(cast({Q5} as double[])) as quantile from scored) group by quantile""",
    "coverage": ("select " + ", ".join(f"round(avg(cast(observed_return <= q[{i}] as double)), 6) as coverage_p{p}" for i, p in ((1, 10), (3, 50), (5, 90))) + " from scored"),
    "binary_metrics": """select cast(is_test as int) as is_test, n, round(ok / n, 6) as accuracy, round(coalesce(tp / nullif(pp, 0), 0), 6) as precision,
 round(coalesce(tp / nullif(rp, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(pp + rp, 0), 0), 6) as f1 from (
 select is_test, count(*) as n, sum(cast((q[3] >= 0) = (observed_return >= 0) as double)) as ok, sum(cast(q[3] >= 0 and observed_return >= 0 as double)) as tp,
  sum(cast(q[3] >= 0 as double)) as pp, sum(cast(observed_return >= 0 as double)) as rp from scored_all group by is_test)""",
    "roc_auc": auc("scored"),
    "stratified_cv": f"""with f as (select *, cast((row_number() over (partition by observed_return >= 0.03 order by id) - 1) % 5 as int) as fold from feat),
 m as (select k.fold, f.cell, count(*) as n, quantile_cont(observed_return, {Q5}) as q from f join (select unnest(range(5)) as fold) k on k.fold <> f.fold group by all),
 e as (select k.fold, quantile_cont(observed_return, {Q5}) as q from f join (select unnest(range(5)) as fold) k on k.fold <> f.fold group by all),
 sc as (select f.fold, f.observed_return, coalesce(m.q, e.q) as q from f join e on e.fold = f.fold left join m on m.fold = f.fold and m.cell = f.cell and m.n >= 30)
 {auc('sc', 'fold')}""",
    "p_success": "select id, " + ", ".join(f"round({p_success('q', t)}, 6) as {n}" for t, n in (("0.025", "p_025"), ("0.10", "p_100"), ("-0.5", "p_low"), ("0.6", "p_high"), ("q[5]", "p_at_p90")))
    + " from scored",
    "classify_regime": classify("(h.hv / 3)"),
    "kelly_quantile": f"select id, round(least(greatest(k, 0), 0.25), 6) as kelly, round(k, 6) as kelly_raw from (select id, {kelly_q('q', p_success('q', '0.025'))} as k from scored)",
    "heuristic_score": """select id, round(least(0.5 + case when vol_oi_ratio > 5 then 0.1 else 0 end + case when trend_alignment in ('BULL_ALIGNED', 'BEAR_ALIGNED') then 0.15 else 0 end
 + case when side = 'BUY' then 0.05 else 0 end, 0.95), 6) + 0e0 as score,
 round(least(0.5 + case when trend_alignment = 'BULL_ALIGNED' then 0.15 else 0 end + case when side = 'BUY' then 0.05 else 0 end, 0.95), 6) + 0e0 as score_open, -0.02e0 as p10, 0.005e0 as p25, 0.03e0 as p50, 0.055e0 as p75, 0.08e0 as p90, 0.5e0 as p_success from trades""",
    "gaussian_signal": f"""with a as (select *, q[4] - q[2] as iqr, volume / (open_interest + 1e-6) as ratio, greatest((q[4] - q[2]) / 1.349, 1e-6) as sg from scored),
 b as (select *, least(greatest(1 - {cdf('((0.05 - q[3]) / sg)')} + 0.025, 0.02), 0.98) as p, case when q[3] > 0 then q[3] else 0.08 end as odds from a),
 c as (select *, ratio between 3 and 50 and dte between 14 and 30 as liquid, p >= 0.4 and iqr <= 0.26 and q[3] >= 0.04 as good from b)
 select id, round(p, 6) as p_success, round(least(greatest((p * (1 + odds) - 1) / (odds + 1e-6), 0), 0.05), 6) as kelly,
 case when liquid and implied_vol between 15 and 150 and good then 'whale_quality' when liquid and implied_vol between 15 and 150 and good and {CONTRA} then 'contrarian_trend'
 when liquid and ((implied_vol < 25 and p >= 0.6) or (implied_vol > 50 and iqr <= 0.3)) then 'vol_regime' else 'NONE' end as strategy from c""",
    "open_signals": f"""with m as ({quantile_model('feat', 'cell')}), e as (select quantile_cont(observed_return, {Q5}) as q from feat),
 s as (select l.*, h.hv, list_sort(coalesce(m.q, (select q from e))) as q from (select *, {CELL} as cell from labeled where not labeled) l
  left join m on m.cell = l.cell and m.n >= 30 left join hv h on h.ticker = l.ticker),
 p as (select *, {p_success('q', '0.03')} as p, case when coalesce(hv, 0) <= 0 then 0.04 else hv / 100 * sqrt(cast(10 as double) / 252) end as v from s),
 k as (select *, least(greatest({kelly_q('q', 'p')}, 0), 0.25) as kel from p)
 select id, ticker, {q5()}, round(p, 6) as p_success, round(kel, 6) as kelly_fraction, case when q[5] - q[1] >= 1.5 * v then 'VOL_EXPANSION' when abs(q[3]) < 0.25 * v then 'SIDEWAYS'
 when q[3] > 0 then 'BULLISH_BREAKOUT' else 'BEARISH_BREAKDOWN' end as regime from k where p >= 0.4 and kel >= 0.01""",
    "walkforward_folds": """select cast(fold as int) as fold, min(idx) as train_rows, count(*) as test_rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts from walk where fold >= 0 group by fold""",
    "walkforward_predict": f"select id, cast(fold as int) as fold, {q5()}, {six('p_success')} from pred",
    "walkforward_purged": f"select id, cast(fold as int) as fold, {q5()}, round({p_success('q', '0.025')}, 6) as p_success from ({walk_model('walk.fold < folds.k and walk.evaluation_date < folds.first_day')})",
    "in_sample_predict": f"""select id, {q5()}, round({p_success('q', '0.025')}, 6) as p_success, 1 as in_sample from (
 select f.id, coalesce(m.q, (select quantile_cont(observed_return, {Q5}) from feat)) as q from feat f left join ({quantile_model('feat', 'cell')}) m on m.cell = f.cell and m.n >= 30)""",
    "elig_whale_quality": elig("whale_quality"),
    "elig_contrarian": elig("contrarian_trend"),
    "elig_vol_regime": elig("vol_regime"),
    "elig_legacy": elig("_legacy_quantile_confidence", "_legacy_trend_breakout", "_legacy_iv_regime_adaptive"),
    "liquidity_filter": """select run_id, count(*) as n, cast(sum(id) as bigint) as id_sum from pred cross join params
 where dte between min_dte and max_dte and (min_open_interest <= 0 or open_interest >= min_open_interest) group by run_id""",
    "position_size": f"select run_id, id, {six('stop', 'kelly_fraction')}, round(position_usd, 4) as position_usd from sized",
    "exit_rules": f"select run_id, id, exit_reason, {six('trade_return')} from exited",
    "time_stop": f"select run_id, id, cast(evaluation_date as varchar) as exit_date, {d('left_date')}, cast(time_stopped as int) as time_stopped, {six('booked_return')} from stopped",
    "ledger": f"""select run_id, strategy_type, id, {d('trade_date')}, cast(evaluation_date as varchar) as exit_date, contract, {six('p_success')}, round(position_usd, 4) as position_usd,
 exit_reason, round(planned_pnl, 4) as planned_pnl, round(realised_pnl, 4) as realised_pnl from book""",
    "equity_curve": f"select run_id, {d('date')}, equity from equity",
    "drawdown": f"select run_id, {d('date')}, peak, {six('drawdown_pct')} from fallen",
    "risk_metrics": f"select run_id, {six('sharpe', 'sortino', 'max_drawdown_pct')}, active_days from risk",
    "trade_metrics": f"select run_id, strategy_type, trades, {six('win_rate_pct', 'win_loss_ratio', 'profit_factor')} from tmet",
    "open_positions": f"""select run_id, cast(date as varchar) as date, cast(sum(net) over (partition by run_id order by date) as bigint) as open_positions from (
 select run_id, date, sum(m) as net from (select run_id, trade_date as date, 1 as m from book union all select run_id, greatest(left_date, trade_date + 1), -1 from book) group by all)""",
    "live_eligibility": f"""select run_id, strategy_type, id, round(p, 6) as p_success from (select *, {p_success('q', '0.03')} as p from scored) cross join params where case strategy_type
 when 'whale_quality' then p >= prob_threshold and (max_quantile_spread <= 0 or q[5] - q[1] <= max_quantile_spread) when 'contrarian_trend' then p >= prob_threshold and {CONTRA}
 when 'vol_regime' then case when implied_vol < 30 then p >= greatest(prob_threshold, 0.4) else p >= prob_threshold and q[5] - q[1] <= 0.35 end else p >= prob_threshold end""",
    "sweep": f"select run_id, strategy_type, trades, {six(*reg.SWEEP_COLS)} from summary",
    "sweep_score": f"select run_id, strategy_type, {six('score')} from ranked",
    "sweep_winner": f"""select strategy_type, run_id, tier, {six('score')} from (select *, row_number() over (partition by strategy_type order by tier, score desc, run_id) as r from (
 select *, case when trades >= 20 and pnl_pct > 0 then 1 when trades >= 10 then 2 else 3 end as tier from ranked)) where r = 1""",
    "sweep_heatmap": """select kelly_multiplier, max(s) filter (stop_lambda = 0.5) as stop_0_5, max(s) filter (stop_lambda = 1.0) as stop_1_0, max(lo) as lowest, max(hi) as highest from (
 select p.kelly_multiplier, p.stop_lambda, round(m.sharpe, 6) as s, min(round(m.sharpe, 6)) over () as lo, max(round(m.sharpe, 6)) over () as hi from summary m
 join params p on p.run_id = m.run_id where p.run_id between 6 and 9) group by kelly_multiplier""",
    "profitability_report": f"""select run_id, strategy_type, trades, {six('pnl_pct')}, cast(starts_with(strategy_type, '_legacy_') as int) as legacy from summary
 where pnl_pct > 0 and (starts_with(strategy_type, '_legacy_') or trades >= 30)""",
    "audit_overview": """select is_synthetic, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts,
 count(distinct ticker) as tickers from labeled group by all""",
    "audit_by_ticker": f"""select ticker, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts,
 {r6('quantile_cont(vol_oi_ratio, 0.5)', 'ratio_p50')}, {r6('quantile_cont(vol_oi_ratio, 0.99)', 'ratio_p99')}, {r6('max(vol_oi_ratio)', 'ratio_max')},
 {r6('quantile_cont(implied_vol, 0.5)', 'iv_p50')}, {r6('quantile_cont(implied_vol, 0.99)', 'iv_p99')},
 {r6("count(*) filter (labeled and label_success = 1) / cast(count(*) filter (labeled) as double) * 100", 'success_pct')},
 {r6(pct("count(*) filter (side = 'BUY')", "count(*) filter (side <> 'MID')"), 'buy_pct')}, {r6(pct("count(*) filter (side = 'SELL')", "count(*) filter (side <> 'MID')"), 'sell_pct')}
 from labeled group by ticker""",
    "feature_distribution": f"""select feature, is_synthetic, count(*) as count, {r6('min(value)', 'min')}, {', '.join(r6(f'quantile_cont(value, {p / 100})', f'p{p}') for p in (10, 25, 50, 75, 90, 99))},
 {r6('max(value)', 'max')}, {r6('avg(value)', 'mean')}, {r6('stddev_pop(value)', 'stdev')} from long where value is not null and feature not in ('strike', 'underlier_price') group by feature, is_synthetic""",
    "categorical_distribution": f"""select feature, level, s as synthetic_n, {r6(pct('s', '(select count(*) from labeled where is_synthetic = 1)'), 'synthetic_pct')}, r as real_n,
 {r6(pct('r', '(select count(*) from labeled where is_synthetic = 0)'), 'real_pct')} from levels where feature <> 'is_weekly'""",
    "label_summary": f"""select is_synthetic, count(*) filter (labeled) as labeled, count(*) filter (not labeled) as unlabeled, count(*) filter (label_success = 1) as success,
 {r6('count(*) filter (label_success = 1) / cast(count(*) filter (labeled) as double) * 100', 'success_pct')} from labeled group by is_synthetic""",
    "balance": f"""select *, {r6(pct('buys', '(buys + sells)'), 'buy_pct')}, {r6(pct('sells', '(buys + sells)'), 'sell_pct')}, {r6(pct('calls', '(calls + puts)'), 'call_pct')} from (
 select is_synthetic, count(*) filter (side = 'BUY') as buys, count(*) filter (side = 'SELL') as sells, count(*) filter (option_type = 'Call') as calls,
  count(*) filter (option_type = 'Put') as puts from trades group by all)""",
    "whale_crossing": f"""select threshold, s as synthetic_n, {r6(pct('s', 'ts'), 'synthetic_pct')}, r as real_n, {r6(pct('r', 'tr'), 'real_pct')}, cast(s = 0 and threshold >= 5 as int) as warn from (
 select threshold, count(*) filter (is_synthetic = 1 and vol_oi_ratio >= threshold) as s, count(*) filter (is_synthetic = 0 and vol_oi_ratio >= threshold) as r,
  count(*) filter (is_synthetic = 1) as ts, count(*) filter (is_synthetic = 0) as tr from trades cross join (select unnest(cast([2, 5, 8] as double[])) as threshold) group by threshold)""",
    "dte_histogram": """select bucket, count(*) filter (is_synthetic = 1) as synthetic_n, count(*) filter (is_synthetic = 0) as real_n from (select is_synthetic, case when x is null then 'NULL'
 when x <= 7 then '<=7' when x <= 21 then '8-21' when x <= 45 then '22-45' when x <= 90 then '46-90' else '>90' end as bucket from (
 select is_synthetic, case when open_interest > 0 then dte * 2 - 10 end as x from trades)) group by bucket""",
    "contingency": """select cast(is_weekly as int) as is_weekly, trend_alignment, count(*) filter (is_synthetic = 1) as synthetic_n, count(*) filter (is_synthetic = 0) as real_n
 from trades group by all""",
    "ks_two_sample": f"""select feature, n1 as n_synthetic, n2 as n_real, {six('d')}, {r6('p', 'p_value')}, case when d < 0.05 then 'practically similar' when d < 0.15 then 'moderate divergence'
 else 'large divergence' end as divergence, cast(d < 0.05 as int) as passed from ks""",
    "chi2_two_sample": f"select feature, levels, dof, {six('chi2')}, {r6('p', 'p_value')}, cast(p >= 0.05 as int) as passed from chi2p",
    "decile_compare": """select feature, quantile, round(s, 6) as synthetic, round(r, 6) as real from (select feature, unnest(['p10', 'p20', 'p30', 'p40', 'p50', 'p60', 'p70', 'p80', 'p90']) as quantile,
 unnest(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) filter (is_synthetic = 1)) as s,
 unnest(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) filter (is_synthetic = 0)) as r from long
 where value is not null and feature in ('vol_oi_ratio', 'premium', 'observed_return') group by feature)""",
    "label_rate_delta": f"""with c as (select count(*) filter (is_synthetic = 1 and label_success = 1) as a, count(*) filter (is_synthetic = 0 and label_success = 1) as b,
  count(*) filter (is_synthetic = 1 and label_success = 0) as c, count(*) filter (is_synthetic = 0 and label_success = 0) as d from labeled where labeled),
 x as (select *, cast(a + b + c + d as double) * pow(greatest(abs(cast(a as double) * d - cast(b as double) * c) - (a + b + c + d) / cast(2 as double), 0), 2)
  / (cast(a + b as double) * (c + d) * (a + c) * (b + d)) as chi2, a / cast(a + c as double) as rs, b / cast(b + d as double) as rr from c)
 select round(rs, 6) as synthetic_rate, round(rr, 6) as real_rate, round(rs - rr, 6) as delta, round(chi2, 6) as chi2, round(case when chi2 = 0 then 1 else 2 * (1 - {cdf('sqrt(chi2)')}) end, 6) as p_value from x""",
    "validation_gate": """select count(*) filter (ok) as passed, count(*) filter (not ok and known) as documented, count(*) filter (not ok and not known) as unexpected,
 case when count(*) filter (not ok and not known) = 0 then 'pass' else 'fail' end as status from (
 select *, feature in ('vol_oi_ratio', 'dte', 'premium', 'implied_vol', 'observed_return') as known from (select feature, d < 0.05 as ok from ks union all select feature, p >= 0.05 from chi2p))""",
    "topk_unusual": f"""select ticker, {d('snapshot_date', 'expiration')}, strike, option_type, vol_oi_ratio, {half_up('volume * last_price * 100', 2)} as premium,
 case when bid = ask then 'MID' when last_price >= ask then 'BUY' when last_price <= bid then 'SELL' when last_price > (bid + ask) / 2 then 'BUY'
 when last_price < (bid + ask) / 2 then 'SELL' else 'MID' end as side, {K} from (
 select * from near_ratioed where vol_oi_ratio >= 8 order by vol_oi_ratio desc, ticker, snapshot_date, expiration, strike, option_type, {K} limit 100)""",    
    "stream_topk": f"""select ticker, {d('snapshot_date', 'expiration')}, strike, option_type, vol_oi_ratio, {half_up('volume * last_price * 100', 2)} as premium,
 case when bid = ask then 'MID' when last_price >= ask then 'BUY' when last_price <= bid then 'SELL' when last_price > (bid + ask) / 2 then 'BUY'
 when last_price < (bid + ask) / 2 then 'SELL' else 'MID' end as side, {K} from (
 select * from near_ratioed where vol_oi_ratio >= 8 order by vol_oi_ratio desc, ticker, snapshot_date, expiration, strike, option_type, {K} limit 100)""",
    "sort_nulls_last": "select id, coalesce(observed_return, -9) as observed_return from labeled",
    "stream_whale_log": f"""with recursive w as (select * from raw where vol_oi_ratio >= 5),
 k as (select ticker, option_type, side, min(ts) as ts from w group by all
 union all select k.ticker, k.option_type, k.side, (select min(e.ts) from w e where e.ticker = k.ticker and e.option_type = k.option_type and e.side = k.side
  and e.ts > k.ts + interval 12 hour) as ts from k where k.ts is not null)
 select min_by(w.id, w.id) as id, w.ticker, w.option_type, w.side, min_by(w.vol_oi_ratio, w.id) as vol_oi_ratio, strftime(w.ts, '%Y-%m-%d %H:%M:%S') as ts
 from w join k on w.ticker = k.ticker and w.option_type = k.option_type and w.side = k.side and w.ts = k.ts group by w.ticker, w.option_type, w.side, w.ts""",
    "stream_scan_summary": f"""select {ts('window_start')}, {half_up('a', 2)} as avg_vol_oi, m as max_vol_oi, call_volume, put_volume, {PCR}, whale_count from (
 select timestamp '1970-01-01' + to_days(cast(30 * ((ts::date - date '1970-01-01') // 30) as int)) as window_start, avg(vol_oi_ratio) as a, max(vol_oi_ratio) as m,
 cast(coalesce(sum(volume) filter (option_type = 'Call'), 0) as bigint) as call_volume, cast(coalesce(sum(volume) filter (option_type <> 'Call'), 0) as bigint) as put_volume,
 count(*) filter (vol_oi_ratio >= 5) as whale_count from raw group by 1)""",
}


def _recursive_safe(body: str) -> str:
    """Blocks go before the query's own WITH list."""
    lead = body.lstrip()
    for head in ("with recursive ", "with "):
        if lead.startswith(head):
            names = _needed(body)
            blocks = ",\n".join(f"{n} as ({BLOCKS[n]})" for n in names)
            return head + (blocks + ",\n" if blocks else "") + lead[len(head):]
    return _sql(body)


ORACLE = {name: _recursive_safe(body) for name, body in BODIES.items()}
