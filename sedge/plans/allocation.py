"""Quotas, budgets and choices over tables."""

from __future__ import annotations

from sedge.plans.dialect import EVENTS, LEDGER, sql_query

_WEIGHTS = "w as (select source, cast(count(*) % 7 + 1 as bigint) as weight, row_number() over (order by source) - 1 as idx from documents group by source)"
#: Whole numbers keep sums exact whatever the order of rows.
_OPTIONS = f"{LEDGER}, item as (select layer, expert, cast(round(sum(base - cand) * 100) as bigint) as damage, cast(sum(weight) as bigint) as n_bytes from led group by 1, 2)"

sql_query(
    "quota_round_robin",
    f"""with {_WEIGHTS}, q as (select source, idx, cast(floor(1001 * weight / cast(sum(weight) over () as double)) as bigint) as base from w), r as (select source, idx, base, 1001 - sum(base) over () as left_over from q)
      select source, cast(base + case when idx < left_over then 1 else 0 end as bigint) as quota from r""",
)
sql_query(
    "quota_largest_remainder",
    f"""with {_WEIGHTS}, q as (select source, idx, 1001 * weight as x, sum(weight) over () as t from w), f as (select source, idx, cast(floor(x / cast(t as double)) as bigint) as base, x % t as frac from q),
      r as (select source, base, row_number() over (order by frac desc, idx) as k, 1001 - sum(base) over () as left_over from f) select source, cast(base + case when k <= left_over then 1 else 0 end as bigint) as quota from r""",
)
sql_query(
    "lagrangian_fixed_lambda",
    f"""with {_OPTIONS}, s as (select layer, expert, damage, n_bytes, damage - 1500 * n_bytes as score from item),
      p as (select layer, row_number() over w as n, sum(score) over w as objective, sum(n_bytes) over w as n_bytes, sum(damage) over w as damage from s window w as (partition by layer order by score desc, expert rows between unbounded preceding and current row)),
      z as (select layer, n, objective, n_bytes, damage from p union all select distinct layer, 0 as n, 0 as objective, 0 as n_bytes, 0 as damage from item),
      b as (select layer, n, objective, n_bytes, damage, row_number() over (partition by layer order by objective desc, n_bytes, n) as k from z)
      select layer, cast(n as bigint) as n_kept, cast(n_bytes as bigint) as n_bytes, cast(damage as bigint) as damage from b where k = 1""",
)
_GRID = [250 * k for k in range(40)]
_AT = lambda lam, v: f"sum(case when damage > {lam} * n_bytes then {v} else 0 end)"
# one pass over the items: a conditional sum for each multiplier, then forty rows of them
sql_query(
    "lagrangian_grid",
    f"""with {_OPTIONS}, s as (select sum(n_bytes) * 0.4 as budget, {", ".join(f"{_AT(lam, 'n_bytes')} as b{lam}, {_AT(lam, 'damage')} as d{lam}" for lam in _GRID)} from item),
      t as (<<select budget, stack({len(_GRID)}, {", ".join(f"{lam}, b{lam}, d{lam}" for lam in _GRID)}) as (lam, n_bytes, damage) from s||select budget, unnest([{", ".join(str(lam) for lam in _GRID)}]) as lam, unnest([{", ".join(f"b{lam}" for lam in _GRID)}]) as n_bytes, unnest([{", ".join(f"d{lam}" for lam in _GRID)}]) as damage from s>>)
      select cast(min(lam) as bigint) as lam, cast(max(n_bytes) as bigint) as n_bytes, cast(max(damage) as bigint) as damage from t where n_bytes <= budget""",
)
sql_query(
    "rate_options",
    f"""with {_OPTIONS}, o as (select layer, expert, r.rate, damage / r.rate + 800 * n_bytes * r.rate as cost from item cross join (select 2 as rate union all select 3 as rate union all select 4 as rate) r)
      select layer, expert, <<min_by(rate, struct(cost, rate))||arg_min(rate, (cost, rate))>> as rate from o group by layer, expert""",
)
sql_query(
    "dp_small",
    f"""with {_OPTIONS}, three as (select layer, expert, damage, n_bytes, row_number() over (partition by layer order by expert) as k from item),
      a as (select layer, max(case when k = 1 then damage end) as d1, max(case when k = 2 then damage end) as d2, max(case when k = 3 then damage end) as d3, max(case when k = 1 then n_bytes end) as b1, max(case when k = 2 then n_bytes end) as b2, max(case when k = 3 then n_bytes end) as b3 from three where k <= 3 group by layer),
      bit as (select 0 as v union all select 1 as v),
      c as (select layer, x.v as x1, y.v as x2, z.v as x3, x.v * d1 + y.v * d2 + z.v * d3 as gain, x.v * b1 + y.v * b2 + z.v * b3 as n_bytes from a cross join bit x cross join bit y cross join bit z where x.v * b1 + y.v * b2 + z.v * b3 <= 60),
      r as (select layer, x1, x2, x3, gain, n_bytes, row_number() over (partition by layer order by gain desc, n_bytes, x1 desc, x2 desc, x3 desc) as k from c) select layer, x1, x2, x3, cast(gain as bigint) as gain, cast(n_bytes as bigint) as n_bytes from r where k = 1""",
)
sql_query(
    "pair_exchange",
    f"""with {_OPTIONS}, g as (select layer, expert % 22 as neuron, sum(damage) as damage from item group by 1, 2)
      select lo.layer, lo.neuron as low, hi.neuron as high, cast(hi.damage - lo.damage as bigint) as delta, hi.damage < lo.damage as chosen from g lo join g hi on lo.layer = hi.layer and hi.neuron = 21 - lo.neuron and lo.neuron < hi.neuron""",
)
sql_query(
    "secant_update",
    f"""with {EVENTS}, c as (select event_type, k, cast(count(*) as double) as n, sum(base) as x, sum(cand) as y from ev group by 1, 2), s as (select event_type, k, n, greatest(-0.5, least(0.5, (y - x) / (100 * n))) as step from c)
      select event_type, k, round(step - avg(step) over (partition by event_type), 9) as update_by from s""",
)
sql_query(
    "nearest_codeword",
    """with book as (select 10.0 as c union all select 20.0 as c union all select 35.0 as c union all select 48.0 as c), d as (select distinct cast(l_quantity as bigint) as v from lineitem),
      r as (select v, c, row_number() over (partition by v order by abs(v - c), c) as k from d cross join book), a as (select v, c from r where k = 1)
      select cast(a.c as double) as codeword, count(*) as n, round(avg(power(l.l_quantity - cast(a.c as double), 2)), 9) as mse from lineitem l join a on cast(l.l_quantity as bigint) = a.v group by a.c""",
)
sql_query(
    "nearest_level_mse",
    f"""with {EVENTS}, lv as (select cast(v as double) as v from (select 0 as v union all select 25 as v union all select 50 as v union all select 75 as v union all select 100 as v) x)
      select event_type, round(avg(err), 9) as mse, count(*) as n from (select event_id, event_type, min(power(base - v, 2)) as err from ev cross join lv group by event_id, event_type) y group by event_type""",
)
sql_query(
    "route_feedback_step",
    f"""with {EVENTS}, t as (select k, sum(case when user_id % 2 = 0 then 1 else 0 end) as target, sum(case when user_id % 2 = 1 then 1 else 0 end) as got from ev group by k)
      select k, round((target - got) / cast(100 as double) - avg((target - got) / cast(100 as double)) over (), 9) as step from t""",
)
