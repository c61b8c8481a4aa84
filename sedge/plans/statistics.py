"""Paired measurements: summaries by cluster and domain, tails, moments, ranks, gates and resampling."""

from __future__ import annotations

from sedge.plans.dialect import EVENTS, LEDGER, count_if, quantile, sql_query

#: Cluster means, pooled and equal weights, tails: overall and by domain.
_CLUSTERS = "cl as (select event_type, user_id, avg(cand - base) as delta, count(*) as n from ev group by event_type, user_id)"

sql_query(
    "paired_document_summary",
    f"""with {EVENTS},
      c as (select event_type, user_id, avg(base) as mb, avg(cand) as mc, sum(base) as sb, sum(cand) as sc, count(*) as n from ev group by event_type, user_id)
      select coalesce(event_type, 'all') as domain, count(*) as n_clusters, cast(sum(n) as bigint) as n_rows,
             round(avg(mc - mb), 9) as equal_mean, round(sum(sc - sb) / sum(n), 9) as pooled_mean,
             {count_if("mc < mb")} as better, {count_if("mc = mb")} as equal, {count_if("mc > mb")} as worse,
             round({quantile("mc - mb", 0.99)}, 9) as p99, round(power(sum(n), 2) / sum(n * n), 6) as effective_clusters
      from c group by grouping sets ((), (event_type))""",
)

sql_query(
    "paired_position_summary",
    f"""with {EVENTS} select event_type, count(*) as n, round(avg(base), 9) as mean_base, round(avg(cand), 9) as mean_cand,
             round(case when avg(base) > 0 then 1 - avg(cand) / avg(base) end, 9) as relative_reduction, round(stddev_samp(cand - base), 9) as stddev_delta,
             {count_if("cand < base")} as better, {count_if("cand > base")} as worse from ev group by event_type""",
)

sql_query(
    "sse_by_document",
    f"""with {EVENTS}, skeleton as (select distinct user_id from ev)
      select s.user_id, count(e.event_id) as n, round(coalesce(sum(power(e.k / cast(100 as double), 2) * power(e.cand - e.base, 2)), 0), 6) as sse,
             round(coalesce(sum(power(e.k / cast(100 as double), 2) * power(e.base, 2)), 0), 4) as energy
      from skeleton s left join ev e on s.user_id = e.user_id group by s.user_id""",
)

sql_query("weighted_relative_sse", f"with {LEDGER} select layer, round(sum(power((cand - base) * weight, 2)) / sum(power(base * weight, 2)), 9) as relative_sse from led group by layer")

sql_query(
    "domain_rollup",
    f"""with {EVENTS} select event_type, case when grouping(event_type) = 1 then 1 else 0 end as is_total, count(*) as n, round(avg(cand - base), 9) as mean_delta from ev group by rollup(event_type)""",
)

sql_query(
    "weighted_mean_check",
    f"""with {EVENTS}, w as (select event_type, user_id, count(*) as n, avg(base) as m from ev group by 1, 2), t as (select event_type, avg(base) as declared from ev group by 1)
      select w.event_type, abs(sum(n * m) / sum(n) - max(declared)) <= 1e-6 * abs(max(declared)) as consistent, cast(sum(n) as bigint) as n from w join t on w.event_type = t.event_type group by w.event_type""",
)

sql_query(
    "moment_metrics",
    f"""with {EVENTS}, m as (select event_type, count(*) as n, sum(base) as sb, sum(cand) as sc, sum(base * base) as sbb, sum(cand * cand) as scc, sum(base * cand) as sbc, sum(power(cand - base, 2)) as sdd, max(abs(cand - base)) as worst from ev group by event_type)
      select event_type, n, round(case when sbb > 0 then sqrt(sdd / sbb) end, 9) as relative_l2, round(case when sbb > 0 and scc > 0 then sbc / sqrt(sbb * scc) end, 9) as cosine,
             round((n * sbc - sb * sc) / sqrt((n * sbb - sb * sb) * (n * scc - sc * sc)), 6) as pearson, round(worst, 9) as max_abs from m""",
)

sql_query(
    "margin_stats",
    f"""with {EVENTS}, m as (select user_id, event_type, base - lead(base) over (partition by user_id, event_type order by base desc, event_id) as margin from ev)
      select event_type, count(margin) as n, round(avg(margin), 9) as mean, round(min(margin), 9) as least, round({quantile("margin", 0.5)}, 9) as median, round(max(margin), 9) as most,
             round(avg(case when margin <= 0.01 then 1.0 when margin > 0.01 then 0.0 end), 9) as share_small, round(avg(case when margin <= 0.1 then 1.0 when margin > 0.1 then 0.0 end), 9) as share_near
      from m where margin is not null group by event_type""".replace("1.0", "cast(1 as double)").replace("0.0 ", "cast(0 as double) "),
)

sql_query(
    "weighted_moments",
    f"""with {EVENTS}, w as (select event_type, base, greatest(k - 20, 0) as w from ev)
      select event_type, round(sum(w * base) / sum(w), 9) as mean, round(sum(w * abs(base)) / sum(w), 9) as mean_abs, round(sqrt(sum(w * base * base) / sum(w)), 9) as rms,
             round(cast(sum(case when base > 50 then w else 0 end) as double) / sum(w), 9) as share_over from w group by event_type""",
)

sql_query("effective_sample_size", f"with {EVENTS} select event_type, round(power(sum(base), 2) / sum(base * base), 6) as ess, count(*) as n from ev group by event_type")

sql_query(
    "ratio_report",
    f"""with {LEDGER} select layer, case when grouping(layer) = 1 then 'all' else 'layer' end as grain, round(sum(cand) / sum(base), 9) as ratio_of_sums, round(exp(avg(ln(cand / base))), 9) as geometric_mean,
             round({quantile("cand / base", 0.5)}, 9) as median_ratio, {count_if("cand < base")} as wins, {count_if("cand = base")} as ties, {count_if("cand > base")} as losses
      from led group by grouping sets ((), (layer))""",
)

sql_query(
    "metric_summary",
    f"""with {LEDGER} select mode_a, mode_b, round(sum(base), 2) as baseline, round(sum(cand), 2) as selected, round(case when sum(base) > 0 then 1 - sum(cand) / sum(base) end, 9) as relative_improvement,
             round(sum(power(cand - base, 2)) / sum(power(base, 2)), 9) as nmse from led group by mode_a, mode_b""",
)

sql_query(
    "mode_crosstab",
    """with a as (select distinct l_returnflag as mode_a from lineitem), b as (select distinct l_linestatus as mode_b from lineitem),
      n as (select l_returnflag as mode_a, l_linestatus as mode_b, count(*) as n from lineitem group by 1, 2)
      select a.mode_a, b.mode_b, coalesce(n.n, 0) as n from a cross join b left join n on a.mode_a = n.mode_a and b.mode_b = n.mode_b""",
)

sql_query("distinct_support", f"with {EVENTS} select k, count(distinct user_id) as n_clusters, count(*) as n from ev group by k")

sql_query(
    "entropy_bits",
    f"""with {EVENTS}, c as (select event_type, k, count(*) as n from ev group by 1, 2), t as (select event_type, n / sum(n) over (partition by event_type) as p from (select event_type, cast(n as double) as n from c) x)
      select event_type, round(-sum(p * ln(p) / ln(2)), 8) as bits from t group by event_type""",
)

sql_query(
    "conditional_entropy",
    f"""with {EVENTS}, sc as (select event_type, k, cast(count(*) as double) as n from ev group by 1, 2), c as (select event_type, sum(n) as n from sc group by 1), t as (select sum(n) as n from c)
      select round((select -sum(sc.n / t.n * ln(sc.n / t.n) / ln(2)) from sc cross join t) - (select -sum(c.n / t.n * ln(c.n / t.n) / ln(2)) from c cross join t), 8) as bits from t""",
)

sql_query(
    "tile_entropy",
    """with w as (select l_suppkey as tile, cast(l_quantity as bigint) as symbol, cast(count(*) as double) as n from lineitem group by 1, 2),
      p as (select tile, n / sum(n) over (partition by tile) as p, n from w)
      select tile, cast(sum(n) as bigint) as n, round(-sum(p * ln(p) / ln(2)), 8) as bits, cast(ceil(sum(n) * -sum(p * ln(p) / ln(2)) / 8 - 1e-9) as bigint) as bound_bytes from p group by tile""",
)

sql_query(
    "shapley3",
    f"""with {LEDGER}, v as (select layer, sum(base) as v0, sum(case when mode_a = 'A' then cand else base end) as va, sum(case when mode_b = 'F' then cand else base end) as vb, sum(case when weight > 25 then cand else base end) as vc,
        sum(case when mode_a = 'A' or mode_b = 'F' then cand else base end) as vab, sum(case when mode_a = 'A' or weight > 25 then cand else base end) as vac, sum(case when mode_b = 'F' or weight > 25 then cand else base end) as vbc,
        sum(case when mode_a = 'A' or mode_b = 'F' or weight > 25 then cand else base end) as vabc from led group by layer)
      select layer, round((2 * (va - v0) + (vab - vb) + (vac - vc) + 2 * (vabc - vbc)) / 6, 3) as phi_a, round((2 * (vb - v0) + (vab - va) + (vbc - vc) + 2 * (vabc - vac)) / 6, 3) as phi_b,
             round((2 * (vc - v0) + (vac - va) + (vbc - vb) + 2 * (vabc - vab)) / 6, 3) as phi_c from v""",
)

sql_query(
    "measurement_controls",
    f"""with {EVENTS}, a as (select user_id, event_id, base as x from ev), b as (select user_id, event_id, base as x from ev), c as (select user_id, event_id, cand as x from ev)
      select a.user_id, count(*) as n, {count_if("a.x = b.x")} as n_repeat, round(max(abs(a.x - b.x)), 9) as repeat_max, round(max(abs(a.x - c.x)), 9) as change_max
      from a full outer join b on a.event_id = b.event_id full outer join c on a.event_id = c.event_id group by a.user_id""",
)

sql_query(
    "retention_rule",
    f"""with {EVENTS}, {_CLUSTERS}, r as (select event_type, delta, row_number() over (partition by event_type order by user_id) as k from cl)
      select event_type, avg(case when k <= 8 then delta end) < 0 as first_ok, avg(case when k > 8 then delta end) < 0 as second_ok,
             avg(case when k <= 8 then delta end) < 0 and avg(case when k > 8 then delta end) < 0 as retained from r where k <= 16 group by event_type""",
)

sql_query("local_fallback", f"with {LEDGER} select layer, avg(cand) < avg(base) and max(cand) <= 1.02 * max(base) as passes, round(avg(cand) - avg(base), 6) as mean_change from led group by layer")

sql_query(
    "probe_comparison",
    f"""with {EVENTS}, p as (select user_id, event_id, base, cand, cast(floor(base) as bigint) = cast(floor(cand) as bigint) as same from ev)
      select user_id, count(*) as n, {count_if("same")} as n_same, {count_if("abs(base - cand) <= 0.1")} as n_close, round(max(abs(base - cand)), 9) as worst from p group by user_id""",
)
