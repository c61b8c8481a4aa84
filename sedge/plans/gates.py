"""Resampling by cluster, and the gates that read its intervals.

A replicate gives each cluster a weight from the Poisson distribution of mean one, worked out from md5 of
seed, replicate and cluster: no places, no joins, the same draws in any engine and
partitioning. Functions here make SQL for any table of clusters and any thresholds; the
queries below apply them to events and line items.
"""

from __future__ import annotations

import re

from sedge.functions import draws
from sedge.plans.dialect import EVENTS, LEDGER, count_if, for_oracle, md5_int, quantile, sql_query
from sedge.plans.routes import ROUTES

REPLICATES = 200
#: A sum of weights, or of weights times a column.
_SUM = re.compile(r"sum\(w(?: \* (\w+))?\)")


def resampled(seed: str, clusters: str, groups: list[str], statistics: dict[str, str], replicates: int = REPLICATES, small: bool = False, shared: bool = False) -> str:
    """CTEs num (the clusters), drawn (each with rep and its weight w) and stat (groups, rep, statistics).

    clusters is SQL with the groups and a column `unit`, which names a cluster within them. Spark has
    weights from one call over many digests, and sums of them batch by batch (batched), so no row is made for each
    cluster and replicate; only drawn makes them. small: groups are many and small, so each is dealt to one task whole.
    shared: a unit occurs in many groups, so its rows are brought together and a batch has few digests.
    """
    u = for_oracle(md5_int(f"concat('{seed}:', cast(rep as varchar(20)), ':', cast(unit as varchar(200)))")) + f" % {draws.SCALE}"
    weight = " + ".join(f"case when u >= {t} then 1 else 0 end" for t in draws.STEPS)
    by = "".join(f"{g}, " for g in groups)
    stats = ", ".join(f"{x} as {name}" for name, x in statistics.items())
    spark_unit = f"cast(unit as varchar(200)), '{seed}', {replicates}"
    values = sorted(set(_SUM.findall(stats)) - {""})
    summed = _SUM.sub(lambda m: f"sum(s[{values.index(m[1]) + 1 if m[1] else 0}])", stats)
    columns = "".join(f", {c}" for c in [str(len(groups)), *groups, *values])
    deal = ", ".join(groups) if small else "unit" if shared else ""
    dealt = f"(select * from num distribute by {deal} sort by {deal}) n" if deal else "num"
    spark_stat = f"""batched as (select {by}{draws.SUMS}({spark_unit}{columns}) as sums from {dealt}),
      stat as (select {by}rep, {summed} from batched lateral view posexplode(sums) p as rep, s group by {by}rep)""" if "count(" not in stats else f"stat as (select {by}rep, {stats} from drawn group by {by}rep)"
    return f"""num as ({clusters}), <<drawn as (select num.*, rep, cast(weight as int) as w from num lateral view posexplode({draws.NAME}({spark_unit})) d as rep, weight), {spark_stat}||every_rep as (select num.*, unnest(range({replicates})) as rep from num),
      chance as (select every_rep.*, {u} as u from every_rep), drawn as (select chance.*, {weight} as w from chance),
      stat as (select {by}rep, {stats} from drawn group by {by}rep)>>"""


def interval(x: str = "x", low: float = 0.025, high: float = 0.975) -> str:
    return f"round({quantile(x, low)}, 7) as low, round({quantile(x, high)}, 7) as high"


MEAN = "case when sum(w) > 0 then sum(w * d) / sum(w) end"
GAIN = "case when sum(w * sb) > 0 then 1 - sum(w * sc) / sum(w * sb) end"
POSITIVE = "round(avg(case when x > 0 then cast(1 as double) else cast(0 as double) end), 7) as share_positive"

_USERS = "select user_id as unit, sum(base) as sb, sum(cand) as sc, avg(cand - base) as d from ev group by user_id"
_LAYERS = "select layer as unit, sum(base) as sb, sum(cand) as sc from led group by layer"

sql_query("bootstrap_mean_ci", f"with {EVENTS}, {resampled('mean', _USERS, [], {'x': MEAN})} select round(avg(x), 7) as mean, round(stddev_samp(x), 7) as se, {interval()}, count(x) as n_replicates from stat")
sql_query("bootstrap_improvement_ci", f"with {EVENTS}, {resampled('gain', _USERS, [], {'x': GAIN})} select {interval()}, count(*) as n_replicates, {POSITIVE} from stat where x is not null")
sql_query("cluster_ratio_ci", f"with {LEDGER}, {resampled('ratio', _LAYERS, [], {'x': 'case when sum(w * sb) > 0 then sum(w * sc) / sum(w * sb) end'})} select {interval()}, count(x) as n_replicates from stat")
# a median needs a cluster as often as it was drawn
sql_query(
    "bootstrap_median_ratio",
    f"""with {LEDGER}, {resampled('median', _LAYERS, [], {'n': 'count(*)'})},
      copies as (<<select rep, sc / sb as ratio, explode(sequence(1, w)) as k from drawn where w > 0 and sb > 0||select rep, sc / sb as ratio, unnest(range(w)) as k from drawn where w > 0 and sb > 0>>),
      m as (select rep, {quantile('ratio', 0.5)} as x from copies group by rep) select {interval()}, count(*) as n_replicates from m""",
)
#: Documents pooled over all experts of a format.
sql_query(
    "codebook_bootstrap",
    f"""with {LEDGER}, {resampled('codebook', 'select mode_b, l_orderkey as unit, sum(base) as sb, sum(cand) as sc from led group by mode_b, l_orderkey', ['mode_b'], {'x': GAIN}, 100)}
      select mode_b, {interval()}, count(*) as n_replicates, {POSITIVE} from stat where x is not null group by mode_b""",
)

_KEEP = 10
_ITEMS = "l as (select expert % 50 as item, layer, sum(base - cand) as gain from led group by 1, 2)"
_KEPT = f"""{_ITEMS}, {resampled('keep', 'select layer as unit, item, gain from l', ['item'], {'score': 'round(sum(w * gain), 3)'}, shared=True)},
      kept as (select rep, item, row_number() over (partition by rep order by score desc, item) <= {_KEEP} as k from stat),
      whole as (select item, gain, row_number() over (order by round(gain, 3) desc, item) <= {_KEEP} as k from (select item, sum(gain) as gain from l group by item) t)"""
sql_query("keep_stability", f"with {LEDGER}, {_KEPT} select item, {count_if('k')} as n_kept, round(avg(case when k then cast(1 as double) else cast(0 as double) end), 9) as inclusion from kept group by item")
sql_query(
    "keep_stability_summary",
    f"""with {LEDGER}, {_KEPT}, r as (select rep, {count_if('kept.k and whole.k')} as n_both, sum(case when kept.k then whole.gain else 0 end) as got, sum(case when whole.k then whole.gain else 0 end) as best from kept join whole on kept.item = whole.item group by rep)
      select round(avg(n_both / cast({2 * _KEEP} - n_both as double)), 7) as jaccard, round(avg({_KEEP} - n_both), 7) as churn, round(avg((best - got) / best), 7) as regret, round(max((best - got) / best), 7) as worst_regret from r""",
)


def paired_verdict(clusters: str, minimum: float, noise: float, replicates: int = REPLICATES) -> str:
    """Row per domain and for all: paired improvement with its interval, status, and the verdict of the whole.

    clusters: SQL with domain, unit, b and c, one row a window. fail: the whole or a domain is
    worse by its interval; pass: the whole is better by interval and by more than the noise, and no domain's
    point is worse; else repeat_required.
    """
    windows = f"select domain, cast(unit as varchar(100)) as unit, b, c, b - c as d from ({clusters}) q union all select 'all' as domain, concat(domain, ':', cast(unit as varchar(100))) as unit, b, c, b - c as d from ({clusters}) q"
    return f"""{resampled('verdict', windows, ['domain'], {'x': MEAN}, replicates)},
      ci as (select domain, stddev_samp(x) as se, {quantile('x', 0.025)} as low, {quantile('x', 0.975)} as high from stat group by domain),
      pt as (select domain, count(*) as n_windows, avg(b) as baseline, avg(c) as candidate, avg(d) as estimate, {count_if('d > 0')} as improved, {count_if('d = 0')} as tied, {count_if('d < 0')} as regressed from num group by domain),
      j as (select pt.domain, n_windows, baseline, candidate, estimate, improved, tied, regressed, se, low, high,
              case when low > {minimum} then 'improvement_supported' when high < -{minimum} then 'regression_supported' else 'inconclusive' end as status from pt join ci on pt.domain = ci.domain),
      v as (select max(case when status = 'regression_supported' then 1 else 0 end) as worse, max(case when domain = 'all' and status = 'improvement_supported' and abs(estimate) > {noise} then 1 else 0 end) as better,
              max(case when domain <> 'all' and estimate < 0 then 1 else 0 end) as point_worse from j)
      select j.domain, n_windows, round(baseline, 7) as baseline_mean, round(candidate, 7) as candidate_mean, round(estimate, 7) as improvement, round(se, 7) as se, round(low, 7) as low, round(high, 7) as high, improved, tied, regressed, status,
             case when v.worse = 1 then 'fail' when v.better = 1 and v.point_worse = 0 then 'pass' else 'repeat_required' end as verdict from j join v on true"""


sql_query("kld_verdict", f"with {EVENTS}, {paired_verdict('select event_type as domain, user_id as unit, avg(base) as b, avg(cand) as c from ev group by 1, 2', 0.0, 0.01)}")


def cvar(values: str, group: str, rows: str) -> str:
    """SQL of group, cvar1: the mean of the largest hundredth, rounded up, of each column of `values` (name: column)."""
    return f"select {group}, avg(case when k <= ceil(0.01 * n) then v end) as cvar1 from (select {group}, {values} as v, row_number() over (partition by {group} order by {values} desc) as k, count(*) over (partition by {group}) as n from {rows}) q group by {group}"


_CLUSTERS = "cl as (select event_type, user_id, avg(cand - base) as delta from ev group by event_type, user_id)"


def screen(take: int, least: int) -> str:
    """The first documents: mean below zero, enough of them better, and the pooled tail not worse."""
    return f"""{_CLUSTERS}, p as (select event_type, user_id, delta, row_number() over (partition by event_type order by user_id) as k from cl), s as (select event_type, user_id, delta from p where k <= {take}),
      rows_of as (select ev.event_type, base, cand from ev join s on ev.event_type = s.event_type and ev.user_id = s.user_id), tb as ({cvar('base', 'event_type', 'rows_of')}), tc as ({cvar('cand', 'event_type', 'rows_of')}),
      d as (select event_type, count(*) as n_documents, avg(delta) as m, {count_if('delta < 0')} as improved, {count_if('delta > 0')} as regressed from s group by event_type)
      select d.event_type, n_documents, round(m, 9) as mean_delta, improved, regressed, round(tb.cvar1, 7) as baseline_cvar1, round(tc.cvar1, 7) as candidate_cvar1,
             n_documents = {take} and m < 0 and improved >= {least} and tc.cvar1 <= tb.cvar1 as passed from d join tb on d.event_type = tb.event_type join tc on d.event_type = tc.event_type"""


sql_query("screening_gate", f"with {EVENTS}, {screen(8, 6)}")


def confirmation(tolerance: float) -> str:
    """One-sided upper bound of the mean below zero, and the candidate's tail within a tolerance of the baseline's."""
    return f"""{_CLUSTERS}, {resampled('confirm', 'select event_type, user_id as unit, delta as d from cl', ['event_type'], {'x': MEAN}, shared=True)},
      up as (select event_type, {quantile('x', 0.95)} as high from stat group by event_type), tb as ({cvar('base', 'event_type', 'ev')}), tc as ({cvar('cand', 'event_type', 'ev')})
      select up.event_type, round(high, 7) as upper_95, high < 0 as mean_ok, round(tb.cvar1, 7) as baseline_cvar1, round(tc.cvar1, 7) as candidate_cvar1, tc.cvar1 <= {1 + tolerance} * tb.cvar1 as tail_ok, high < 0 and tc.cvar1 <= {1 + tolerance} * tb.cvar1 as passed
      from up join tb on up.event_type = tb.event_type join tc on up.event_type = tc.event_type"""


sql_query("confirmation_gate", f"with {EVENTS}, {confirmation(0.05)}")
sql_query(
    "mode_gate",
    f"""with {LEDGER}, m as (select mode_a, layer as unit, sum(base) as sb, sum(cand) as sc from led group by 1, 2), n as (select mode_a, unit, sb, sc from m union all select 'all' as mode_a, unit, sum(sb) as sb, sum(sc) as sc from m group by unit),
      {resampled('modes', 'select mode_a, unit, sb, sc from n', ['mode_a'], {'x': GAIN}, shared=True)},
      ci as (select mode_a, {quantile('x', 0.025)} as low, {quantile('x', 0.975)} as high, count(x) as n_replicates from stat group by mode_a), pt as (select mode_a, count(*) as n, 1 - sum(sc) / sum(sb) as gain from num group by mode_a)
      select pt.mode_a, n, round(gain, 9) as gain, round(low, 7) as low, round(high, 7) as high, n_replicates, low > 0 as passes, (select min(case when low > 0 then 1 else 0 end) from ci) = 1 as all_pass from pt join ci on pt.mode_a = ci.mode_a""",
)


def propose_and_confirm(modes: str, least_fit: int, least_confirm: int, margin: float, replicates: int = 100) -> str:
    """Row per item: the mode that the fitting documents propose, and whether the others confirm it.

    modes: SQL with item, unit (document), fit (boolean), m0, m1, ... as `mode` and `sse` rows.
    Mode 0 is the baseline; ties go to the smaller mode. Reasons follow the order of the tests.
    """
    return f"""sse as ({modes}), support as (select item, count(distinct case when fit then unit end) as n_fit, count(distinct case when not fit then unit end) as n_confirm from sse group by item),
      totals as (select item, mode, round(sum(sse), 3) as total from sse where fit group by item, mode), best as (select item, <<min_by(mode, struct(total, mode))||arg_min(mode, (total, mode))>> as mode from totals group by item),
      pair as (select s.item, s.unit, sum(case when s.mode = 0 then s.sse else 0 end) as sb, sum(case when s.mode = best.mode then s.sse else 0 end) as sc from sse s join best on s.item = best.item where not s.fit and best.mode <> 0 group by s.item, s.unit),
      {resampled('propose', 'select item, unit, sb, sc from pair', ['item'], {'x': GAIN}, replicates, small=True)},
      ci as (select item, {quantile('x', 0.025)} as low, {quantile('x', 0.975)} as high, count(x) as n_valid from stat group by item), pt as (select item, case when sum(sb) > 0 then 1 - sum(sc) / sum(sb) end as gain from num group by item),
      r as (select u.item, u.n_fit, u.n_confirm, best.mode as proposed, pt.gain, ci.low, ci.high, coalesce(ci.n_valid, 0) as n_valid,
              case when u.n_fit < {least_fit} then 'insufficient fit-document support' when coalesce(best.mode, 0) = 0 then 'mode 0 is the fit-document argmin' when u.n_confirm < {least_confirm} then 'insufficient confirmation-document support'
                   when ci.low is null then 'confirmation bootstrap has no valid baseline samples' when ci.low <= {margin} then 'confirmation lower confidence bound did not clear the margin' else 'confirmation lower confidence bound cleared the margin' end as reason
            from support u left join best on u.item = best.item left join ci on u.item = ci.item left join pt on u.item = pt.item)
      select item, case when n_fit < {least_fit} then 0 else proposed end as proposed, case when reason like '%cleared the margin' then proposed else 0 end as selected, reason, n_fit, n_confirm, round(gain, 7) as gain, round(low, 7) as low, round(high, 7) as high, n_valid from r"""


#: Three modes of a layer's items: as they are, the candidate, and the mean of both at a small cost.
_MODES = """select layer as item, l_orderkey as unit, l_orderkey % 3 <> 0 as fit, m.mode, sum(case m.mode when 0 then base when 1 then cand else (base + cand) / 2 + 1 end) as sse
       from led join (select 0 as mode union all select 1 as mode union all select 2 as mode) m on true group by 1, 2, 3, 4"""
sql_query("propose_confirm", f"with {LEDGER}, {propose_and_confirm(_MODES, 8, 4, 0.0)}")

#: Metrics of a document that compares two routings.
_METRICS = """doc as (select user_id as unit, avg(case when official = interim then cast(1 as double) else cast(0 as double) end) as retention, sum(w * w2) / sqrt(sum(w * w) * sum(w2 * w2)) as gate_cosine, count(distinct case when official = interim then official end) / cast(count(distinct official) as double) as slot_overlap from rt group by user_id)"""
_THRESHOLDS = {"retention": 0.85, "gate_cosine": 0.90, "slot_overlap": 0.90}


def document_metrics(replicates: int = REPLICATES) -> str:
    """CTE met: metric, estimate, bootstrap_mean, lower_95, upper_95, by resampled documents."""
    stats = {f"x_{m}": f"case when sum(w) > 0 then sum(w * {m}) / sum(w) end" for m in _THRESHOLDS}
    one = lambda m: f"select '{m}' as metric, (select avg({m}) from num) as estimate, avg(x_{m}) as bootstrap_mean, {quantile(f'x_{m}', 0.025)} as lower_95, {quantile(f'x_{m}', 0.975)} as upper_95 from stat"
    return f"{_METRICS}, {resampled('documents', 'select * from doc', [], stats, replicates)}, met as ({' union all '.join(map(one, _THRESHOLDS))})"


sql_query("document_metric_bootstrap", f"with {ROUTES}, {document_metrics()} select metric, round(estimate, 7) as estimate, round(bootstrap_mean, 7) as bootstrap_mean, round(lower_95, 7) as lower_95, round(upper_95, 7) as upper_95 from met")
_BARS = " union all ".join(f"select '{m}' as metric, cast({t} as double) as bar" for m, t in _THRESHOLDS.items())
sql_query(
    "teacher_proxy_gate",
    f"""with {ROUTES}, {document_metrics()}, bars as ({_BARS}), slots as (select official, avg(case when official = interim then cast(1 as double) else cast(0 as double) end) as r from rt group by official),
      every as (select met.metric, bar, estimate, lower_95 from met join bars on met.metric = bars.metric
        union all select 'slot_support' as metric, cast(0.75 as double) as bar, count(*) / cast(100 as double) as estimate, cast(null as double) as lower_95 from slots
        union all select 'slot_retention_p10' as metric, cast(0.4 as double) as bar, {quantile('r', 0.1)} as estimate, cast(null as double) as lower_95 from slots),
      d as (select metric, bar, estimate, lower_95, estimate >= bar as point_pass, estimate >= bar and coalesce(lower_95 >= bar, true) as lower_pass from every),
      v as (select max(case when not point_pass then 2 when not lower_pass then 1 else 0 end) as worst from d)
      select metric, bar as threshold, round(estimate, 7) as estimate, round(lower_95, 7) as lower_95, point_pass, lower_pass, case v.worst when 2 then 'fail' when 1 then 'repeat_required' else 'pass' end as status from d join v on true""",
)

#: Timings: values stand for a baseline's and a candidate's time, a user for a paired run, its parity for the kind of run.
sql_query(
    "performance_gate",
    f"""with {EVENTS}, timed as (select case when user_id % 2 = 0 then 'isolated' else 'routed' end as part, event_type as cell, user_id as unit, sum(cand) / sum(base) as ratio from ev group by 1, 2, 3 having sum(base) > 0),
      {resampled('timing', 'select part, cell, unit, ratio from timed', ['part', 'cell'], {'n': 'count(*)'}, 100)},
      copies as (<<select part, cell, rep, ratio, explode(sequence(1, w)) as k from drawn where w > 0||select part, cell, rep, ratio, unnest(range(w)) as k from drawn where w > 0>>),
      med as (select part, cell, rep, {quantile('ratio', 0.5)} as x from copies group by part, cell, rep), ci as (select part, cell, {quantile('x', 0.975)} as high from med group by part, cell),
      pt as (select part, cell, count(*) as n, {quantile('ratio', 0.5)} as median from timed group by part, cell),
      d as (select pt.part, pt.cell, n, median, high, case when pt.part = 'isolated' then 1.02 else 1.05 end as bar from pt join ci on pt.part = ci.part and pt.cell = ci.cell),
      v as (select part, max(case when high > bar then 1 else 0 end) as failed from d group by part), w as (select max(failed) as failed from v)
      select d.part, cell, n, round(median, 7) as median_ratio, round(high, 7) as upper_95, cast(bar as double) as bar, high <= bar as passed, case when v.failed = 1 then 'fail' else 'pass' end as part_verdict, case when w.failed = 1 then 'fail' else 'pass' end as verdict
      from d join v on d.part = v.part join w on true""",
)


def familywise(candidates: str, minimum: float, replicates: int = 400) -> str:
    """Row per item: the draw of the least sum, taken if the lower quantile of its paired gain clears the bar.

    candidates: SQL with item, draw (0 is the baseline), unit, v. The quantile is 0.05 over
    the number of comparisons; sums are of deltas, not means.
    """
    return f"""cand_of as ({candidates}), totals as (select item, draw, round(sum(v), 4) as total from cand_of group by item, draw),
      best as (select item, <<min_by(draw, struct(total, draw))||arg_min(draw, (total, draw))>> as draw, count(*) - 1 as comparisons, max(case when draw = 0 then total end) as base_total from totals group by item),
      pair as (select c.item, c.unit, sum(case when c.draw = 0 then v else -v end) as d from cand_of c join best on c.item = best.item where best.draw <> 0 and c.draw in (0, best.draw) group by c.item, c.unit),
      {resampled('family', 'select item, unit, d from pair', ['item'], {'x': 'sum(w * d)'}, replicates, shared=True)},
      low as (select stat.item, <<percentile(x, array(0.05, 0.025, 0.016666666666666666, 0.0125))||quantile_cont(x, [0.05, 0.025, 0.016666666666666666, 0.0125])>> as lows from stat group by stat.item)
      select best.item, best.draw as proposed, case when {_LOW} > {minimum} * base_total then best.draw else 0 end as selected, round({_LOW}, 4) as lower_bound, round({minimum} * base_total, 4) as required,
             case when best.draw = 0 then 'draw_zero_is_argmin' when {_LOW} > {minimum} * base_total then 'familywise_paired_lower_bound_passed' else 'familywise_paired_lower_bound_did_not_pass' end as reason
      from best left join low on best.item = low.item"""


_LOW = "<<element_at(lows, cast(least(greatest(comparisons, 1), 4) as int))||list_extract(lows, least(greatest(comparisons, 1), 4))>>"
_DRAWS = "select event_type as item, m.draw, user_id as unit, sum(case m.draw when 0 then base when 1 then cand else base * 0.97 + cand * 0.02 end) as v from ev join (select 0 as draw union all select 1 as draw union all select 2 as draw) m on true group by 1, 2, 3"
sql_query("paired_lower_bound", f"with {EVENTS}, {familywise(_DRAWS, 0.001)}")
