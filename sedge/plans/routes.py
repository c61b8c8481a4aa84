"""Slots, routes, ledgers and their joins."""

from __future__ import annotations

from sedge.plans.dialect import EVENTS, LEDGER, count_if, same_query, sha, sql_query

#: Two routings of a row: its slot, and one that a hash moves now and then.
ROUTES = f"""{EVENTS}, rt as (select event_id, user_id, event_type, k as official, case when (event_id * 31) % 10 = 0 then (k + 7) % 100 else k end as interim, base as w, cand as w2 from ev)"""

sql_query(
    "paired_alignment",
    f"""with {EVENTS}, a as (select event_id, event_type, base from ev where event_id % 11 <> 0), b as (select event_id, event_type, cand from ev where event_id % 13 <> 0)
      select coalesce(a.event_type, b.event_type) as domain, {count_if("a.event_id is not null and b.event_id is not null")} as n_paired, {count_if("b.event_id is null")} as left_only, {count_if("a.event_id is null")} as right_only
      from a full outer join b on a.event_id = b.event_id and a.event_type = b.event_type group by 1""",
)
sql_query(
    "trace_key_coverage",
    f"""with {EVENTS}, a as (select user_id, event_type, k, sum(base) as x from ev where k % 5 <> 0 group by 1, 2, 3), b as (select user_id, event_type, k, sum(cand) as x from ev where k % 7 <> 0 group by 1, 2, 3)
      select coalesce(a.event_type, b.event_type) as stage, {count_if("b.k is null")} as left_only, {count_if("a.k is null")} as right_only, {count_if("a.k = b.k")} as n_shared, round(max(abs(a.x - b.x)), 6) as max_abs
      from a full outer join b on a.user_id = b.user_id and a.event_type = b.event_type and a.k = b.k group by 1""",
)
sql_query(
    "route_match_join",
    f"""with {ROUTES}, o as (select event_id, official as slot, w from rt), i as (select event_id, interim as slot, w2 from rt)
      select o.slot, count(*) as n_matched, round(sum(abs(o.w - i.w2)), 6) as abs_change from o join i on o.event_id = i.event_id and o.slot = i.slot group by o.slot""",
)
sql_query(
    "sparse_gate_cosine",
    f"""with {ROUTES}, o as (select user_id, official as slot, sum(w) as w from rt group by 1, 2), i as (select user_id, interim as slot, sum(w2) as w from rt group by 1, 2),
      j as (select coalesce(o.user_id, i.user_id) as user_id, coalesce(o.w, 0) as a, coalesce(i.w, 0) as b from o full outer join i on o.user_id = i.user_id and o.slot = i.slot)
      select user_id, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 9) as cosine, count(*) as n_slots from j group by user_id""",
)
sql_query(
    "selected_metric_lookup",
    f"""with {LEDGER}, m as (select layer, mode_a, mode_b, sum(cand) as sse, sum(base) as energy from led group by 1, 2, 3),
      best as (select layer, <<min_by(struct(mode_a, mode_b), struct(sse, mode_a, mode_b))||arg_min({{'mode_a': mode_a, 'mode_b': mode_b}}, (sse, mode_a, mode_b))>> as pick from m group by layer)
      select m.layer, m.mode_a, m.mode_b, round(m.sse, 3) as sse, round(m.energy, 3) as energy from m join best on m.layer = best.layer and m.mode_a = best.pick.mode_a and m.mode_b = best.pick.mode_b""",
)
sql_query(
    "merge_disjoint_slices",
    f"""with {LEDGER}, s as (select layer, expert, 'even' as slice, sum(cand) as v from led where layer % 2 = 0 group by 1, 2 union all select layer, expert, 'odd' as slice, sum(cand) as v from led where layer % 2 = 1 group by 1, 2 union all select layer, expert, 'again' as slice, sum(cand) as v from led where layer % 25 = 0 group by 1, 2)
      select layer, count(*) as n_rows, count(distinct expert) as n_keys, count(*) - count(distinct expert) as n_duplicates, count(distinct slice) as n_slices from s group by layer""",
)
sql_query(
    "candidate_map_merge",
    f"""with {LEDGER}, c as (select expert, mode_a, count(*) as support, count(distinct layer) as context from led group by 1, 2)
      select expert, count(*) as n_candidates, count(distinct support) = 1 as support_agrees, <<array_join(array_sort(collect_list(mode_a)), '+')||array_to_string(list_sort(list(mode_a)), '+')>> as candidates from c group by expert""",
)
sql_query("observation_membership", f"with {EVENTS} select e.event_type, count(*) as n, {count_if('l.k is not null')} as n_cached from ev e left join (select distinct k from ev where user_id % 10 = 0) l on e.k = l.k group by e.event_type")
sql_query(
    "overlay_precedence",
    f"""with {LEDGER}, o as (select expert, 0 as priority, max(base) as v from led group by 1 union all select expert, 1 as priority, max(cand) as v from led where mode_a = 'A' group by 1 union all select expert, 2 as priority, min(cand) as v from led where mode_a = 'R' group by 1)
      select expert, max(priority) as layer_used, round(<<max_by(v, priority)||arg_max(v, priority)>>, 6) as v from o group by expert""",
)
sql_query(
    "select_expert_rows",
    f"""with {EVENTS}, two as (select event_id, user_id, base, cand, k, (k + 1 + event_id % 3) % 100 as k2 from ev)
      select event_id, user_id, round((case when k = 42 then base else 0 end) + (case when k2 = 42 then cand else 0 end), 9) as gate from two where k = 42 or k2 = 42""",
)
sql_query("layer_projection", f"with {EVENTS} select event_id, <<element_at(array(k, (k * 3) % 100, (k * 7) % 100), 2)||list_extract([k, (k * 3) % 100, (k * 7) % 100], 2)>> as layer_route from ev")
sql_query("route_histogram", f"with {EVENTS}, s as (<<select id as k from range(128)||select range as k from range(128)>>), c as (select k, count(*) as n from ev group by k) select s.k, coalesce(c.n, 0) as n from s left join c on s.k = c.k")
sql_query(
    "total_variation",
    f"""with {ROUTES}, a as (select event_type, official as slot, cast(count(*) as double) as n from rt group by 1, 2), b as (select event_type, interim as slot, cast(count(*) as double) as n from rt group by 1, 2), t as (select event_type, cast(count(*) as double) as n from rt group by 1),
      j as (select coalesce(a.event_type, b.event_type) as event_type, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) as d from a full outer join b on a.event_type = b.event_type and a.slot = b.slot)
      select j.event_type, round(sum(d) / max(t.n) / 2, 9) as tv from j join t on j.event_type = t.event_type group by j.event_type""",
)
sql_query(
    "topk_overlap",
    f"""with {ROUTES}, s as (select user_id, event_type, <<collect_set(official)||list(distinct official)>> as a, <<collect_set(interim)||list(distinct interim)>> as b from rt group by 1, 2),
      o as (select event_type, cast(<<size(array_intersect(a, b))||len(list_intersect(a, b))>> as double) as n, cast(<<size(array_union(a, b))||len(list_distinct(list_concat(a, b)))>> as double) as u, <<size(a)||len(a)>> as k from s)
      select event_type, round(avg(n / k), 9) as overlap, round(avg(n / u), 9) as jaccard, {count_if("n = u")} as n_equal from o group by event_type""",
)
same_query("topk_overlap_whole", "topk_overlap")
sql_query("changed_routes", f"with {ROUTES} select event_type, {count_if('official <> interim')} as n_changed, count(*) as n, count(distinct case when official <> interim then user_id end) as n_rows_changed from rt group by event_type")
sql_query("route_support", f"with {ROUTES}, panel as (select distinct k as slot from ev where k % 9 = 4) select r.official as slot, count(*) as n_routes, count(distinct r.user_id) as n_clusters from rt r join panel p on r.official = p.slot group by 1")
sql_query(
    "byte_ledger",
    """select l_suppkey as layer, cast(sum(l_quantity * 3) as bigint) as bits, cast(ceil(sum(l_quantity * 3) / 8) as bigint) as n_bytes, cast(ceil(sum(l_quantity * 3) / 8 / 256) * 256 as bigint) as aligned, round(sum(l_quantity * 3) / count(*) / 16, 9) as bits_each from lineitem group by l_suppkey""",
)
sql_query(
    "runtime_mix",
    f"""with {EVENTS}, flag as (select distinct k from ev where k % 6 = 1), u as (select e.user_id % 4 as worker, e.event_type, e.event_id, max(case when f.k is not null then 1 else 0 end) as hit from ev e left join flag f on e.k = f.k group by 1, 2, 3),
      s as (select worker, event_type, sum(hit) as n from u group by 1, 2) select event_type, cast(max(n) as bigint) as slowest_worker, cast(sum(n) as bigint) as n from s group by event_type""",
)
sql_query(
    "merge_rank_stats",
    """with r as (select l_suppkey % 4 as rank_id, l_partkey as row_id, count(*) as v from lineitem group by 1, 2),
      x as (select rank_id, min(row_id) as first_row, max(row_id) + 1 as end_row, count(*) as n from r group by rank_id)
      select rank_id, first_row, end_row, n, coalesce(lag(end_row) over (order by rank_id) <= first_row, true) as disjoint_from_last from x""",
)
sql_query("rank_partial_sum", "with r as (select l_partkey as pos, l_suppkey % 4 as rank_id, sum(l_quantity) as v from lineitem group by 1, 2) select pos, cast(sum(v) as bigint) as total, max(v) = min(v) as replicated, count(*) as n_ranks from r group by pos")
sql_query(
    "expert_occurrence_index",
    f"""with {EVENTS}, c as (select user_id, k, count(*) as n from ev group by 1, 2), o as (select user_id, k, n, sum(n) over (partition by user_id order by k rows between unbounded preceding and current row) - n as first_at from c)
      select user_id, k, n, cast(first_at as bigint) as first_at from o""",
)
sql_query(
    "ladder_overlap",
    f"""with {LEDGER}, s as (select layer, expert, sum(cand) as c, sum(base) as b from led group by 1, 2),
      r as (select layer, expert, row_number() over (partition by layer order by b, expert) as kb, row_number() over (partition by layer order by c, expert) as kc, row_number() over (partition by layer order by b desc, expert) as tb, row_number() over (partition by layer order by c desc, expert) as tc from s)
      select layer, steps.r as r, round({count_if("kb <= steps.r and kc <= steps.r")} / cast(steps.r as double), 9) as donors, round({count_if("tb <= steps.r and tc <= steps.r")} / cast(steps.r as double), 9) as recipients
      from r cross join (select 1 as r union all select 2 as r union all select 3 as r union all select 5 as r) steps group by layer, steps.r""",
)
sql_query(
    "gaps_and_islands",
    """with m as (select user_id, event_id, event_type, case when lag(event_type) over (partition by user_id order by event_id) = event_type then 0 else 1 end as new from events),
      g as (select user_id, event_id, event_type, sum(new) over (partition by user_id order by event_id rows between unbounded preceding and current row) as island from m)
      select user_id, cast(island as bigint) as island, min(event_type) as event_type, count(*) as n from g group by user_id, island""",
)
sql_query(
    "argmin_tie_break",
    f"""with {LEDGER}, s as (select layer, mode_a, mode_b, round(sum(cand), 3) as sse, sum(base) as energy, cast(sum(weight) as bigint) as n_bytes from led group by 1, 2, 3),
      b as (select layer, mode_a, mode_b, sse, n_bytes, min(sse) over (partition by layer) + 1e-2 * max(energy) over (partition by layer) as bar from s)
      select layer, <<min_by(concat(mode_a, mode_b), struct(n_bytes, mode_a, mode_b))||arg_min(concat(mode_a, mode_b), (n_bytes, mode_a, mode_b))>> as choice, count(*) as n_ties from b where sse <= bar group by layer""",
)
sql_query("family_argmin", f"with {LEDGER}, s as (select layer % 10 as family, mode_a, round(sum(cand), 2) as sse from led group by 1, 2) select family, <<min_by(mode_a, struct(sse, mode_a))||arg_min(mode_a, (sse, mode_a))>> as mode_a, round(min(sse), 2) as sse from s group by family")
sql_query(
    "policy_sweep",
    f"""with {LEDGER}, s as (select layer, expert % 2 = 0 as fit, mode_a, sum(cand) / sum(base) as ratio from led group by 1, 2, 3),
      c as (select layer, <<min_by(mode_a, struct(ratio, mode_a))||arg_min(mode_a, (ratio, mode_a))>> as mode_a from s where fit group by layer)
      select c.layer, c.mode_a, round(s.ratio, 9) as confirmed_ratio from c join s on s.layer = c.layer and s.mode_a = c.mode_a and not s.fit""",
)
sql_query(
    "hotspot_coverage",
    f"""with {LEDGER}, s as (select layer, round(sum(cand), 2) as heat, cast(floor((layer - 1) / 25.0) as bigint) as quarter from led group by layer),
      r as (select layer, heat, quarter, row_number() over (partition by quarter order by heat desc, layer) as k from s), q as (select layer, heat, 'quarter' as why from r where k = 1),
      g as (select layer, heat, 'global' as why from r where k > 1 order by heat desc, layer limit 8) select layer, heat, why from q union all select layer, heat, why from g""",
)
sql_query(
    "biased_topk",
    f"""with {EVENTS}, s as (select user_id, k, 1 / (1 + exp(-(avg(base) - 50) / 20)) as score from ev group by 1, 2), r as (select user_id, k, score, row_number() over (partition by user_id order by score + (k % 10) / cast(100 as double) desc, k) as place from s)
      select user_id, k, cast(place as bigint) as place, round(score / sum(score) over (partition by user_id), 9) as weight from r where place <= 4""",
)
sql_query(
    "topk_margin",
    f"""with {EVENTS}, s as (select user_id, k, avg(base) as score from ev group by 1, 2), r as (select user_id, score, row_number() over (partition by user_id order by score desc, k) as place from s)
      select user_id, round(max(case when place = 4 then score end) - max(case when place = 5 then score end), 9) as margin from r where place in (4, 5) group by user_id""",
)
sql_query("global_topk", f"with {LEDGER}, s as (select layer, expert, round(sum(base - cand), 4) as damage from led group by 1, 2) select layer, expert, damage from s order by damage desc, layer, expert limit 100")
sql_query("prefix_frontier", f"with {LEDGER}, s as (select layer, expert, cast(round(sum(base - cand) * 10000) as bigint) as gain, cast(sum(weight) as bigint) as cost from led group by 1, 2) select layer, expert, cast(sum(cost) over w as bigint) as cost, cast(sum(gain) over w as bigint) as gain_e4 from s window w as (partition by layer order by gain desc, expert rows between unbounded preceding and current row)")
sql_query(
    "selection_convergence",
    f"""with {LEDGER}, s as (select layer, mode_a, step, round(sum(cand), 3) as sse from led join (select 10 as step union all select 25 as step union all select 51 as step) p on weight <= p.step group by 1, 2, 3),
      w as (select layer, step, <<min_by(mode_a, struct(sse, mode_a))||arg_min(mode_a, (sse, mode_a))>> as winner from s group by 1, 2), f as (select layer, winner from w where step = 51)
      select w.layer, w.step, w.winner, w.winner = f.winner as matches from w join f on w.layer = f.layer""",
)
sql_query(
    "identity_compare",
    f"""select source, case when count(distinct {sha("text")}) = 1 then 'identical' else 'different' end as status, count(*) as n from documents group by source""",
)
same_query("identity_compare_whole", "identity_compare")
sql_query("contract_identity", f"with {LEDGER}, t as (select layer, count(distinct mode_a) as n_modes, max(mode_a) as top from led group by layer) select count(distinct n_modes) = 1 as same_contract, min(n_modes) as least, max(n_modes) as most, count(*) as n from t")
sql_query(
    "modal_adjacent_pair",
    """with h as (select l_suppkey as row_id, cast(l_quantity as bigint) as v, count(*) as n from lineitem group by 1, 2), p as (select a.row_id, a.v, a.n + coalesce(b.n, 0) as n from h a left join h b on a.row_id = b.row_id and b.v = a.v + 1), t as (select row_id, sum(n) as n from h group by row_id),
      m as (select row_id, <<min_by(v, struct(-n, v))||arg_min(v, (-n, v))>> as base_value, max(n) as n_pair from p group by row_id)
      select m.row_id, m.base_value, m.n_pair, cast(t.n - m.n_pair as bigint) as n_exceptions from m join t on m.row_id = t.row_id""",
)
sql_query(
    "panel_preference",
    f"""with {EVENTS}, t as (select user_id, event_type, sum(base) as b, sum(cand) as c from ev group by 1, 2)
      select user_id, round(sum(power(c - b, 2)), 6) as sse, case when sum(c) < sum(b) then 'candidate' when sum(c) > sum(b) then 'baseline' else 'tie' end as preference from t group by user_id""",
)
sql_query("enumerate_arms", "with e as (select distinct l_partkey % 40 as expert from lineitem) select concat('only-', cast(expert as varchar(10))) as arm, expert from e union all select 'panel' as arm, expert from e where expert < 8")
sql_query("byte_budget_gate", f"with {LEDGER}, b as (select layer, cast(sum(weight) * 16 + 64 as bigint) as n_bytes, cast(sum(case when mode_a = 'N' then weight * 12 else weight * 17 end) + 64 as bigint) as candidate_bytes from led group by layer) select layer, n_bytes, candidate_bytes, candidate_bytes < n_bytes as accepted from b")
