"""Corpus assembly: scans, predicates, folds, deduplication, budgets and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedge.plans.dialect import count_if, frame_query, md5_int, run_sql, same_query, sha, sha_byte, sql_query, strip

sql_query(
    "scan_documents",
    f"""select source, count(*) as n_records, {count_if("text is null or length(text) = 0")} as n_blank,
               min(doc_id) as first_line, max(doc_id) as last_line, cast(sum(length(text)) as bigint) as n_chars
        from documents group by source""",
)

# hash order replaces a buffered shuffle: the same rows whatever the partitioning
sql_query(
    "assemble_text_shard",
    f"""select doc_id, source, lang, {sha("text")} as text_hash from documents
        where n_chars >= 500 order by {sha("concat('17:', cast(doc_id as varchar(20)))")}, doc_id limit 200""",
)

sql_query(
    "fetch_selected_rows",
    """with wanted as (select doc_id, source from documents where doc_id % 37 = 0
                       union all select -1 as doc_id, 'nowhere' as source)
       select w.doc_id, w.source, d.doc_id is null as missing, cast(length(d.text) as bigint) as n_chars
       from wanted w left join documents d on w.doc_id = d.doc_id and w.source = d.source""",
)

sql_query(
    "flatten_conversations",
    """select conv_id, count(*) as n_turns,
              <<array_join(transform(array_sort(collect_list(struct(turn, role, text))), x -> concat(x.role, ':', x.text)), '|')||string_agg(role || ':' || text, '|' order by turn, role, text)>> as flat
       from conversations where role is not null and text is not null group by conv_id""",
)

sql_query(
    "shard_by_source",
    """select coalesce(<<regexp_replace(source, '[^A-Za-z0-9_.-]+', '_')||regexp_replace(source, '[^A-Za-z0-9_.-]+', '_', 'g')>>, '<unselected>') as shard,
              count(*) as n_rows, cast(sum(<<octet_length(text)||strlen(text)>>) as bigint) as n_bytes
       from documents group by 1""",
)

sql_query(
    "validate_report",
    f"""with plan as (select source, count(*) as n_documents, cast(sum(n_chars) as bigint) as n_tokens, count(distinct {sha("text")}) as n_hashes from documents group by source)
        select source, n_documents, n_tokens, n_documents = n_hashes as hashes_unique, n_tokens > 0 as complete,
               {sha("concat(source, ':', cast(n_documents as varchar(20)), ':', cast(n_tokens as varchar(20)))")} as plan_hash
        from plan""",
)

sql_query(
    "rank_coverage",
    """with ranks as (select distinct cast(l_suppkey % 12 as bigint) as rank_id from lineitem),
            world as (<<select id as rank_id from range(13)||select range as rank_id from range(13)>>)
       select w.rank_id, r.rank_id is null as missing from world w left join ranks r on w.rank_id = r.rank_id""",
)

sql_query(
    "chunk_contiguity",
    """with chunk as (select source, cast(floor(doc_id / 100.0) as bigint) as chunk, min(doc_id) as row_start, max(doc_id) + 1 as row_end, count(*) as n from documents group by 1, 2),
            seq as (select source, chunk, row_start, row_end, n, lag(row_end) over (partition by source order by chunk) as prev_end from chunk)
       select source, chunk, row_start, row_end, n, coalesce(prev_end <= row_start, true) as in_order, coalesce(row_start - prev_end, 0) as gap from seq""",
)

sql_query("field_projection", "select event_id, value from events where event_type is not null")

sql_query(
    "stats_bundle",
    f"""select lang, count(*) as n, cast(sum(n_chars) as bigint) as chars, {sha("concat(lang, ':', cast(count(*) as varchar(20)), ':', cast(sum(n_chars) as varchar(30)))")} as manifest_hash
        from documents group by lang""",
)

sql_query(
    "artifact_index",
    f"""select page_id, case when url like '%.json%' then 'manifest' when url like '%/docs/%' then 'document' when url like 'https:%' then 'secure' when url like 'http:%' then 'plain' else 'other' end as category,
               {sha("html")} as content_sha256, cast(<<octet_length(html)||strlen(html)>> as bigint) as n_bytes, html is null as unreadable from pages""",
)

sql_query(
    "filter_minimum",
    """select doc_id, source, n_chars from documents
       where <<try_cast(n_chars as double)||try_cast(n_chars as double)>> >= 1000 and lang = 'en'""",
)

sql_query(
    "project_output_record",
    f"""with t as (select doc_id, source, lang, substr({strip("text")}, 1, 400) as text from documents)
        select doc_id, source, lang, cast(length(text) as bigint) as n_chars, {sha("text")} as text_hash from t where length(text) >= 100""",
)

sql_query(
    "fold_include_exclude",
    f"""select source, {md5_int("text")} % 4 as fold, count(*) as n, {count_if(md5_int("text") + " % 4 = 1")} as included from documents group by 1, 2""",
)

sql_query(
    "fit_confirmation_split",
    f"""with s as (select user_id, {md5_int("concat('split:', cast(user_id as varchar(20)))")} % 3 = 0 as confirmation, value from events)
        select confirmation, count(distinct user_id) as n_clusters, count(*) as n_rows, round(sum(value), 4) as total from s group by confirmation""",
)

sql_query(
    "parity_split",
    f"""with s as (select doc_id, {sha_byte("concat('salt:', cast(doc_id as varchar(20)))")} % 2 as side from documents)
        select side, count(*) as n, cast(sum(doc_id) as bigint) as id_sum from s group by side""",
)

sql_query(
    "hash_sample_md5",
    f"""select event_id, case when {md5_int("concat('v', cast(event_id as varchar(20)))")} % 2 = 0 then 'fit' else 'validation' end as split
        from events where {md5_int("cast(event_id as varchar(20))")} % 16 = 0""",
)

sql_query(
    "semi_filter_requests",
    """with subset as (select distinct user_id from events where user_id % 7 = 3)
       select e.event_type, count(*) as n, count(distinct e.user_id) as n_clusters from events e where e.user_id in (select user_id from subset) group by e.event_type""",
)

sql_query(
    "log_evidence_audit",
    """with rules as (select 'required' as kind, 'the' as pattern union all select 'required' as kind, 'and' as pattern union all select 'forbidden' as kind, 'password' as pattern union all select 'forbidden' as kind, 'token' as pattern),
            hits as (select r.kind, r.pattern, d.source, cast((length(d.text) - length(replace(d.text, r.pattern, ''))) / length(r.pattern) as bigint) as n from documents d cross join rules r)
       select kind, pattern, source, cast(sum(n) as bigint) as n_found, (kind = 'required' and sum(n) > 0) or (kind = 'forbidden' and sum(n) = 0) as passed from hits group by kind, pattern, source""",
)

sql_query(
    "validate_digests",
    f"""with d as (select doc_id, case when doc_id % 50 = 7 then 'XYZ' else md5(text) end as digest, n_chars from documents),
             v as (select case when not <<digest rlike '^[0-9a-f]{{32}}$'||regexp_matches(digest, '^[0-9a-f]{{32}}$')>> then 'bad_digest' when n_chars <= 0 then 'empty' else 'ok' end as issue from d)
        select issue, count(*) as n from v group by issue""",
)

#: Least hashes of a layer's experts, of the even and of the odd ones: within the larger of them lie two experts at least.
_PANEL = f"""with x as (select l_suppkey as layer, l_partkey as expert, {sha("concat('7:', coalesce(cast(l_suppkey as varchar(20)), ''), ':', coalesce(cast(l_partkey as varchar(20)), ''))")} as h from lineitem),
             y as (select layer, expert, h, cast(conv(substr(h, 1, 15), 16, 10) as bigint) as first, substr(h, 64) in ('0', '2', '4', '6', '8', 'a', 'c', 'e') as even from x),
             bar as (select layer, greatest(coalesce(min(case when even then first end), {1 << 60}), coalesce(min(case when not even then first end), {1 << 60})) as most from y group by layer),
             p as (select /*+ shuffle_hash(bar) */ distinct y.layer, expert, h from y join bar on y.layer <=> bar.layer and first <= most),
             r as (select layer, expert, row_number() over (partition by layer order by h, expert) as k from p)
        select layer, expert, cast(k as bigint) as place from r where k <= 2"""


@frame_query(
    "hash_order_panel",
    f"""with p as (select distinct l_suppkey as layer, l_partkey as expert from lineitem),
             r as (select layer, expert, row_number() over (partition by layer order by {sha("concat('7:', cast(layer as varchar(20)), ':', cast(expert as varchar(20)))")}, expert) as k from p)
        select layer, expert, cast(k as bigint) as place from r where k <= 2""",
)
def hash_order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two experts of a layer by hash; rows that can't be among them are let go before the distinct and the sort."""
    return run_sql(spark, sf_dir, _PANEL)


sql_query(
    "dedup_first",
    f"""with r as (select doc_id, source, {sha("text")} as h, row_number() over (partition by {sha("text")} order by doc_id) as k from documents)
        select doc_id, source, h from r where k = 1""",
)

sql_query(
    "exclude_prior",
    f"""with prior as (select distinct {sha("text")} as h from benchmark), d as (select source, {sha("text")} as h from documents)
        select d.source, count(*) as n_kept from d where not exists (select 1 from prior where prior.h = d.h) group by d.source""",
)

sql_query(
    "pairwise_overlap",
    f"""with h as (select distinct source, {sha("text")} as h from documents),
             s as (select distinct source from h),
             pairs as (select a.source as left_source, b.source as right_source from s a join s b on a.source < b.source),
             same as (select a.source as left_source, b.source as right_source, count(*) as n from h a join h b on a.h = b.h and a.source < b.source group by 1, 2)
        select p.left_source, p.right_source, coalesce(n, 0) as n_shared from pairs p left join same s on p.left_source = s.left_source and p.right_source = s.right_source""",
)
same_query("pairwise_overlap_whole", "pairwise_overlap")

sql_query(
    "source_contract",
    f"""with contract as (select 'src0' as source, 3000 as cap union all select 'src1' as source, 2000 as cap union all select 'src2' as source, 1000 as cap)
        select d.source, count(*) as n, {count_if("c.source is null")} as n_unknown, {count_if("d.n_chars > c.cap")} as n_over_cap
        from documents d left join contract c on d.source = c.source group by d.source""",
)

sql_query(
    "group_by_marker",
    """with m as (select conv_id, turn, role, text, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) as section from conversations)
       select conv_id, cast(section as bigint) as section, count(*) as n_rows, cast(sum(length(text)) as bigint) as n_chars from m where section > 0 group by 1, 2""",
)

sql_query(
    "tiered_selection",
    f"""with top as (select doc_id, lang, n_chars from documents order by n_chars desc, {sha("text")}, doc_id limit 32),
             rest as (select d.doc_id, d.lang, d.n_chars, row_number() over (partition by d.lang order by d.n_chars desc, d.doc_id) as k from documents d where not exists (select 1 from top where top.doc_id = d.doc_id))
        select doc_id, lang, n_chars, 'confirmation' as tier, cast(row_number() over (partition by lang order by n_chars desc, doc_id) - 1 as bigint) as place from top
        union all select doc_id, lang, n_chars, 'auxiliary' as tier, cast(k - 1 as bigint) as place from rest where k <= 2""",
)

# no source gives more than all turns there are
sql_query(
    "round_robin_strata",
    f"""with n as (select source, count(*) as n from documents group by source), p as (select source, doc_id, row_number() over (partition by source order by {sha("cast(doc_id as varchar(20))")}, doc_id) as k from documents),
             q as (select source, doc_id, k from p where k <= 60)
        select q.doc_id, q.source, cast(q.k as bigint) as turn from q join n on q.source = n.source order by q.k, n.n desc, q.source limit 60""",
)

_A, _B = (f"select distinct {sha('text')} as h from documents where doc_id % 2 = {k}" for k in (0, 1))
sql_query("set_intersect", f"select h from ({_A}) a intersect select h from ({_B}) b")
sql_query("set_except", f"select h from ({_A}) a except select h from ({_B}) b")
sql_query(
    "keep_set_jaccard",
    f"""with a as (select l_suppkey as layer, l_partkey as expert from lineitem where l_quantity > 25 group by 1, 2),
             b as (select l_suppkey as layer, l_partkey as expert from lineitem where l_discount > 0.05 group by 1, 2),
             u as (select coalesce(a.layer, b.layer) as layer, a.expert is not null as in_a, b.expert is not null as in_b from a full outer join b on a.layer = b.layer and a.expert = b.expert)
        select layer, {count_if("in_a and in_b")} as n_both, count(*) as n_any, {count_if("in_a <> in_b")} as churn, round({count_if("in_a and in_b")} / cast(count(*) as double), 9) as jaccard from u group by layer""",
)
sql_query(
    "split_disjointness",
    """with s as (select distinct case when doc_id % 10 < 6 then 'train' when doc_id % 10 < 8 then 'tune' else 'test' end as split, md5(text) as h from documents)
       select a.split as left_split, b.split as right_split, count(*) as n_shared from s a join s b on a.h = b.h and a.split < b.split group by 1, 2""",
)
sql_query(
    "token_hash",
    f"""with t as (select doc_id, <<regexp_replace(text, '\\\\s+', ' ')||regexp_replace(text, '\\s+', ' ', 'g')>> as flat from documents)
        select doc_id, {sha("flat")} as tokens_sha256, cast(length(flat) - length(replace(flat, ' ', '')) + 1 as bigint) as n_tokens from t""",
)
sql_query("canonical_manifest_hash", f"""select source, {sha("concat('{\"n\":', cast(count(*) as varchar(20)), ',\"source\":\"', source, '\"}')")} as manifest_sha256 from documents group by source""")
sql_query(
    "inventory_bytes",
    """select case when n_chars < 500 then 'small' when n_chars < 5000 then 'medium' else 'large' end as class, lang, count(*) as n, cast(sum(<<octet_length(text)||strlen(text)>>) as bigint) as n_bytes from documents group by 1, 2""",
)
# a shard's names in pages of so many numbers, so that no list grows with the table
sql_query(
    "group_by_shard",
    """select source as shard, cast(floor(doc_id / 1000.0) as bigint) as page, count(*) as n, <<array_join(array_sort(collect_list(doc_id)), ',')||array_to_string(list_sort(list(doc_id)), ',')>> as members from documents group by 1, 2""",
)
