"""Ranks, running sums and quantiles within a few large groups, by ranges instead of one task a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.operators.ranks import placed, quantiles
from sedge.plans.dialect import EVENTS, LEDGER, frame_query, quantile, run_sql, sha, table


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", *more)


@frame_query(
    "extent_receipts",
    """with ext as (select source, doc_id, n_chars, cast(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and current row) as bigint) as ends from documents)
       select source, count(*) as n_extents, cast(max(ends) as bigint) as total, min(ends - n_chars) as first_start from ext group by source""",
)
def extent_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(_documents(spark, sf_dir), ["source"], ["doc_id"], "n_chars")
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("n_extents"), F.max(F.col("before") + F.col("n_chars")).alias("total"), F.min("before").alias("first_start"))


@frame_query(
    "source_length_profile",
    """with r as (select source, n_chars, row_number() over (partition by source order by n_chars, doc_id) - 1 as k, count(*) over (partition by source) as n from documents)
       select source, max(n) as n_documents, cast(sum(n_chars) as bigint) as n_tokens,
              max(case when k = floor(0.5 * (n - 1)) then n_chars end) as p50, max(case when k = floor(0.9 * (n - 1)) then n_chars end) as p90, max(n_chars) as longest
       from r group by source""",
)
def source_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(_documents(spark, sf_dir), ["source"], ["n_chars", "doc_id"])
    at = lambda q: F.max(F.when(F.col("place") - 1 == F.floor(F.expr(f"{q} * (n - 1)")), F.col("n_chars")))
    return p.groupBy("source").agg(F.max("n").alias("n_documents"), F.sum("n_chars").alias("n_tokens"), at("0.5").alias("p50"), at("0.9").alias("p90"), F.max("n_chars").alias("longest"))


@frame_query(
    "prefix_document_count",
    """with r as (select source, doc_id, row_number() over w as k, sum(n_chars) over w as total from documents window w as (partition by source order by doc_id rows between unbounded preceding and current row))
       select source, cast(min(k) as bigint) as n_documents from r where total >= 20000 group by source""",
)
def prefix_document_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(_documents(spark, sf_dir), ["source"], ["doc_id"], "n_chars")
    return p.filter(F.col("before") + F.col("n_chars") >= 20000).groupBy("source").agg(F.min("place").alias("n_documents"))


@frame_query(
    "token_budget_take",
    f"""with u as (select doc_id, source, least(n_chars, 2048) as capped, row_number() over (partition by {sha("text")} order by doc_id) as k from documents),
             c as (select doc_id, source, capped, coalesce(sum(capped) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from u where k = 1)
        select doc_id, source, cast(least(capped, 30000 - before) as bigint) as tokens from c where before < 30000""",
)
def token_budget_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts once each in order of doc_id until a source's budget is full; the last is cut."""
    d = _documents(spark, sf_dir, F.sha2("text", 256).alias("h")).withColumn("capped", F.least("n_chars", F.lit(2048)))
    once = d.groupBy("h").agg(F.min(F.struct("doc_id", "source", "capped")).alias("x")).select("x.*")
    p = placed(once, ["source"], ["doc_id"], "capped").filter("before < 30000")
    return p.select("doc_id", "source", F.least(F.col("capped"), 30000 - F.col("before")).alias("tokens"))


@frame_query(
    "document_windows",
    """with r as (select doc_id, source, n_chars, row_number() over (partition by source order by doc_id) as consumed from documents),
            e as (select doc_id, source, consumed, row_number() over (partition by source order by doc_id) as k from r where n_chars >= 512)
       select source, doc_id, cast(k - 1 as bigint) as window_index, cast(consumed as bigint) as n_consumed from e where k <= 5""",
)
def document_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).withColumn("long", (F.col("n_chars") >= 512).cast("long"))
    p = placed(d, ["source"], ["doc_id"], "long").filter("long = 1 and before < 5")
    return p.select("source", "doc_id", F.col("before").alias("window_index"), F.col("place").alias("n_consumed"))


_SHUFFLED = sha("concat('11:', cast(doc_id as varchar(20)))")


@frame_query("seeded_shuffle", f"select doc_id, source, cast(row_number() over (partition by source order by {_SHUFFLED}, doc_id) as bigint) as place from documents")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", "source", F.sha2(F.concat(F.lit("11:"), F.col("doc_id").cast("string")), 256).alias("h"))
    return placed(d, ["source"], ["h", "doc_id"]).select("doc_id", "source", "place")


@frame_query("length_quantiles", f"select lang, round({quantile('n_chars', 0.5)}, 6) as p50, round({quantile('n_chars', 0.99)}, 6) as p99 from documents group by lang")
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantiles(table(spark, sf_dir, "documents"), ["lang"], "n_chars", {"p50": 0.5, "p99": 0.99})
    return q.select("lang", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


_SHARES = {f"p{int(q * 100):02d}": q for q in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"with {EVENTS} select event_id, event_type, base, cand from ev")


@frame_query("quantile_vector", f"with {EVENTS} select event_type, {', '.join(f'round({quantile("base", q)}, 9) as {k}' for k, q in _SHARES.items())} from ev group by event_type")
def quantile_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantiles(_events(spark, sf_dir), ["event_type"], "base", _SHARES)
    return q.select("event_type", *[F.round(k, 9).alias(k) for k in _SHARES])


def tail(rows: DataFrame, keys: list[str], value: str, order: list[str], *beside: F.Column) -> DataFrame:
    """Row per group: cvar1 (mean of the largest hundredth, rounded up), worst, and what is asked for beside."""
    p = placed(rows, keys, [F.col(value).desc(), *order])
    largest = F.when(F.col("place") <= F.ceil(F.expr("0.01 * n")), F.col(value))
    return p.groupBy(*keys).agg(F.avg(largest).alias("cvar1"), F.max(value).alias("worst"), *beside)


@frame_query(
    "tail_metrics",
    f"""with {EVENTS}, r as (select event_type, cand, row_number() over (partition by event_type order by cand desc, event_id) as k, count(*) over (partition by event_type) as n from ev)
      select event_type, round({quantile("cand", 0.99)}, 9) as p99, round(avg(case when k <= ceil(0.01 * n) then cand end), 9) as cvar1, round(max(cand), 9) as worst from r group by event_type""",
)
def tail_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    t = tail(ev, ["event_type"], "cand", ["event_id"]).join(quantiles(ev, ["event_type"], "cand", {"p99": 0.99}), "event_type")
    return t.select("event_type", *[F.round(c, 9).alias(c) for c in ("p99", "cvar1", "worst")])


@frame_query(
    "tail_error_stats",
    f"""with {LEDGER}, e as (select layer, expert, l_orderkey, l_linenumber, power(cand - base, 2) as err, power(base, 2) as energy from led),
      r as (select layer, err, energy, row_number() over (partition by layer order by err, l_orderkey, l_linenumber, expert) as k, count(*) over (partition by layer) as n from e)
      select layer, round(sum(err) / sum(energy), 9) as relative_sse, round(max(case when k = ceil(0.99 * n) then err end), 4) as p99,
             round(avg(case when k > n - ceil(0.01 * n) then err end), 4) as cvar1, round(max(err), 4) as worst from r group by layer""",
)
def tail_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = run_sql(spark, sf_dir, f"with {LEDGER} select layer, power(cand - base, 2) as err, power(base, 2) as energy from led")
    # from the largest down, the place of the k-th smallest of n is n - k + 1
    p99 = F.max(F.when(F.col("place") == F.col("n") - F.ceil(F.expr("0.99 * n")) + 1, F.col("err")))
    t = tail(e, ["layer"], "err", ["energy"], (F.sum("err") / F.sum("energy")).alias("relative_sse"), p99.alias("p99"))
    return t.select("layer", F.round("relative_sse", 9).alias("relative_sse"), *[F.round(c, 4).alias(c) for c in ("p99", "cvar1", "worst")])


@frame_query(
    "spearman_corr",
    f"""with {EVENTS}, r as (select event_type, rank() over (partition by event_type order by base) + (count(*) over (partition by event_type, base) - 1) / cast(2 as double) - 1 as rb,
                  rank() over (partition by event_type order by cand) + (count(*) over (partition by event_type, cand) - 1) / cast(2 as double) - 1 as rc from ev)
      select event_type, round(corr(rb, rc), 8) as spearman from r group by event_type""",
)
def spearman_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of average ranks: equal values share the mean of their places."""
    ev = _events(spark, sf_dir)
    for value in ("base", "cand"):
        p = placed(ev.select("event_type", value), ["event_type"], [value])
        mean = p.groupBy("event_type", value).agg((F.avg("place") - 1).alias(f"rank_{value}"))
        ev = ev.join(mean, ["event_type", value])
    return ev.groupBy("event_type").agg(F.round(F.corr("rank_base", "rank_cand"), 8).alias("spearman"))


@frame_query("equal_population_buckets", f"with {EVENTS}, r as (select event_id, event_type, row_number() over (partition by event_type order by base, event_id) - 1 as k, count(*) over (partition by event_type) as n from ev) select event_id, cast(floor(k * 7 / cast(n as double)) as bigint) as bucket from r")
def equal_population_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(_events(spark, sf_dir), ["event_type"], ["base", "event_id"])
    return p.select("event_id", F.floor((F.col("place") - 1) * 7 / F.col("n").cast("double")).alias("bucket"))


_QUOTAS = """with w as (select source, count(*) as n from documents group by source),
            q as (select source, n, 100.0 * n / sum(n) over () as share from w),
            f as (select source, floor(share) as base, share - floor(share) as frac from q),
            r as (select source, base, row_number() over (order by frac desc, source) as k, 100 - sum(base) over () as left_over from f)
       select source, cast(base as bigint) + case when k <= left_over then 1 else 0 end as quota from r"""


@frame_query("stratified_sample", f"with quota as ({_QUOTAS}), d as (select doc_id, source, row_number() over (partition by source order by doc_id) as k from documents) select d.source, d.doc_id from d join quota on d.source = quota.source where d.k <= quota.quota")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents of each source, as many as its share of a hundred by largest remainders."""
    p = placed(_documents(spark, sf_dir), ["source"], ["doc_id"])
    return p.join(run_sql(spark, sf_dir, _QUOTAS), "source").filter("place <= quota").select("source", "doc_id")


@frame_query(
    "range_join_extents",
    """with x as (select source, doc_id, n_chars, sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and current row) as ends from documents),
      p as (select source, total, part, cast(floor(total * part / 8.0) as bigint) as pos from (select source, max(ends) as total from x group by source) t cross join (select <<id as part from range(8)||range as part from range(8)>>) r)
      select p.source, p.part, x.doc_id, cast(p.pos - (x.ends - x.n_chars) as bigint) as inside from p join x on p.source = x.source and p.pos >= x.ends - x.n_chars and p.pos < x.ends""",
)
def range_join_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that holds each eighth of a source's characters: eight positions a source meet its extents."""
    x = placed(_documents(spark, sf_dir), ["source"], ["doc_id"], "n_chars").withColumn("ends", F.col("before") + F.col("n_chars")).select("source", "doc_id", "before", "ends")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))
    p = x.groupBy("source").agg(F.max("ends").alias("total")).select("source", "total", part.alias("part")).withColumn("pos", F.floor(F.col("total") * F.col("part") / 8.0))
    return p.join(x, "source").filter("pos >= before and pos < ends").select("source", "part", "doc_id", (F.col("pos") - F.col("before")).alias("inside"))
