"""Vectors as long tables or arrays: Gram matrices, shrinkage, distances, activations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.operators import moments, neighbours
from sedge.plans.dialect import EVENTS, frame_query, same_query, sql_query, table
from sedge.shipping import ship

sql_query(
    "vector_metrics",
    """select a.vec_id, round(<<aggregate(zip_with(a.embedding, b.embedding, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, v) -> s + v)||list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: cast(p[1] as double) * cast(p[2] as double)))>>, 5) as dot,
              round(sqrt(<<aggregate(zip_with(a.embedding, b.embedding, (x, y) -> pow(cast(x as double) - cast(y as double), 2)), cast(0 as double), (s, v) -> s + v)||list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(cast(p[1] as double) - cast(p[2] as double), 2)))>>), 5) as distance
       from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
)
sql_query(
    "rms_norm_rows",
    """select vec_id, round(sqrt(<<aggregate(embedding, cast(0 as double), (s, v) -> s + cast(v as double) * cast(v as double))||list_sum(list_transform(embedding, lambda v: cast(v as double) * cast(v as double)))>> / <<size(embedding)||len(embedding)>> + 1e-6), 7) as rms from embeddings""",
)
sql_query("situ_activation", f"with {EVENTS} select event_id, round((base - 50) / 10 / (1 + exp(-(base - 50) / 10)), 9) as silu, round(1 / (1 + exp(-(cand - 50) / 10)), 9) as gate from ev")
_LOG = "ls as (select user_id, k, sum(base) / 50 as a, sum(cand) / 50 as b from ev group by 1, 2), mx as (select user_id, max(a) as ma, max(b) as mb from ls group by user_id), lz as (select ls.user_id, ma + ln(sum(exp(a - ma))) as za, mb + ln(sum(exp(b - mb))) as zb from ls join mx on ls.user_id = mx.user_id group by ls.user_id, ma, mb)"
sql_query("kl_divergence", f"with {EVENTS}, {_LOG} select ls.user_id, round(sum(exp(a - za) * ((a - za) - (b - zb))), 7) as kl, round(sum(exp(a - za)), 7) as mass from ls join lz on ls.user_id = lz.user_id group by ls.user_id")
sql_query("masked_kl", f"with {EVENTS.replace('from events)', 'from events where event_id % 4 <> 0)')}, {_LOG} select ls.user_id, round(sum(exp(a - za) * ((a - za) - (b - zb))), 7) as kl, count(*) as n_shown from ls join lz on ls.user_id = lz.user_id group by ls.user_id")
sql_query("nibble_unpack", f"with {EVENTS} select event_id, k & 15 as low, <<shiftright(k, 4)||k >> 4>> & 15 as high, (k & 15) + 16 * (<<shiftright(k, 4)||k >> 4>> & 15) = k as round_trip from ev".replace("<<shiftright(k, 4)||k >> 4>>", "<<shiftright(k, 4)||(k // 16)>>"))
#: Magnitudes of the eight codes of a four-bit float with two bits of exponent and one of mantissa: fixed values.
_E2M1 = (0, 0.5, 1, 1.5, 2, 3, 4, 6)
_E2M1_SQL = "case k & 7 " + " ".join(f"when {i} then cast({v} as double)" for i, v in enumerate(_E2M1)) + " end * case when k & 8 = 8 then -1 else 1 end"
sql_query("e2m1_decode", f"with {EVENTS}, d as (select k & 15 as code, {_E2M1_SQL.replace('k & 8 = 8', '(k & 8) = 8').replace('case k & 7', 'case (k & 7)')} as x from ev) select code, x + 0.0 as x, count(*) as n from d group by code, x + 0.0")
#: Three-bit symbols of a user's first eight slots, packed low end first and taken apart again.
_PLACE = "case i " + " ".join(f"when {i + 1} then {8**i}" for i in range(8)) + " end"
sql_query(
    "packed_symbols",
    f"""with {EVENTS}, s as (select user_id, k % 8 as v, row_number() over (partition by user_id order by event_id) as i from ev), p as (select user_id, cast(sum(v * {_PLACE}) as bigint) as word, count(*) as n from s where i <= 8 group by user_id)
      select p.user_id, p.word, p.n, min(case when cast(floor(p.word / cast({_PLACE} as double)) as bigint) % 8 = s.v then 1 else 0 end) = 1 as round_trip
      from p join s on p.user_id = s.user_id where s.i <= 8 group by p.user_id, p.word, p.n""",
)
# signs of a Hadamard matrix come from the parity of shared bits
sql_query(
    "hadamard_blocks",
    """with e as (<<select vec_id, posexplode(embedding) as (i, v) from embeddings||select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings>>),
      f as (select vec_id, cast(floor(i / 8.0) as bigint) as block, i % 8 as i, cast(v as double) as v from e), r as (<<select vec_id, block, i, v, explode(sequence(0, 7)) as j from f||select vec_id, block, i, v, unnest(range(8)) as j from f>>),
      t as (select vec_id, block, j, sum(case when bit_count(i & j) % 2 = 0 then v else -v end) / sqrt(cast(8 as double)) as y from r group by vec_id, block, j)
      select vec_id, block, round(sum(y * y), 5) as energy, round(sum(case when j = 0 then y else 0 end), 5) + 0.0 as dc from t group by vec_id, block""",
)
sql_query("iso_times", "select event_id, <<date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")||strftime(ts, '%Y-%m-%dT%H:%M:%S')>> as iso, <<cast(to_timestamp_ntz(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), \"yyyy-MM-dd'T'HH:mm:ss\") = date_trunc('second', ts) as boolean)||strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') = date_trunc('second', ts)>> as round_trip from events")
sql_query("permutation_inverse", "with p as (select vec_id, label, row_number() over (partition by label order by cast(<<element_at(embedding, 1)||list_extract(embedding, 1)>> as double), vec_id) - 1 as place, row_number() over (partition by label order by vec_id) - 1 as idx from embeddings) select label, cast(place as bigint) as source, cast(idx as bigint) as target from p")
@frame_query(
    "knn_topk",
    """with q as (select vec_id, label, embedding from embeddings where vec_id % 20 = 0), d as (select q.vec_id as query_id, e.vec_id, round(<<aggregate(zip_with(q.embedding, e.embedding, (x, y) -> pow(cast(x as double) - cast(y as double), 2)), cast(0 as double), (s, v) -> s + v)||list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: pow(cast(p[1] as double) - cast(p[2] as double), 2)))>>, 6) as dist from q join embeddings e on q.label = e.label and q.vec_id <> e.vec_id),
      r as (select query_id, vec_id, dist, row_number() over (partition by query_id order by dist, vec_id) as k from d) select query_id, vec_id, cast(k as bigint) as place, dist from r where k <= 5""",
)
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    e = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(e.filter("vec_id % 20 = 0"), e, "label", "vec_id", "embedding", 5)


#: Stands for a null label while matrices are merged.
_NO_LABEL = -(1 << 63)
_E = "x as (select row_number() over () as r, vec_id, label, embedding, cast(1 + vec_id % 3 as double) as w from embeddings where embedding is not null), e as (select r, vec_id, label, w, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from x)"
_WHOLE = f"{_E}, gram as (select a.label, len(any_value(a.embedding)) as d, b.i, c.i as j, sum(b.w * cast(b.v as double) * c.v) / sum(b.w) as g from x a join e b on a.r = b.r join e c on a.r = c.r group by a.label, len(a.embedding), b.i, c.i)"
_HALVES = f"{_E}, l as (select a.i, b.i as j, avg(case when a.vec_id % 2 = 0 then cast(a.v as double) * b.v end) as a, avg(case when a.vec_id % 2 = 1 then cast(a.v as double) * b.v end) as b from e a join e b on a.r = b.r group by a.i, b.i)"


def _gram_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row per label and cell: label, d, n (effective rows), i, j, g (weighted mean of products)."""
    ship(spark)
    e = table(spark, sf_dir, "embeddings").select(F.coalesce(F.col("label").cast("long"), F.lit(_NO_LABEL)).alias("label"), "embedding", F.expr("1 + vec_id % 3").alias("w"))
    g = moments.gram(e, "label", "embedding", "w").withColumn("n", F.col("weight_sum") * F.col("weight_sum") / F.col("weight_square_sum"))
    cells = g.select(F.expr(f"nullif(label, {_NO_LABEL})").alias("label"), F.col("dim").alias("d"), "n", "weight_sum", F.posexplode("gram").alias("p", "g"))
    return cells.select("label", "d", "n", F.expr("cast(p div d as int)").alias("i"), F.expr("p % d").alias("j"), (F.col("g") / F.col("weight_sum")).alias("g"))


def _half_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row per cell of the mean products of even vec_id (a) and odd ones (b): d, i, j, a, b."""
    ship(spark)
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id % 2").alias("half"), "embedding").filter("half in (0, 1)")
    g = moments.gram(e, "half", "embedding").select("half", F.col("dim").alias("d"), F.posexplode("gram").alias("p", "g"), "n_rows")
    mean = lambda k: F.max(F.when(F.col("half") == k, F.col("g") / F.col("n_rows")))
    return g.groupBy("d", "p").agg(mean(0).alias("a"), mean(1).alias("b")).select("d", F.expr("p div d").alias("i"), F.expr("p % d").alias("j"), "a", "b")


@frame_query("weighted_gram", f"with {_WHOLE} select label, i, j, round(g, 6) + 0.0 as g from gram")
def weighted_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram_cells(spark, sf_dir).select("label", "i", "j", (F.round("g", 6) + F.lit(0.0)).alias("g"))


@frame_query("sse_from_gram", f"with {_WHOLE} select label, round(sum(g * (i + 1) * cast(0.1 as double) * (j + 1) * cast(0.1 as double)), 6) as sse from gram group by label")
def sse_from_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram_cells(spark, sf_dir).groupBy("label").agg(F.round(F.sum(F.expr("g * (i + 1) * 0.1D * (j + 1) * 0.1D")), 6).alias("sse"))


_ALPHA = ["round(least(1, ((1 - cast(2 as double) / d) * tr2 + tr * tr) / ((n + 1 - cast(2 as double) / d) * (tr2 - tr * tr / d))), 6) as alpha", "round(tr / d, 6) as mean_diagonal"]


@frame_query(
    "oas_shrinkage",
    f"""with {_WHOLE}, n as (select label, power(sum(w), 2) / sum(w * w) as n from x group by label), t as (select label, d, sum(case when i = j then g else 0 end) as tr, sum(g * g) as tr2 from gram group by label, d)
      select t.label, {", ".join(_ALPHA)} from t join n on t.label is not distinct from n.label""",
)
def oas_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _gram_cells(spark, sf_dir).groupBy("label", "d", "n").agg(F.sum(F.expr("case when i = j then g else 0 end")).alias("tr"), F.sum(F.expr("g * g")).alias("tr2"))
    return t.selectExpr("label", *_ALPHA)


_COMPARED = {"trace_ratio": "round(sum(case when i = j then b else 0 end) / sum(case when i = j then a else 0 end), 6)", "relative_frobenius": "round(sqrt(sum(power(a - b, 2)) / sum(a * a)), 6)"}


@frame_query("covariance_comparison", f"with {_HALVES} select {", ".join(f"{v} as {k}" for k, v in _COMPARED.items())} from l")
def covariance_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _half_cells(spark, sf_dir).agg(*[F.expr(v).alias(k) for k, v in _COMPARED.items()])


_COSINES = {
    "total": "round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6)",
    "off_diagonal": "round(sum(oa * ob) / sqrt(sum(oa * oa) * sum(ob * ob)), 6)",
    "trace_removed": "round(sum(ra * rb) / sqrt(sum(ra * ra) * sum(rb * rb)), 6)",
}


@frame_query(
    "component_cosines",
    f"""with {_HALVES}, m as (select avg(case when i = j then a end) as ta, avg(case when i = j then b end) as tb from l),
      c as (select a, b, case when i = j then 0 else a end as oa, case when i = j then 0 else b end as ob, a - case when i = j then ta else 0 end as ra, b - case when i = j then tb else 0 end as rb from l cross join m)
      select {", ".join(f"{v} as {k}" for k, v in _COSINES.items())} from c""",
)
def component_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _half_cells(spark, sf_dir)
    traces = cells.agg(F.expr("avg(case when i = j then a end)").alias("ta"), F.expr("avg(case when i = j then b end)").alias("tb"))
    off = lambda c: F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col(c))
    less = lambda c, t: F.col(c) - F.when(F.col("i") == F.col("j"), F.col(t)).otherwise(0.0)
    c = cells.crossJoin(F.broadcast(traces)).select("a", "b", off("a").alias("oa"), off("b").alias("ob"), less("a", "ta").alias("ra"), less("b", "tb").alias("rb"))
    return c.agg(*[F.expr(v).alias(k) for k, v in _COSINES.items()])


sql_query(
    "split_shrinkage",
    """with e as (<<select vec_id, posexplode(embedding) as (i, v) from embeddings||select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings>>),
      m as (select i, avg(case when vec_id % 2 = 0 then cast(v as double) end) as a, avg(case when vec_id % 2 = 1 then cast(v as double) end) as b from e group by i),
      p as (select sum(a * b) as sig, sum(a * a + b * b) / 2 as tot from m)
      select round(sig, 6) as cross_power, round(tot - sig, 6) as noise, round(greatest(0, least(1, sig / tot)), 5) as keep from p""",
)
_DOT = lambda x, y: f"<<aggregate(zip_with({x}, {y}, (x, y) -> x * y), cast(0 as double), (s, v) -> s + v)||list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1] * p[2]))>>"
sql_query(
    "radial_tangential",
    f"""with u as (<<select label, posexplode(embedding) as (i, v) from embeddings||select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings>>),
      m as (select label, i, avg(cast(v as double)) as c from u group by label, i),
      p as (select label, <<transform(array_sort(collect_list(struct(i, c))), s -> s.c)||list(c order by i)>> as c from m group by label),
      e as (select v.vec_id, p.c, <<zip_with(v.embedding, p.c, (x, y) -> cast(x as double) - y)||list_transform(list_zip(v.embedding, p.c), lambda q: cast(q[1] as double) - q[2])>> as d from embeddings v join p on v.label = p.label),
      s as (select vec_id, {_DOT("d", "c")} as dc, {_DOT("c", "c")} as cc, {_DOT("d", "d")} as dd from e)
      select vec_id, round(dc * dc / nullif(cc, 0), 6) as radial, round(dd - dc * dc / nullif(cc, 0), 6) as tangential from s""",
)

for _k in "weighted_gram sse_from_gram oas_shrinkage covariance_comparison component_cosines split_shrinkage radial_tangential".split():
    same_query(f"{_k}_whole", _k)
