"""Queries that need more than SQL: other hashes, matrices, sequential rules, tensors, streams."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import extensions, hashing
from sedge.operators import allocation, moments, scheduling
from sedge.plans.dialect import EVENTS, LEDGER, frame_query, run_sql, same_query, table
from sedge.shipping import ship
from sedge.sources import tensors
from sedge.streaming import events as streams


@frame_query("hash_sample")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id").filter(hashing.sampled(16)("user_id", "event_id"))


@frame_query("content_hash_folds")
def content_hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", hashing.blake2b_128()("text").alias("digest"))
    return d.select("doc_id", "digest", hashing.big_fold(8)("digest").alias("fold"), hashing.little_fold(3)("doc_id").alias("side"))


_GRAM_SQL = """with e as (select label, vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings where label is not null)
  select a.label as label, cast(a.i as bigint) as i, cast(b.i as bigint) as j, round(sum(cast(a.v as double) * b.v), 4) + 0.0 as g, count(*) as n
  from e a join e b on a.vec_id = b.vec_id and a.label = b.label group by a.label, a.i, b.i"""


@frame_query("gram_partial_merge", _GRAM_SQL)
def gram_partial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    g = moments.gram(table(spark, sf_dir, "embeddings"), "label", "embedding")
    cells = g.select("label", "n_rows", "dim", F.posexplode("gram").alias("p", "g"))
    return cells.select(F.col("label").cast("int").alias("label"), (F.floor(F.col("p") / F.col("dim")) + 1).alias("i"), (F.col("p") % F.col("dim") + 1).cast("long").alias("j"), (F.round("g", 4) + F.lit(0.0)).alias("g"), F.col("n_rows").alias("n"))


same_query("gram_partial_merge_whole", "gram_partial_merge")

#: Words, and characters of passages without so many, that make a passage's key.
KEY_WORDS, KEY_CHARS = 5, 3


def passages_in(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Row per document that holds a passage: doc_id, n_passages (whole distinct ones, of any length).

    A passage's words between its first and its last are whole words of any text that holds it;
    up to five of them in a row are its key, by which documents are found. One of two words or
    fewer is found by its first characters. contains() decides. Empty and null texts hold
    nothing; rows that repeat a doc_id count each.
    """
    words = lambda c: F.split(c, r"\s+")
    docs = docs.select("doc_id", "text").filter("length(text) > 0").withColumn("h", F.xxhash64("text"))
    b = passages.filter("length(text) > 0").select(F.col("text").alias("passage")).distinct().withColumn("w", words("passage"))
    inner = F.least(F.size("w") - 2, F.lit(KEY_WORDS))
    first = F.substring("passage", 1, KEY_CHARS)
    b = b.withColumn("n", F.when(inner > 0, inner).otherwise(-F.length(first)))
    b = b.select("passage", "n", F.when(inner > 0, F.xxhash64(F.slice("w", 2, F.greatest(inner, F.lit(1))))).otherwise(F.xxhash64(first)).alias("key"))
    texts = docs.select("h", "text").dropDuplicates(["h"]).withColumn("w", words("text"))
    def runs_of(n: int) -> F.Column:
        """Hashes of all runs of n words, or of -n characters."""
        at = F.sequence(F.lit(1), F.when(F.lit(n > 0), F.size("w")).otherwise(F.length("text")) - (abs(n) - 1))
        return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("w", i, n) if n > 0 else F.substring(F.col("text"), i, F.lit(-n)))))

    found = []
    for (n,) in b.select("n").distinct().collect():  # at most KEY_WORDS + KEY_CHARS numbers
        size = F.size("w") if n > 0 else F.length("text")
        runs = texts.filter(size >= abs(n)).select("h", F.explode(runs_of(n)).alias("key"))
        found.append(runs.join(b.filter(F.col("n") == n), "key").select("h", "passage"))
    if not found:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_passages")).limit(0)
    pairs = reduce(DataFrame.unionByName, found).distinct()
    return docs.join(pairs, "h").filter(F.contains("text", "passage")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_passages"))


@frame_query("exclude_prior_contains", "with b as (select distinct text from benchmark where length(text) > 0) select d.doc_id, count(*) as n_passages from documents d join b on contains(d.text, b.text) group by d.doc_id")
def exclude_prior_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages_in(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


same_query("exclude_prior_contains_whole", "exclude_prior_contains")


@frame_query("ridge_from_gram")
def ridge_from_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return moments.ridge(moments.gram(table(spark, sf_dir, "embeddings"), "label", "embedding"), "label", 0, 0.01)


#: Rows in order take the batch of the row before, or the next one where that would pass the cap.
_BATCHES = """with recursive r as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as k from documents),
  w as (select source, k, doc_id, cast(0 as bigint) as batch, n_chars as used from r where k = 1 union all
    select r.source, r.k, r.doc_id, case when w.used > 0 and w.used + r.n_chars > 16384 then w.batch + 1 else w.batch end, case when w.used > 0 and w.used + r.n_chars > 16384 then r.n_chars else w.used + r.n_chars end
    from w join r on r.source = w.source and r.k = w.k + 1) select source, doc_id, batch from w"""


@frame_query("token_batches", _BATCHES)
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return scheduling.token_batches(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 16384)


_PARTS = """with e as (select source, row_number() over (partition by source order by doc_id) as idx, sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and current row) as ends from documents),
  z as (select source, idx, ends from e union all select distinct source, 0, 0 from documents), t as (select source, max(idx) as n, max(ends) as total from z group by source),
  c as (select z.source, s.k, arg_min(idx, (abs(ends - total * s.k / cast(8 as double)), idx)) as at from z join t on z.source = t.source cross join (select range as k from range(1, 8)) s group by z.source, s.k union all select source, 0, 0 from t union all select source, 8, n from t)
  select a.source, cast(a.k as bigint) as part, cast(a.at as bigint) as first, cast(b.at as bigint) as stop, cast(zb.ends - za.ends as bigint) as tokens from c a join c b on a.source = b.source and b.k = a.k + 1 join z za on za.source = a.source and za.idx = a.at join z zb on zb.source = a.source and zb.idx = b.at"""


@frame_query("balanced_partitions", _PARTS)
def balanced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return scheduling.balanced_partitions(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 8)


_ITEMS = f"with {LEDGER} select layer, expert, cast(round(sum(base - cand)) as bigint) as gain, cast(sum(weight) as bigint) as cost from led group by layer, expert"


#: The item in turn goes to the worker of the least load, of equal ones to the first.
_TURNS = f"""with recursive {LEDGER}, item as (select layer, expert, cast(sum(weight) as bigint) as cost from led group by 1, 2), r as (select layer, expert, cost, row_number() over (partition by layer order by cost desc, expert) as k from item),
  w as (select layer, cast(0 as bigint) as k, cast(null as bigint) as expert, cast(null as bigint) as worker, [0, 0, 0, 0]::bigint[] as load from (select distinct layer from r) x union all
    select r.layer, r.k, r.expert, list_position(w.load, list_min(w.load)) - 1, list_transform(w.load, lambda v, i: case when i = list_position(w.load, list_min(w.load)) then v + r.cost else v end) from w join r on r.layer = w.layer and r.k = w.k + 1)
  select layer, expert, cast(worker as bigint) as worker from w where k > 0"""


@frame_query("lpt_schedule", _TURNS)
def lpt_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return scheduling.longest_first(run_sql(spark, sf_dir, _ITEMS), "layer", "expert", "cost", 4)


@frame_query("dp_allocation")
def dp_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return scheduling.knapsack(run_sql(spark, sf_dir, _ITEMS), "layer", "expert", "gain", "cost", 500)


@frame_query("bootstrap_exact_seed")
def bootstrap_exact_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    c = run_sql(spark, sf_dir, f"with {EVENTS} select event_type, user_id, sum(base) as base, sum(cand) as cand from ev group by event_type, user_id")
    return scheduling.seeded_bootstrap(c, "event_type", "user_id", "base", "cand", 2000, 1234)


#: A shard holds the vectors of so many numbers, so its file has a bounded size.
SHARD_ROWS = 1 << 16


@frame_query("safetensors_headers", "select cast(label as varchar) as label, 'embedding' as name, 'F32' as dtype, count(*) as n_rows, cast(max(len(embedding)) as bigint) as n_columns, cast(count(*) * max(len(embedding)) * 4 as bigint) as n_bytes from embeddings where label is not null group by label")
def safetensors_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of embeddings are encoded as tensor files, and their headers read."""
    ship(spark)

    def shard(t: pa.Table) -> pa.Table:
        flat = np.concatenate([np.asarray(c.flatten(), np.float32) for c in t.column("embedding").chunks])
        return pa.table({"label": [str(t.column("label")[0].as_py())], "content": pa.array([tensors.encode({"embedding": flat.reshape(t.num_rows, -1)})], pa.binary())})

    e = table(spark, sf_dir, "embeddings").filter("label is not null and embedding is not null").select("label", F.floor(F.col("vec_id") / SHARD_ROWS).alias("shard"), "embedding")
    files = e.groupBy("label", "shard").applyInArrow(shard, "label string, content binary")
    h = tensors.headers(files, "label", "content")
    rows, columns = F.col("shape")[0], F.col("shape")[1]
    return h.groupBy("label", "name", "dtype").agg(F.sum(rows).alias("n_rows"), F.max(columns).alias("n_columns"), F.sum(F.col("end") - F.col("begin")).alias("n_bytes"))


@frame_query("stream_tumbling_events", "select cast(epoch(time_bucket(interval 1 hour, ts)) as bigint) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def stream_tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(spark, streams.tumbling(streams.stream_of(spark, sf_dir, "events", None)), "window_start", "event_type").withColumn("total", F.round("total", 6))


@frame_query(
    "stream_session_events",
    """with m as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as new from events),
       s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as session from m)
       select cast(epoch_us(min(ts)) as bigint) as session_start, user_id, count(*) as n from s group by user_id, session""",
)
def stream_session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained_sessions(spark, streams.sessions(streams.stream_of(spark, sf_dir, "events", None)))


@frame_query("stream_dedup_ingest", "select distinct sha256(text) as text_hash from documents")
def stream_dedup_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.distinct_ingest(spark, streams.stream_of(spark, sf_dir, "documents"))


@frame_query("stream_until_target", "select count(*) as n_texts, count(*) > 0 as some from (select distinct sha256(text) as h from documents) t")
def stream_until_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts until a tenth of their characters is there; a table is one batch, of one file or many."""
    texts = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.min("n_chars").alias("n_chars"))
    target = texts.agg(F.sum("n_chars")).first()[0] or 0
    got = streams.ingest_until(spark, streams.stream_of(spark, sf_dir, "documents", None), target // 10)
    return got.agg(F.count(F.lit(1)).alias("n_texts"), (F.count(F.lit(1)) > 0).alias("some"))


_BUDGET = f"with recursive {LEDGER}, item as (select layer, expert, round(sum(base - cand) * 100) as d, cast(sum(weight) as double) as c from led group by 1, 2), pos as (select d, c from item where d > 0 and c > 0), target as (select cast(floor(sum(c) * 0.4) as bigint) as t from item)"


@frame_query(
    "byte_target",
    f"""{_BUDGET}, b as (select 0 as k, cast(0 as double) as low, (select max(d / c) from pos) as high union all
        select k + 1, case when over then (low + high) / 2 else low end, case when over then high else (low + high) / 2 end from (select k, low, high, (select sum(case when d > (low + high) / 2 * c then c else 0 end) from pos) > (select t from target) as over from b where k < 72) x),
      f as (select high from b where k = 72) select cast(count(*) as bigint) as n_kept, cast(sum(c) as bigint) as n_bytes, sum(d) as damage, cast(max(t) - sum(c) as bigint) as slack from pos, f, target where d > high * c""",
)
def byte_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = run_sql(spark, sf_dir, f"with {LEDGER} select layer, expert, round(sum(base - cand) * 100) as d, sum(weight) as c from led group by 1, 2")
    total = items.agg(F.sum("c")).first()[0] or 0
    return allocation.byte_target(items, "d", "c", int(total * 0.4)).select("n_kept", "n_bytes", "damage", "slack")


@frame_query("low_rank_residual")
def low_rank_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each label's energy that four directions leave; one matrix a label comes to the driver."""
    ship(spark)
    g = moments.gram(table(spark, sf_dir, "embeddings"), "label", "embedding").collect()
    rows = [(int(r.label), int(r.dim), round(allocation.low_rank(np.array(r.gram).reshape(r.dim, r.dim), 4)[1], 9)) for r in g]
    return spark.createDataFrame(rows, "label long, dim int, residual double")


@frame_query("fit_codebook")
def fit_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four code vectors for discount and tax, weighted by quantity, and how much is nearest to each."""
    rows = run_sql(spark, sf_dir, "select array(l_discount, l_tax) as v, l_quantity as w from lineitem")
    got = allocation.nearest(rows, allocation.fit_codebook(rows, "v", "w", 4))
    return got.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("w") * F.col("error")) / F.sum("w"), 9).alias("mse"))


#: The item in turn goes to the bin of the least sum that has room.
_FILL = f"""with recursive {LEDGER}, item as (select layer, expert % 40 as expert, cast(sum(weight) as bigint) as score from led group by 1, 2), r as (select layer, expert, score, row_number() over (partition by layer order by score desc, expert) as k, cast(ceil(count(*) over (partition by layer) / 4.0) as bigint) as room from item),
  w as (select layer, cast(0 as bigint) as k, cast(null as bigint) as expert, cast(null as bigint) as bin, [0, 0, 0, 0]::bigint[] as load, [0, 0, 0, 0]::bigint[] as n from (select distinct layer from r) x union all
    select layer, k, expert, b - 1, list_transform(load, lambda v, i: case when i = b then v + score else v end), list_transform(n, lambda v, i: case when i = b then v + 1 else v end)
    from (select r.layer, r.k, r.expert, r.score, w.load, w.n, list_position(list_transform(w.load, lambda v, i: case when w.n[i] < r.room then v else null end), list_min(list_transform(w.load, lambda v, i: case when w.n[i] < r.room then v else null end))) as b from w join r on r.layer = w.layer and r.k = w.k + 1) y)
  select layer, expert, cast(bin as bigint) as bin from w where k > 0"""


@frame_query("balanced_fill", _FILL)
def balanced_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    items = run_sql(spark, sf_dir, f"with {LEDGER} select layer, expert % 40 as expert, cast(sum(weight) as bigint) as score from led group by 1, 2")
    return scheduling.balanced_fill(items, "layer", "expert", "score", 4)


@frame_query("coordinate_descent")
def coordinate_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes of a layer's slots whose errors should cancel, at a price for the ones that cost more."""
    ship(spark)
    options = run_sql(spark, sf_dir, f"with {LEDGER}, s as (select layer, expert % 20 as slot, sum(cand - base) / 1000 as d, sum(weight) as w from led group by 1, 2) select layer, slot, m.mode, d * (1 - m.mode) - d * 0.5 * m.mode * (m.mode - 1) / 2 as value, w * m.mode as cost from s join (select 0 as mode union all select 1 as mode union all select 2 as mode) m on true")
    return scheduling.descend(options, "layer", "slot", "mode", "value", "cost", 0.01).withColumn("objective", F.round("objective", 6))


@frame_query(
    "token_chunks",
    """with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as ws from documents), c as (select doc_id, ws, unnest(range(cast(ceil(len(ws) / 64.0) as bigint))) as chunk from w)
       select doc_id, chunk, cast(least(len(ws) - chunk * 64, 64) as bigint) as n_words, sha256(array_to_string(ws[chunk * 64 + 1:chunk * 64 + 64], ' ')) as words_sha256 from c""",
)
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = extensions.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 64)
    return c.select("doc_id", "chunk", "n_words", F.sha2(F.array_join("words", " "), 256).alias("words_sha256"))


@frame_query("pool_progress", "select source, count(*) as n_planned, cast(sum(case when doc_id % 3 = 0 then 1 else 0 end) as bigint) as n_done, cast(sum(case when doc_id % 3 = 0 then n_chars else 0 end) as bigint) as chars_done, round(sum(case when doc_id % 3 = 0 then n_chars else 0 end) / cast(sum(n_chars) as double), 9) as share, sum(case when doc_id % 3 = 0 then 0 else 1 end) = 0 as complete from documents group by source")
def pool_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a run is whose receipts name a third of the plan, group by group."""
    plan = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    done = plan.filter("doc_id % 3 = 0").select("doc_id", F.lit(True).alias("done")).distinct()
    is_done = F.coalesce("done", F.lit(False))
    got = plan.join(done, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_planned"), F.count_if(is_done).alias("n_done"), F.coalesce(F.sum(F.when(is_done, F.col("n_chars"))), F.lit(0)).alias("chars_done"), F.sum("n_chars").alias("all_"))
    return got.select("source", "n_planned", "n_done", "chars_done", F.round(F.col("chars_done") / F.col("all_"), 9).alias("share"), (F.col("n_done") == F.col("n_planned")).alias("complete"))
