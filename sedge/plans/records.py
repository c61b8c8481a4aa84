"""Lines of JSON: scans with ordinals, coercion, shards, and plans that go on where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.plans.dialect import count_if, frame_query, sha, table
from sedge.sources import jsonl
from sedge.streaming.events import shared_folder

#: A document as a line of JSON; each 97th is cut off and so no record.
_LINE = """case when doc_id % 97 = 5 then concat('{"doc_id":', cast(doc_id as varchar(20))) else concat('{"doc_id":', cast(doc_id as varchar(20)), ',"source":"', source, '","prompt":"p', cast(n_chars as varchar(20)), '"}') end"""


def _written(spark: SparkSession, lines: DataFrame) -> str:
    folder = f"{shared_folder(spark)}/lines"
    lines.write.text(folder)
    return folder


@frame_query("scan_jsonl", f"with l as (select {_LINE} as raw, doc_id % 97 = 5 as bad, source from documents) select case when bad then null else source end as source, count(*) as n_lines, {count_if('bad')} as n_undecodable, cast(sum(length(raw)) as bigint) as n_chars from l group by 1")
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes documents as lines, reads them with their numbers, and counts by the source that lines name."""
    docs = table(spark, sf_dir, "documents")
    lines = jsonl.scan(spark, _written(spark, docs.select(F.expr(_LINE).alias("value"))))
    got = jsonl.coerce(lines.filter("line >= 1"))
    bad = F.col("kind") == "undecodable"
    return got.groupBy(F.when(~bad, F.get_json_object("raw", "$.source")).alias("source")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(bad.cast("long")).alias("n_undecodable"), F.sum(F.length("raw")).cast("long").alias("n_chars"))


_TURNS = """select conv_id, count(*) as n, <<array_join(transform(array_sort(collect_list(struct(turn, role, text))), x -> concat(x.role, ':', x.text)), '|')||string_agg(role || ':' || text, '|' order by turn, role, text)>> as flat
      from conversations where role is not null and text is not null group by conv_id"""


@frame_query(
    "record_coercion",
    f"""with t as ({_TURNS}) select conv_id, case conv_id % 5 when 0 then 'prompt' when 1 then 'messages' when 2 then 'text' when 3 then 'conversations' else 'unusable' end as kind,
        cast(case conv_id % 5 when 0 then 1 when 4 then 0 else n end as bigint) as n_messages, {sha("case conv_id % 5 when 4 then '' else flat end")} as content_sha256 from t""",
)
def record_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records of each kind, written as lines, and brought back to one shape."""
    c = table(spark, sf_dir, "conversations").filter("role is not null and text is not null")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    c = c.groupBy("conv_id").agg(turns.alias("m"))
    flat = lambda m: F.array_join(F.transform(m, lambda x: F.concat(F.coalesce(F.concat(x["role"], F.lit(":")), F.lit("")), x["content"])), "|")
    kind = F.col("conv_id") % 5
    record = (
        F.when(kind == 0, F.to_json(F.struct("conv_id", flat(F.col("m")).alias("prompt"))))
        .when(kind == 1, F.to_json(F.struct("conv_id", F.col("m").alias("messages"))))
        .when(kind == 2, F.to_json(F.struct("conv_id", F.to_json(F.struct(F.col("m").alias("messages"))).alias("text"))))
        .when(kind == 3, F.to_json(F.struct("conv_id", F.col("m").alias("conversations"))))
        .otherwise(F.to_json(F.struct("conv_id")))
    )
    got = jsonl.coerce(jsonl.scan(spark, _written(spark, c.select(record.alias("value")))))
    return got.select(F.get_json_object("raw", "$.conv_id").cast("long").alias("conv_id"), "kind", F.coalesce(F.size("messages"), F.lit(0)).cast("long").alias("n_messages"), F.sha2(F.coalesce(flat(F.col("messages")), F.lit("")), 256).alias("content_sha256"))


@frame_query("demux_sources", f"with l as (select {_LINE} as raw, coalesce(regexp_replace(source, '[^A-Za-z0-9_.-]+', '_', 'g'), 'unselected') as shard from documents) select shard, count(*) as n_lines, cast(sum(length(raw)) as bigint) as n_chars, count(distinct sha256(raw)) as n_distinct from l group by shard")
def demux_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in a folder for each source, and what a reader of these folders finds."""
    folder = f"{shared_folder(spark)}/shards"
    docs = table(spark, sf_dir, "documents")
    jsonl.demux(docs.select(F.expr(_LINE).alias("raw"), "source"), F.col("source"), folder)
    got = spark.read.schema("value string, shard string").text(folder)
    return got.groupBy("shard").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).cast("long").alias("n_chars"), F.countDistinct(F.sha2("value", 256)).alias("n_distinct"))


@frame_query("resume_pending", "select doc_id, source from documents where n_chars >= 100 and doc_id % 3 <> 0")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan still has to do after a run that left receipts for a third of it."""
    requests = table(spark, sf_dir, "documents").filter("n_chars >= 100").select("doc_id", "source")
    receipts = requests.filter("doc_id % 3 = 0").select("doc_id")
    return jsonl.pending(requests, receipts, "doc_id", jsonl.plan_digest(requests, "doc_id"))
