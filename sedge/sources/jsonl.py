"""Records as lines of JSON: ordinals, coercion to one shape, byte-preserving shards, and what is left of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of files whose offsets are broadcast; beyond that they are joined by exchange.
BLOCKS = 1_000_000

_MESSAGES = "array<struct<role:string,content:string>>"
_RECORD = f"prompt string, text string, messages {_MESSAGES}, conversations {_MESSAGES}"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Row per line: file, line (1-based within the file), raw.

    A file's blocks are read apart; a line's number is its place in its block plus the lines of
    the blocks before, so that no file goes through one task. Empty lines count.
    """
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id")).toDF("raw", "file", "block", "id")
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.selectExpr("file", "block", "first", "sum(n) over (partition by file order by block) - n as before")
    if blocks.count() <= BLOCKS:
        blocks = F.broadcast(blocks)
    return raw.join(blocks, ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "raw")


def coerce(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """lines with kind and messages (array of role, content).

    The first of these that a record has counts: a string `prompt` (one message without a role),
    `messages`, `text` that is itself a JSON record with `messages`, `conversations`. A line
    that is no JSON object is `undecodable`, one with none of these, or an empty list, is
    `unusable`; both keep their row with null messages. Null and blank lines are undecodable.
    """
    r = F.from_json(raw, _RECORD)
    inner = F.from_json(r["text"], _RECORD)["messages"]
    shape = F.trim(raw).startswith("{") & F.get_json_object(raw, "$").isNotNull()
    some = lambda m: m.isNotNull() & (F.size(m) > 0)
    kind = (
        F.when(~F.coalesce(shape, F.lit(False)), "undecodable")
        .when(r["prompt"].isNotNull(), "prompt")
        .when(some(r["messages"]), "messages")
        .when(some(inner), "text")
        .when(some(r["conversations"]), "conversations")
        .otherwise("unusable")
    )
    out = lines.withColumn("kind", kind)
    single = F.array(F.struct(F.lit(None).cast("string").alias("role"), r["prompt"].alias("content")))
    messages = F.when(F.col("kind") == "prompt", single).when(F.col("kind") == "messages", r["messages"]).when(F.col("kind") == "text", inner).when(F.col("kind") == "conversations", r["conversations"])
    return out.withColumn("messages", messages)


def shard_name(source: Column) -> Column:
    """A folder's name for a source; records without one go to `unselected`."""
    return F.coalesce(F.regexp_replace(source, "[^A-Za-z0-9_.-]+", "_"), F.lit("unselected"))


def demux(lines: DataFrame, source: Column, path: str, raw: str = "raw") -> None:
    """Writes each line unchanged into its source's folder under path, as shard=<name>/part files.

    Tasks write what they hold, so a source that has a third of all lines needs no exchange.
    A second run replaces the first.
    """
    lines.select(F.col(raw).alias("value"), shard_name(source).alias("shard")).write.mode("overwrite").partitionBy("shard").text(path)


def plan_digest(requests: DataFrame, *columns: str) -> str:
    """A digest of the rows of a plan in any order."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    r = requests.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s"), F.sum(F.xxhash64(F.lit("again"), *columns).cast("decimal(38,0)")).alias("t")).first()
    return f"{r.n}:{r.s}:{r.t}"


def pending(requests: DataFrame, receipts: DataFrame, key: str, digest: str | None = None) -> DataFrame:
    """Requests without a receipt. digest: what the plan had when the receipts were begun; another plan is an error.

    So is a receipt for what the plan doesn't have. Null keys are never done.
    """
    if digest is not None and plan_digest(requests, key) != digest:
        raise ValueError("the receipts belong to another plan")
    if receipts.join(requests, key, "left_anti").limit(1).count():
        raise ValueError("a receipt names a request that the plan does not have")
    return requests.join(receipts.select(key).distinct(), key, "left_anti")
