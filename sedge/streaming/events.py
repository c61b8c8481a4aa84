"""Event-time aggregates and ingest as structured streams that end with the input.

Each micro-batch writes a folder of its own number, so one that runs again replaces itself;
a stream that is given its folder again goes on after the last finished batch.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint folder; a local one only in local mode where none is set."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sedge-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = 8) -> DataFrame:
    """A table, a file or a folder of files, as a stream; files_per_batch bounds what one micro-batch takes in, None takes all at once."""
    table = f"{sf_dir}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(table).schema)
    if files_per_batch is not None:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return source.parquet(table)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All batches' rows with their number; none where no batch had come."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/out")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def drained(spark: SparkSession, df: DataFrame, *keys: str, folder: str | None = None, max_rows: int | None = None) -> DataFrame:
    """Runs an aggregating stream over all there is: the latest row of each key.

    Batches write what changed; state ends with the watermark. folder: where an earlier run of the same stream
    stopped. A batch with more changed rows than max_rows is an error, nothing is dropped.
    """
    folder, schema = folder or shared_folder(spark), _ddl(df)

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")
        if max_rows is not None and spark.read.parquet(f"{folder}/out/batch={k}").count() > max_rows:
            raise OverflowError(f"batch {k} has more than {max_rows} rows")

    q = df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = _results(spark, folder, schema)
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "batch").alias("latest"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"latest.{c}").alias(c) for c in df.columns])


def tumbling(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Count and sum by window and type; events later than `late` behind the newest are dropped when state is let go."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = e.groupBy(F.window("at", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.unix_seconds("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Count by user and session; a session ends after a pause of `gap`."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = e.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.unix_micros("session_window.start").alias("session_start"), "user_id", "n")


def drained_sessions(spark: SparkSession, df: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream of sessions over all there is. Sessions that grow change their start, so the whole result is kept."""
    folder, schema = folder or shared_folder(spark), _ddl(df)

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")

    q = df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = _results(spark, folder, schema)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == F.lit(last)).drop("batch")


def _hashes(docs: DataFrame) -> DataFrame:
    return docs.select(F.sha2("text", 256).alias("text_hash"), "n_chars").dropDuplicates(["text_hash"])


def distinct_ingest(spark: SparkSession, docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Hashes of texts, each once over the whole stream, appended with exactly-once files."""
    folder = folder or shared_folder(spark)
    q = _hashes(docs).drop("n_chars").writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("text_hash string").parquet(f"{folder}/out")


def ingest_until(spark: SparkSession, docs: DataFrame, target_chars: int, folder: str | None = None) -> DataFrame:
    """Distinct texts batch by batch until their characters reach the target: text_hash, n_chars, batch.

    The batch that reaches it is the last and is kept whole, the first one also where the target is 0; a
    batch that begins before the stream has stopped is let go, what follows is never read. A stream
    that ends before is an error: a target that can't be met is not passed over.
    """
    folder = folder or shared_folder(spark)
    schema = "text_hash string, n_chars long"
    n_rows, total = _results(spark, folder, schema).agg(F.count(F.lit(1)), F.coalesce(F.sum("n_chars"), F.lit(0))).first()

    def put(batch: DataFrame, k: int) -> None:
        nonlocal n_rows, total
        if total < target_chars or not n_rows:
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")
            n_rows, total = _results(spark, folder, schema).agg(F.count(F.lit(1)), F.coalesce(F.sum("n_chars"), F.lit(0))).first()
        else:
            batch.write.format("noop").mode("overwrite").save()

    q = _hashes(docs).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    while q.isActive and (total < target_chars or not n_rows):
        q.awaitTermination(1)
    q.stop()
    if q.exception() is not None:
        raise q.exception()
    if total < target_chars:
        raise ValueError(f"the stream ended at {total} of {target_chars} characters")
    return _results(spark, folder, schema)
