"""Lines of JSON, streams that go on, and allocation, against plain computations."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sedge.operators import allocation
from sedge.plans.catalog import REGISTRY
from sedge.sources import jsonl
from sedge.streaming import events


def test_line_numbers_over_blocks(spark, tmp_path):
    lines = {"a": [f"line {k} {'x' * (k % 50)}" for k in range(2000)], "b": ["", "one", ""], "c": []}
    for name, rows in lines.items():
        (tmp_path / name).write_text("".join(r + "\n" for r in rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = jsonl.scan(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        got = sorted((r.file.rpartition("/")[2], r.line, r.raw) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(n, k, r) for n, rows in lines.items() for k, r in enumerate(rows, 1)]


def test_records_of_each_kind(spark):
    m = [{"role": "user", "content": "hi"}]
    rows = [
        ({"prompt": "p", "messages": m, "text": "x"}, "prompt", 1),
        ({"messages": m, "conversations": m + m}, "messages", 1),
        ({"text": json.dumps({"messages": m + m}), "conversations": m}, "text", 2),
        ({"text": "plain", "conversations": m}, "conversations", 1),
        ({"messages": [], "conversations": m}, "conversations", 1),
        ({"text": "plain"}, "unusable", None),
        ({}, "unusable", None),
    ]
    lines = [json.dumps(r) for r, *_ in rows] + ["", "  ", "[1, 2]", "nonsense", '{"prompt": "cut', None, "7"]
    df = spark.createDataFrame([*enumerate(lines)], "k long, raw string").withColumn("messages", F.lit(1)).drop("messages")
    got = {r.k: (r.kind, None if r.messages is None else len(r.messages)) for r in jsonl.coerce(df).collect()}
    assert [got[k] for k in range(len(rows))] == [(kind, n) for _, kind, n in rows]
    assert all(got[k] == ("undecodable", None) for k in range(len(rows), len(lines)))
    assert jsonl.coerce(df.limit(0)).count() == 0


def test_shards_hold_lines_unchanged(spark, tmp_path):
    rows = [("a/b", ' {"x": 1}  '), ("a/b", "é\t"), (None, "none"), ("c", "")]
    for _ in range(2):  # a second run replaces the first
        jsonl.demux(spark.createDataFrame(rows, "source string, raw string"), F.col("source"), str(tmp_path / "out"))
    got = {p.name.removeprefix("shard="): sorted(x for f in p.glob("part-*") for x in f.read_text().split("\n")[:-1]) for p in (tmp_path / "out").glob("shard=*")}
    assert got == {"a_b": sorted([' {"x": 1}  ', "é\t"]), "unselected": ["none"], "c": [""]}


def test_plans_go_on(spark):
    plan = spark.createDataFrame([(k,) for k in range(10)], "k long")
    digest = jsonl.plan_digest(plan, "k")
    assert digest == jsonl.plan_digest(plan.repartition(5), "k") != jsonl.plan_digest(plan.filter("k > 0"), "k")
    done = spark.createDataFrame([(1,), (1,), (4,)], "k long")
    assert sorted(r.k for r in jsonl.pending(plan, done, "k", digest).collect()) == [0, 2, 3, 5, 6, 7, 8, 9]
    with pytest.raises(ValueError, match="another plan"):
        jsonl.pending(plan.filter("k > 1"), done, "k", digest)
    with pytest.raises(ValueError, match="does not have"):
        jsonl.pending(plan.filter("k > 1"), done, "k")


@pytest.fixture
def stream(spark, tmp_path):
    """Several files of documents as a stream of one file a batch."""
    for k in range(4):
        rows = [(10 * k + j, f"text {(10 * k + j) % 25}", 100) for j in range(10)]
        spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(str(tmp_path / f"in{k}" / "documents.parquet"))
    schema = "doc_id long, text string, n_chars long"
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*" / "documents.parquet"))


def test_ingest_stops_at_its_target(spark, stream, tmp_path):
    got = events.ingest_until(spark, stream(), 1500, str(tmp_path / "state"))
    rows = got.collect()
    assert 15 <= len(rows) <= 20 and len({r.text_hash for r in rows}) == len(rows)
    with pytest.raises(ValueError, match="ended at 2500"):
        events.ingest_until(spark, stream(), 10_000, str(tmp_path / "other"))


def test_streams_go_on_and_overflow(spark, stream, tmp_path):
    counted = lambda: stream().groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    for _ in range(2):  # the second run finds nothing new
        got = {r.text: r.n for r in events.drained(spark, counted(), "text", folder=str(tmp_path / "state")).collect()}
        assert len(got) == 25 and sum(got.values()) == 40
    with pytest.raises(Exception, match="more than 5 rows"):
        events.drained(spark, counted(), "text", folder=str(tmp_path / "small"), max_rows=5)


@pytest.mark.parametrize("texts, n_files", [([f"text {k % 30}" for k in range(60)], 12), (["same"] * 40, 10), (["", None, ""], 2)])
def test_streams_of_folders_are_whole(spark, tmp_path, texts, n_files):
    rows = [(k, t, len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(n_files).write.parquet(str(tmp_path / "documents.parquet"))
    assert REGISTRY["stream_dedup_ingest"].run(spark, str(tmp_path)).count() == len(set(texts))
    assert REGISTRY["stream_until_target"].run(spark, str(tmp_path)).collect() == [(len(set(texts)), True)]


def test_ingest_in_many_batches_has_the_hashes_of_its_sql(spark, tmp_path):
    texts = [None, "", *(f"text {k % 70} \u00e4\U0001f600" for k in range(200))]
    rows = [{"doc_id": k, "text": t, "n_chars": 1} for k, t in enumerate(texts + texts[:50])]
    (tmp_path / "documents.parquet").mkdir()
    for k in range(20):  # three batches of files that are months apart; texts come again in later ones
        pq.write_table(pa.Table.from_pylist(rows[k::20]), f := tmp_path / "documents.parquet" / f"part-{k}.parquet")
        os.utime(f, (1_700_000_000 - 86_400 * 40 * (k % 7),) * 2)
    got = [r.text_hash for r in REGISTRY["stream_dedup_ingest"].run(spark, str(tmp_path)).collect()]
    want = {t if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts}
    assert len(got) == len(want) and set(got) == want


def test_windows_over_files_in_any_order(spark, tmp_path):
    rows = [(k, k % 3, "view", 1.0, 1_700_000_000 + 86_400 * (11 - k)) for k in range(12)]
    for r in rows:  # the newest comes first, so that all others would be late
        df = spark.createDataFrame([r], "event_id long, user_id long, event_type string, value double, at long")
        df.selectExpr("event_id", "user_id", "event_type", "value", "cast(timestamp_seconds(at) as timestamp_ntz) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    for key in "stream_tumbling_events", "stream_session_events":
        assert REGISTRY[key].run(spark, str(tmp_path)).count() == 12


def test_no_input_at_all(spark, tmp_path):
    (tmp_path / "in").mkdir()
    df = spark.readStream.schema("text string").parquet(str(tmp_path / "in")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    assert events.drained(spark, df, "text", folder=str(tmp_path / "state")).count() == 0


def test_byte_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(float(d), float(c)) for d, c in zip(rng.integers(-5, 100, 300), rng.integers(1, 20, 300), strict=True)] + [(None, 1.0), (5.0, None)]
    df = spark.createDataFrame(rows, "d double, c double")
    good = [(d, c) for d, c in rows if d and c and d > 0]
    for target in (0, 100, 1000, 10**6):
        r = allocation.byte_target(df, "d", "c", target).first()
        ratios = sorted({d / c for d, c in good}, reverse=True)
        best = max((k for k in range(len(ratios) + 1) if sum(c for d, c in good if k and d / c >= ratios[k - 1]) <= target), default=0)
        want = [(d, c) for d, c in good if best and d / c >= ratios[best - 1]]
        assert (r.n_kept, r.n_bytes, r.damage) == (len(want), sum(c for _, c in want), sum(d for d, _ in want))
        assert r.slack == target - r.n_bytes
    assert allocation.byte_target(df.limit(0), "d", "c", 5).first().n_kept == 0


def test_low_rank_is_the_truncated_decomposition():
    x = np.random.default_rng(2).normal(size=(50, 8)) @ np.diag([9, 5, 2, 1, 1, 0.5, 0.1, 0.1])
    directions, left = allocation.low_rank(x.T @ x, 3)
    s = np.linalg.svd(x, compute_uv=False)
    assert left == pytest.approx((s[3:] ** 2).sum() / (s**2).sum())
    assert np.linalg.norm(x - x @ directions.T @ directions) ** 2 == pytest.approx((s[3:] ** 2).sum())


def test_codebooks(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0.0, 0.0], [5.0, 5.0], [0.0, 9.0]])
    rows = [([float(x) for x in centres[k % 3] + 0.1 * rng.normal(size=2)], 1.0 + k % 2) for k in range(300)] + [(None, 1.0), ([9.0, 9.0], 0.0)]
    df = spark.createDataFrame(rows, "v array<double>, w double")
    codes = allocation.fit_codebook(df, "v", "w", 3, 12)
    x, w = np.array([v for v, _ in rows[:300]]), np.array([w for _, w in rows[:300]])
    near = ((x[:, None] - codes) ** 2).sum(2).argmin(1)
    for k in set(near.tolist()):
        assert np.allclose(codes[k], np.average(x[near == k], axis=0, weights=w[near == k]))
    got = allocation.nearest(df.filter("v is not null"), codes).collect()
    assert [r.code for r in got[:300]] == near.tolist()
