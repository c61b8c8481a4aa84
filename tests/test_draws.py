"""Weights of resampled clusters against hashlib, and their sums against the sum over every row."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sedge.functions import draws
from sedge.plans.dialect import for_spark, run_sql
from sedge.plans.gates import resampled


def weight(text: bytes) -> int:
    u = int(hashlib.md5(text).hexdigest()[:15], 16) % draws.SCALE
    return sum(u >= t for t in draws.STEPS)


def test_weights_of_any_text():
    units = [None, b"", b"7", b"12345678", "\u00fc:\u00e4".encode(), *(b"q" * k for k in range(40, 260, 3)), *(str(k**3).encode() for k in range(300))]
    got = draws.weights("s", units, 120)
    want = [[0 if u is None else weight(f"s:{r}:".encode() + u) for r in range(120)] for u in units]
    assert got.tolist() == want


@pytest.mark.parametrize("small", [False, True])
def test_sums_of_batches(spark, small):
    rows = [(None if k % 7 == 0 else f"g{k % 7}", k % 2, None if k % 97 == 0 else k // 3, None if k % 5 == 0 or k % 7 == 3 else k * 0.5) for k in range(3000)]
    spark.createDataFrame(rows, "g string, h long, unit long, v double").repartition(3).createOrReplaceTempView("clusters_of_test")
    sql = f"with {resampled('x', 'select * from clusters_of_test', ['g', 'h'], {'n': 'sum(w)', 'x': 'sum(w * v)'}, 12, small)}"
    got = {(r.g, r.h, r.rep): (r.n, r.x) for r in run_sql(spark, "", f"{sql} select * from stat").collect()}
    want: dict = {}
    for g, h, unit, v in rows:
        for rep in range(12):
            w = 0 if unit is None else weight(f"x:{rep}:{unit}".encode())
            n, x = want.get((g, h, rep), (0, None))
            want[g, h, rep] = n + w, x if v is None else (x or 0) + w * v
    assert got == want


@pytest.mark.parametrize("key", ["codebook_bootstrap", "propose_confirm", "keep_stability"])
def test_no_row_for_each_cluster_and_replicate(spark, data, key):
    from sedge.plans.catalog import REGISTRY

    plan = REGISTRY[key].run(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert draws.SUMS in plan and "md5" not in plan


@F.arrow_udf(ArrayType(ArrayType(DoubleType())))
def units_of_batch(unit: pa.Array, seed: pa.Array, replicates: pa.Array, n_keys: pa.Array, *columns: pa.Array) -> pa.Array:
    """Stands for SUMS: how many units a batch has digests for."""
    return pa.array([*[None] * (len(unit) - 1), [[float(len(unit.unique()))]]], pa.list_(pa.list_(pa.float64())))


def test_units_of_many_groups_come_together(spark, data):
    from sedge.plans.catalog import REGISTRY

    rows = [(k % 50, f"u{k * 7919 % 20_000 // 50}", k * 0.25) for k in range(20_000)]
    spark.createDataFrame(rows, "g long, unit string, v double").repartition(3).createOrReplaceTempView("shared_of_test")
    sql = [f"with {resampled('x', 'select * from shared_of_test', ['g'], {'n': 'sum(w)', 'x': 'sum(w * v)'}, 12, shared=of)} select * from stat" for of in (False, True)]
    plain, together = (sorted(tuple(r) for r in run_sql(spark, "", x).collect()) for x in sql)
    assert plain == together and len(plain) == 600
    try:
        spark.udf.register(draws.SUMS, units_of_batch.asNondeterministic())
        n_units = spark.sql(for_spark(sql[1])).agg(F.sum("n")).first()[0]
    finally:
        draws.register(spark)
    assert 400 <= n_units < 600
    for key in "keep_stability", "keep_stability_summary", "mode_gate", "confirmation_gate", "paired_lower_bound":
        plan = REGISTRY[key].run(spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [unit" in plan
