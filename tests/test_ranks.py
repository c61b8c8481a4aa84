"""Places, running sums and quantiles over ranges against plain computations."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from sedge.operators.ranks import placed, quantiles


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    # one group holds most rows, one has a null key, values tie
    return [(k, rng.choice(["a"] * 8 + ["b", None]), rng.randint(0, 9), rng.random()) for k in range(500)]


def test_places_and_sums(spark, rows):
    df = spark.createDataFrame(rows, "k long, g string, v long, x double")
    got = {r.k: (r.place, r.n, r.before) for r in placed(df, ["g"], ["v", "k"], "v").collect()}
    groups = defaultdict(list)
    for k, g, v, _ in rows:
        groups[g].append((v, k))
    for members in groups.values():
        total = 0
        for place, (v, k) in enumerate(sorted(members), 1):
            assert got[k] == (place, len(members), total)
            total += v
    assert placed(df.limit(0), ["g"], ["v"], "v").count() == 0


def test_quantiles_are_exact(spark, rows):
    df = spark.createDataFrame(rows + [(900, "a", 1, None), (901, "none", 1, None)], "k long, g string, v long, x double")
    for value in ("v", "x"):
        shares = {f"q{i}": q for i, q in enumerate((0.0, 0.01, 0.5, 0.977, 1.0))}
        got = {r.g: r for r in quantiles(df, ["g"], value, shares).collect()}
        for g in ("a", "b", None):
            x = [float(r[2 if value == "v" else 3]) for r in rows if r[1] == g] + ([1.0] if value == "v" and g == "a" else [])
            assert [got[g][k] for k in shares] == pytest.approx(np.quantile(x, list(shares.values())).tolist())
        assert ("none" in got) == (value == "v")


def test_panel_of_any_layers(spark, tmp_path):
    """Few experts, many, repeated and null ones: the first two by hash, found without sorting the others."""
    import hashlib

    from sedge.plans.catalog import REGISTRY

    rows = [(layer, expert) for layer in (*range(40), None) for expert in [None, *range(layer or 7)] * 2]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = REGISTRY["hash_order_panel"].run(spark, str(tmp_path))
    text = lambda x: "" if x is None else str(x)
    digest = lambda r: hashlib.sha256(f"7:{text(r[0])}:{text(r[1])}".encode()).hexdigest()
    want = {(*r, k) for layer in (*range(40), None) for k, r in enumerate(sorted({r for r in rows if r[0] == layer}, key=digest)[:2], 1)}
    assert {tuple(r) for r in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("<=>") > plan.index("Window")  # rows are let go below the sort
