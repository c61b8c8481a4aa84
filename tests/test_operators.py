from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pytest

from sedge.functions import hashing
from sedge.operators import moments, scheduling
from sedge.sources import tensors


def test_knapsack_is_the_best_of_all_choices(spark):
    rng = np.random.default_rng(1)
    rows = [(g, k, int(rng.integers(-5, 30)), int(rng.integers(1, 12))) for g in range(6) for k in range(7)]
    df = spark.createDataFrame(rows, "g long, item long, gain long, cost long")
    got = {r.g: r for r in scheduling.knapsack(df, "g", "item", "gain", "cost", 20).collect()}
    for g in range(6):
        items = [r for r in rows if r[0] == g]
        best = max(sum(r[2] for r in c) for n in range(8) for c in itertools.combinations(items, n) if sum(r[3] for r in c) <= 20)
        assert got[g].gain == best
        assert sum(r[2] for r in items if r[1] in got[g]["items"]) == best
        assert got[g].cost == sum(r[3] for r in items if r[1] in got[g]["items"]) <= 20


def test_knapsack_of_large_groups(spark):
    """Every choice is tried by plain recursion over all items, which also fixes ties; parts of a group are let go."""
    rng = np.random.default_rng(2)
    rows = [(g, k, int(rng.integers(-3, 9)), int(rng.integers(0, 9))) for g in (None, -1, 0, 7) for k in rng.permutation(1500 if g == 0 else 40).tolist()]
    got = {r.g: r for r in scheduling.knapsack(spark.createDataFrame(rows, "g long, item long, gain long, cost long"), "g", "item", "gain", "cost", 25, 50).collect()}
    assert set(got) == {None, -1, 0, 7}
    for g, r in got.items():
        items = sorted(x[1:] for x in rows if x[0] == g)
        best = [[0] * 26]
        for _, gain, cost in reversed(items):
            best.append([max(best[-1][b], best[-1][b - cost] + gain if cost <= b else 0) for b in range(26)])
        left, chosen = 25, []
        for k, (item, gain, cost) in enumerate(items):
            rest = best[len(items) - k - 1]
            if gain > 0 and cost <= left and rest[left - cost] + gain >= rest[left]:
                chosen.append(item)
                left -= cost
        assert (r.gain, r.cost, r["items"]) == (best[-1][25], 25 - left, chosen)
    held = rng.integers(0, 25, (3, 20000))
    assert len(scheduling._may_matter(held[0], held[1], held[2] + 1, 25)) <= sum(25 // c for c in range(1, 26))


def test_batches_close_before_the_cap(spark):
    df = spark.createDataFrame([("a", 1, 6), ("a", 2, 5), ("a", 3, 5), ("a", 4, 40), ("a", 5, 1)], "s string, d long, n long")
    got = [r.batch for r in scheduling.token_batches(df, "s", "d", "n", 10).orderBy("d").collect()]
    assert got == [0, 1, 1, 2, 3]


def test_partitions_cover_all_documents(spark):
    df = spark.createDataFrame([("a", k, 1 + k % 5) for k in range(30)], "s string, d long, n long")
    got = scheduling.balanced_partitions(df, "s", "d", "n", 4).orderBy("part").collect()
    assert got[0]["first"] == 0 and got[-1].stop == 30
    assert all(a.stop == b["first"] for a, b in itertools.pairwise(got))
    assert sum(r.tokens for r in got) == sum(1 + k % 5 for k in range(30))


def test_longest_first(spark):
    df = spark.createDataFrame([(1, k, c) for k, c in enumerate([7, 6, 5, 4, 3])], "g long, item long, cost long")
    load = {}
    for r in scheduling.longest_first(df, "g", "item", "cost", 2).collect():
        load[r.worker] = load.get(r.worker, 0) + [7, 6, 5, 4, 3][r["item"]]
    assert sorted(load.values()) == [11, 14]


def test_gram_merges_partials(spark):
    x = np.random.default_rng(2).normal(size=(40, 3))
    df = spark.createDataFrame([(k % 2, x[k].tolist(), float(k % 3 + 1)) for k in range(40)], "g long, v array<double>, w double").repartition(5)
    for r in moments.gram(df, "g", "v", "w").collect():
        at = [k for k in range(40) if k % 2 == r.g]
        w = np.array([k % 3 + 1 for k in at])
        assert np.allclose(np.array(r.gram).reshape(3, 3), (x[at] * w[:, None]).T @ x[at])
        assert r.weight_sum == w.sum() and r.n_rows == len(at)


def test_hashes(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    got = [r.h for r in df.select(hashing.blake2b_128()("t").alias("h")).collect()]
    assert got == [hashlib.blake2b(b"a", digest_size=16).hexdigest(), None]
    assert int(hashing.splitmix64(np.array([0]))[0]) == 0xE220A8397B1DCDAF


def test_tensor_files_round_trip(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(4, 3)
    data = tensors.encode({"a": a, "b": np.array([1, 2], np.int64)})
    assert np.array_equal(tensors.tensor_of(data, "a"), a)
    with pytest.raises(ValueError):
        tensors.header_of(data[:-1])
    spark.dataSource.register(tensors.TensorSource)
    rows = [("f", "a", k, [float(k), 2.0]) for k in range(5)]
    df = spark.createDataFrame(rows, "file string, tensor string, row long, values array<double>").coalesce(1)
    df.write.format("tensors").option("path", str(tmp_path / "out")).mode("append").save()
    got = spark.read.format("tensors").option("path", str(tmp_path / "out")).option("rows", 2).load()
    assert got.rdd.getNumPartitions() == 3
    assert [(r.row, r["values"]) for r in got.orderBy("row").collect()] == [(k, [float(k), 2.0]) for k in range(5)]


def test_values_of_queries_without_sql(spark, data):
    """Hash samples, folds, ridge fits and seeded intervals against plain computations over whole tables."""
    import json

    from sedge.plans.catalog import REGISTRY

    rows = lambda name: spark.read.parquet(f"{data}/{name}.parquet").collect()
    run = lambda key: REGISTRY[key].run(spark, data).collect()
    ev = rows("events")
    mixed = hashing.splitmix64(np.array([r.user_id ^ r.event_id for r in ev]))
    assert sorted((r.event_id, r.user_id) for r in run("hash_sample")) == sorted((r.event_id, r.user_id) for r, x in zip(ev, mixed.tolist(), strict=True) if x % 16 == 0)
    for r, d in zip(sorted(run("content_hash_folds"), key=lambda r: r.doc_id), sorted(rows("documents"), key=lambda r: r.doc_id), strict=True):
        digest = hashlib.blake2b(d.text.encode(), digest_size=16).hexdigest()
        side = int.from_bytes(hashlib.blake2b(str(d.doc_id).encode(), digest_size=8).digest(), "little") % 3
        assert (r.doc_id, r.digest, r.fold, r.side) == (d.doc_id, digest, int(digest, 16) % 8, side)
    e = rows("embeddings")
    for r in run("ridge_from_gram"):
        x = np.array([v.embedding for v in e if v.label == r.label], float)
        m = x.T @ x
        want = np.linalg.solve(m[1:, 1:] + 0.01 * np.trace(m) / len(m) * np.eye(len(m) - 1), m[1:, 0])
        assert np.allclose(r.coefficients, want)
    sums: dict = {}
    for r in ev:
        t = sums.setdefault(r.event_type, {}).setdefault(r.user_id, [0.0, 0.0])
        t[0] += r.value
        t[1] += r.value * ((90 + 20 * ((r.event_id * 7919) % 101) / 100) / 100)
        assert json.loads(r.props)["k"] is not None
    for r in run("bootstrap_exact_seed"):
        b, c = np.array([sums[r.event_type][u] for u in sorted(sums[r.event_type])]).T
        pick = np.random.default_rng(1234).integers(0, len(b), (2000, len(b)))
        x = 1 - c[pick].sum(1) / b[pick].sum(1)
        assert np.allclose([r.improvement, r.low, r.high, r.share_positive], [1 - c.sum() / b.sum(), *np.quantile(x, [0.025, 0.975]), (x > 0).mean()])


def test_hash_samples_pass_nulls_on(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (1, None)], "a long, b long")
    got = [r.s for r in df.select(hashing.sampled(1)("a", "b").alias("s")).collect()]
    assert got == [True, None, None]


def test_ridge_of_zeros(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.0])], "g long, v array<double>")
    (r,) = moments.ridge(moments.gram(df, "g", "v"), "g", 0, 0.01).collect()
    assert r.coefficients == [0.0, 0.0]


def test_descent_ends_where_no_single_change_helps(spark):
    rng = np.random.default_rng(5)
    rows = [(g, i, m, float(rng.normal()), float(m * rng.integers(1, 4))) for g in range(4) for i in range(5) for m in range(3)]
    df = spark.createDataFrame(rows, "g long, item long, mode long, v double, c double")
    by = {(g, i, m): (v, c) for g, i, m, v, c in rows}
    cost = lambda g, modes: sum(by[g, i, m][0] for i, m in enumerate(modes)) ** 2 + 0.05 * sum(by[g, i, m][1] for i, m in enumerate(modes))
    got = scheduling.descend(df, "g", "item", "mode", "v", "c", 0.05).collect()
    for g in range(4):
        mine = sorted((r["item"], r.mode, r.objective) for r in got if r.g == g)
        modes = [m for _, m, _ in mine]
        assert mine[0][2] == pytest.approx(cost(g, modes))
        assert all(cost(g, modes[:i] + [m] + modes[i + 1 :]) >= cost(g, modes) - 1e-12 for i in range(5) for m in range(3))
        assert cost(g, modes) <= min(cost(g, [m] * 5) for m in range(3)) + 1e-12


def test_chunks_and_tokenizers(spark):
    from sedge.functions import extensions

    df = spark.createDataFrame([(1, " a b  c d\ne "), (2, ""), (3, None), (4, "x")], "k long, t string")
    got = sorted((r.k, r.chunk, r.n_words, list(r["words"])) for r in extensions.chunks(df, "t", 3, 1).collect())
    assert got == [(1, 0, 3, ["a", "b", "c"]), (1, 1, 3, ["c", "d", "e"]), (4, 0, 1, ["x"])]
    lengths = lambda texts: [[len(w) for w in t.split()] for t in texts]
    assert {r.k: r.n for r in df.select("k", extensions.tokens(lengths)("t").alias("n")).collect()} == {1: [1] * 5, 2: [], 3: None, 4: [1]}
    extensions.register(spark, word_lengths=lengths)
    assert spark.sql("select word_lengths('ab c') as n, blake2b_128('a') as h").first().n == [2, 1]
