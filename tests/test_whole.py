"""Queries over whole tables and whole vectors, against plain computations."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import defaultdict

import numpy as np
import pytest

from sedge.plans.catalog import REGISTRY


@pytest.fixture(scope="module")
def rows(spark, data):
    return lambda name: spark.read.parquet(f"{data}/{name}.parquet").collect()


def test_identity_of_all_documents(spark, tmp_path):
    texts = [(k, "same" if k != 900 else "other", "s") for k in range(1000)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = REGISTRY["identity_compare_whole"].run(spark, str(tmp_path)).collect()
    assert [(r.source, r.status, r.n) for r in got] == [("s", "different", 1000)]


def test_overlap_of_all_sources(spark, data, rows):
    of = defaultdict(set)
    for r in rows("documents"):
        of[r.source].add(hashlib.sha256(r.text.encode()).digest())
    got = {(r.left_source, r.right_source): r.n_shared for r in REGISTRY["pairwise_overlap_whole"].run(spark, data).collect()}
    assert got == {(a, b): len(of[a] & of[b]) for a, b in itertools.combinations(sorted(of), 2)}
    assert len(of) > 6


def test_route_overlap_of_all_events(spark, data, rows):
    sets = defaultdict(lambda: (set(), set()))
    for r in rows("events"):
        k = int(json.loads(r.props)["k"])
        a, b = sets[r.user_id, r.event_type]
        a.add(k)
        b.add((k + 7) % 100 if r.event_id * 31 % 10 == 0 else k)
    got = REGISTRY["topk_overlap_whole"].run(spark, data).collect()
    assert {r.event_type for r in got} == {t for _, t in sets}
    for r in got:
        of = [ab for (_, t), ab in sets.items() if t == r.event_type]
        assert r.overlap == pytest.approx(sum(len(a & b) / len(a) for a, b in of) / len(of), abs=1e-8)
        assert r.jaccard == pytest.approx(sum(len(a & b) / len(a | b) for a, b in of) / len(of), abs=1e-8)
        assert r.n_equal == sum(a == b for a, b in of)


def test_all_components(spark, data, rows):
    e = rows("embeddings")
    x, label, ids = np.array([r.embedding for r in e], float), np.array([r.label for r in e]), np.array([r.vec_id for r in e])
    w, d = 1.0 + ids % 3, x.shape[1]
    run = lambda k: REGISTRY[k].run(spark, data).collect()
    grams = {g: (x[label == g] * w[label == g][:, None]).T @ x[label == g] / w[label == g].sum() for g in set(label.tolist())}
    cells = run("weighted_gram_whole")
    assert len(cells) == len(grams) * d * d
    assert all(abs(r.g - grams[r.label][r.i, r.j]) < 1e-6 for r in cells)
    scale = np.arange(1, d + 1) * 0.1
    assert all(r.sse == pytest.approx(scale @ grams[r.label] @ scale, abs=1e-5) for r in run("sse_from_gram_whole"))
    for r in run("oas_shrinkage_whole"):
        g, v = grams[r.label], w[label == r.label]
        n, tr, tr2 = v.sum() ** 2 / (v**2).sum(), np.trace(g), (g**2).sum()
        assert r.alpha == pytest.approx(min(1, ((1 - 2 / d) * tr2 + tr**2) / ((n + 1 - 2 / d) * (tr2 - tr**2 / d))), abs=1e-6)
        assert r.mean_diagonal == pytest.approx(tr / d, abs=1e-6)
    even, odd = x[ids % 2 == 0], x[ids % 2 == 1]
    a, b = even.T @ even / len(even), odd.T @ odd / len(odd)
    (r,) = run("covariance_comparison_whole")
    assert (r.trace_ratio, r.relative_frobenius) == pytest.approx((np.trace(b) / np.trace(a), np.linalg.norm(a - b) / np.linalg.norm(a)), abs=1e-6)
    cosine = lambda p, q: (p * q).sum() / np.linalg.norm(p) / np.linalg.norm(q)
    (r,) = run("component_cosines_whole")
    one = np.eye(d)
    assert (r.total, r.off_diagonal, r.trace_removed) == pytest.approx((cosine(a, b), cosine(a * (1 - one), b * (1 - one)), cosine(a - one * np.trace(a) / d, b - one * np.trace(b) / d)), abs=1e-6)
    p, q = even.mean(0), odd.mean(0)
    (r,) = run("split_shrinkage_whole")
    assert (r.cross_power, r.noise) == pytest.approx((p @ q, (p @ p + q @ q) / 2 - p @ q), abs=1e-6)
    split = {r.vec_id: (r.radial, r.tangential) for r in run("radial_tangential_whole")}
    assert len(split) == len(e)
    for k, i in enumerate(ids.tolist()):
        c = x[label == label[k]].mean(0)
        t = x[k] - c
        radial = (t @ c) ** 2 / (c @ c)
        assert split[i] == pytest.approx((radial, t @ t - radial), abs=2e-6)
    cells = run("gram_partial_merge_whole")
    assert len(cells) == len(grams) * d * d
    assert all(abs(r.g - (x[label == r.label].T @ x[label == r.label])[r.i - 1, r.j - 1]) < 1e-3 for r in cells)


def test_whole_passages(spark, tmp_path):
    opening = "an opening of more than eighty characters that several of the passages here have in common, "
    passages = ["hi", "two words", opening + "one end", opening + "another end", opening + "one end", "", None, " led by a blank and six more words ", "a\tb c d e f g h"]
    texts = [opening + "no end", "say " + opening + "one end and " + opening + "another end", "sohighly", "xtwo wordsy", "filled by a blank and six more words or so", "it is led by a blank and six more words or so", "xa\tb c d e f g hx", "a b c d e f g h", "", None]
    docs = [*enumerate(texts), (1, texts[1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*enumerate(passages)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = defaultdict(int)
    for k, t in docs:
        want[k] += sum(p in (t or "") for p in {p for p in passages if p})
    got = {r.doc_id: r.n_passages for r in REGISTRY["exclude_prior_contains_whole"].run(spark, str(tmp_path)).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_passages_of_any_length(spark):
    import random

    from sedge.plans.custom import passages_in

    rng, words = random.Random(1), ["a", "bb", "ccc", "dd dd", "e.", "f"]
    line = lambda low, high: " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))
    docs = [(k, line(0, 14)) for k in range(100)] + [(300, None), (301, ""), (0, "bb ccc")]
    passages = [line(1, 9) for _ in range(40)] + ["cc", "c", "b", "c d", "e. f", "", "  ", None, "zz top"]
    want = defaultdict(int)
    for d, t in docs:
        want[d] += sum(p in (t or "") for p in {p for p in passages if p})
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in passages], "text string")
    assert {r.doc_id: r.n_passages for r in passages_in(d, p).collect()} == {k: n for k, n in want.items() if n}
    assert passages_in(d, p.limit(0)).count() == passages_in(d.limit(0), p).count() == 0


def test_weights_are_poisson(spark, data):
    from sedge.plans.dialect import EVENTS, run_sql
    from sedge.plans.gates import resampled

    sql = f"with {EVENTS}, {resampled('x', 'select user_id as unit from ev group by user_id', [], {'n': 'sum(w)'}, 400)} select w, count(*) as n from drawn group by w"
    n = {r.w: r.n for r in run_sql(spark, data, sql).collect()}
    total = sum(n.values())
    assert abs(n[0] / total - 0.3679) < 0.01 and abs(n[2] / total - 0.1839) < 0.01 and abs(sum(k * v for k, v in n.items()) / total - 1) < 0.02


def test_verdicts(spark, tmp_path):
    """Clear gains, clear losses, noise and a domain that is worse, against the rules in words."""
    from sedge.plans.dialect import run_sql
    from sedge.plans.gates import paired_verdict

    def verdict(rows):
        spark.createDataFrame(rows, "domain string, unit long, b double, c double").createOrReplaceTempView("pairs")
        got = {r.domain: r for r in run_sql(spark, str(tmp_path), "with " + paired_verdict("select domain, unit, b, c from pairs", 0.0, 0.01)).collect()}
        return got["all"].verdict, {k: r.status for k, r in got.items()}

    better = [(d, k, 1.0 + 0.001 * k, 0.9) for d in "xy" for k in range(20)]
    assert verdict(better) == ("pass", dict.fromkeys(["all", "x", "y"], "improvement_supported"))
    assert verdict([(d, k, c, b) for d, k, b, c in better])[0] == "fail"
    assert verdict(better + [("z", k, 0.9, 1.0 + 0.001 * k) for k in range(5)])[0] == "fail"
    assert verdict([(d, k, b, b - 0.001) for d, k, b, _ in better])[0] == "repeat_required"
    assert verdict([("x", k, 1.0, 1.0 + (-1) ** k * 0.1) for k in range(30)]) == ("repeat_required", {"all": "inconclusive", "x": "inconclusive"})
