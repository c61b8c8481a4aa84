"""Nearest neighbours over several blocks against every distance."""

from __future__ import annotations

import numpy as np
import pytest

from sedge.operators import neighbours


@pytest.mark.parametrize("odd", [False, True])
def test_nearest_of_blocks(spark, monkeypatch, odd):
    monkeypatch.setattr(neighbours, "ROWS", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(k, None if k % 50 == 9 else k % 2, [float(x) for x in rng.integers(-2, 3, 4) / 4]) for k in range(300)]
    if odd:
        rows += [(400, 1, None), (401, 1, []), (402, 1, [0.25]), (403, 1, [None, 0.5, 0.5, 0.5]), (420, 7, [1.0]), (421, 7, None), (440, 8, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = neighbours.nearest(df.filter("vec_id % 20 = 0"), df, "label", "vec_id", "embedding", 5).collect()
    want = set()
    for q, label, x in rows:
        if q % 20 == 0 and label is not None:
            near = []
            for v, other, y in rows:
                if other == label and v != q:
                    d = [(a - b) ** 2 for a, b in zip(x or [], y or [], strict=False) if a is not None and b is not None]
                    near.append((not d, round(sum(d), 6), v))
            want |= {(q, v, k, None if none else d) for k, (none, d, v) in enumerate(sorted(near)[:5], 1)}
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)
