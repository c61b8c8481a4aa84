"""Exact nearest neighbours by blocks: a matrix product finds candidates, plain sums in order decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block of rows, and of a block of queries; queries of one product.
ROWS, QUERIES, AT_ONCE = 4096, 4096, 256
#: Distances are compared after rounding to so many digits.
DIGITS = 6


def _padded(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Components as doubles, 0 where there is none, and whether there is one."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    there = np.arange(width) < lengths[:, None]
    flat, x = vectors.flatten(), np.zeros(there.shape)
    x[there] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    there[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    return x, there


def _distances(x: np.ndarray, y: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, summed in order of components."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        d = x[:, k] - y[:, k]
        total += np.where(both[:, k], d * d, 0.0)
    return total


def _first(total: np.ndarray, none: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of all pairs that may be among the k nearest of one query after rounding; of equal distances the first k ids."""
    order = np.lexsort((ids, total, none))
    t, n = total[order], none[order]
    new = np.append(True, (n[1:] != n[:-1]) | ~((t[1:] == t[:-1]) | (np.isnan(t[1:]) & np.isnan(t[:-1])) | n[1:]))
    run = np.flatnonzero(new)
    near = np.arange(len(t)) - run[np.cumsum(new) - 1] < k
    if len(t) > k and not n[k - 1] and np.isfinite(t[k - 1]):
        near &= ~n & (t <= t[k - 1] + 2 * 10.0**-DIGITS)
    return order[near]


def nearest(queries: DataFrame, rows: DataFrame, group: str, key: str, vector: str, k: int) -> DataFrame:
    """Row per query and neighbour: query_id, the key, place, dist (squared, rounded) of the k nearest other keys of the query's group.

    Blocks of queries meet blocks of rows, each pair in a task of bounded size; ties go to the
    smaller key. A component that is null or missing on either side counts nothing; without any the
    distance is null and comes last. Rows of a null group are left out.
    """
    queries, rows = (d.select(F.col(group), F.col(key).cast("long").alias(key), F.col(vector).cast("array<float>").alias(vector)).filter(F.col(group).isNotNull()) for d in (queries, rows))
    largest = lambda d: (d.groupBy(group).count().agg(F.max("count")).first()[0] or 0)
    n_q, n_r = max(1, -(-largest(queries) // QUERIES)), max(1, -(-largest(rows) // ROWS))
    deal = lambda n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("q_", deal(n_q).cast("int")).withColumn("r_", every(n_r))
    e = rows.withColumn("r_", deal(n_r).cast("int")).withColumn("q_", every(n_q))

    def f(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        if a.num_rows and b.num_rows:
            va, vb = (t.column(vector).combine_chunks() for t in (a, b))
            va, vb = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in (va, vb))
            width = max(int(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max()) for v in (va, vb))
            (x, in_x), (y, in_y) = _padded(va, width), _padded(vb, width)
            qs, es = (np.asarray(t.column(key).to_numpy(), np.int64) for t in (a, b))
            plain = width and in_x.all() and in_y.all() and np.isfinite(x).all() and np.isfinite(y).all()
            yy, xx = (y * y).sum(1), (x * x).sum(1)
            error = 1e-12 * (width + 1) * (yy.max() + xx.max()) + 2 * 10.0**-DIGITS if plain else 0
            for at in range(0, len(qs), AT_ONCE):
                if plain:
                    near = xx[at : at + AT_ONCE, None] + yy - 2 * (x[at : at + AT_ONCE] @ y.T)
                    near[qs[at : at + AT_ONCE, None] == es] = np.inf
                    bar = np.partition(near, k - 1, axis=1)[:, k - 1] + error if near.shape[1] > k else np.full(len(near), np.finfo(float).max)
                    near = near <= bar[:, None]
                for i in range(at, min(at + AT_ONCE, len(qs))):
                    some = np.flatnonzero(near[i - at] if plain else es != qs[i])
                    some = some[es[some] != qs[i]]
                    if len(some):
                        both = in_x[i] & in_y[some]
                        total, none = _distances(np.broadcast_to(x[i], (len(some), width)), y[some], both), ~both.any(1)
                        first = _first(total, none, es[some], k)
                        out.append((np.full(len(first), qs[i]), es[some][first], total[first], none[first]))
        query, ids, dist, none = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        return pa.table({"query_id": query, key: ids, "dist": pa.array(dist, pa.float64(), mask=none)})

    by = [group, "q_", "r_"]
    found = q.groupBy(*by).cogroup(e.groupBy(*by)).applyInArrow(f, f"query_id long, {key} long, dist double").withColumn("dist", F.round("dist", DIGITS))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("dist").asc_nulls_last(), key)).cast("long")
    return found.withColumn("place", place).filter(F.col("place") <= k).select("query_id", key, "place", "dist")
