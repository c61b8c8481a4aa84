"""Mergeable sufficient statistics of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(rows: DataFrame, group: str, vector: str, weight: str | None = None) -> DataFrame:
    """Row per group: group, dim, weight_sum, weight_square_sum, n_rows, gram (row-major array of sums w x x').

    Each task passes on one partial matrix a group, and the final step adds matrices: vectors
    never move. Rows with a null group or vector are left out.
    """
    cols = rows.filter(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).cast("long").alias("group"), F.col(vector).cast("array<double>").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    schema = "group long, dim int, weight_sum double, weight_square_sum double, n_rows long, gram array<double>"

    def rows_of(state: dict) -> Iterator[pa.RecordBatch]:
        keys = sorted(state)
        yield pa.RecordBatch.from_pydict(
            {
                "group": pa.array([k[0] for k in keys], pa.int64()),
                "dim": pa.array([k[1] for k in keys], pa.int32()),
                "weight_sum": pa.array([state[k][0] for k in keys], pa.float64()),
                "weight_square_sum": pa.array([state[k][1] for k in keys], pa.float64()),
                "n_rows": pa.array([state[k][2] for k in keys], pa.int64()),
                "gram": pa.array([state[k][3].ravel() for k in keys], pa.list_(pa.float64())),
            }
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            v, w, g = b.column("v"), b.column("w").to_numpy(zero_copy_only=False), b.column("group").to_numpy(zero_copy_only=False)
            sizes = np.diff(v.offsets.to_numpy())
            flat, begin = v.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))[:-1]
            for key in {*zip(g.tolist(), sizes.tolist(), strict=True)}:
                at = np.flatnonzero((g == key[0]) & (sizes == key[1]))
                x = flat[begin[at][:, None] + np.arange(key[1])]
                add = (w[at].sum(), (w[at] ** 2).sum(), len(at), (x * w[at][:, None]).T @ x)
                old = state.get(key)
                state[key] = add if old is None else tuple(a + c for a, c in zip(old, add, strict=True))
        yield from rows_of(state)

    def final(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for r in b.to_pylist():
                add = (r["weight_sum"], r["weight_square_sum"], r["n_rows"], np.array(r["gram"]))
                total = add if total is None else tuple(a + c for a, c in zip(total, add, strict=True))
        yield from rows_of({(key[0].as_py(), key[1].as_py()): total})

    return cols.mapInArrow(partial, schema).groupBy("group", "dim").applyInArrow(final, schema).withColumnRenamed("group", group)


def ridge(grams: DataFrame, group: str, target: int, penalty: float) -> DataFrame:
    """Row per group: coefficients of component `target` on the others, from the Gram matrix alone.

    A matrix without a single solution, such as all zeros, gets the one of the least norm.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, g in zip(b["dim"], b["gram"], strict=True):
                m = np.array(g).reshape(d, d)
                rest = [i for i in range(d) if i != target]
                a = m[np.ix_(rest, rest)] + penalty * np.trace(m) / d * np.eye(d - 1)
                out.append(np.linalg.lstsq(a, m[rest, target], rcond=None)[0])
            yield pd.DataFrame({group: b[group], "coefficients": out})

    return grams.select(group, "dim", "gram").mapInPandas(solve, f"{group} long, coefficients array<double>")
