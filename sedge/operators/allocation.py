"""Choices under a budget over tables of any size, and fits from small matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Multipliers that one pass tries at once, and passes: as fine as so many halvings.
FAN, PASSES = 16, 18


def byte_target(items: DataFrame, damage: str, cost: str, target: int) -> DataFrame:
    """One row: multiplier, n_kept, n_bytes, damage, slack of the largest supported choice within target bytes.

    An item is kept while its damage is more than multiplier x cost. Each pass works out FAN
    multipliers by conditional sums over the items and goes on between the last that is over the
    target and the first within it, until one ratio of damage to cost lies there or PASSES are done. All items fit: the multiplier is 0. Items without damage
    or with null costs are never kept; costs are positive. An empty table keeps nothing.
    """
    items = items.select(F.col(damage).cast("double").alias("d"), F.col(cost).cast("double").alias("c")).filter("d > 0 and c > 0").persist()
    try:
        whole = items.agg(F.max(F.col("d") / F.col("c")).alias("high"), F.sum("c").alias("c")).first()
        low, high = 0.0, whole.high or 0.0
        if (whole.c or 0) <= target:
            high = 0.0
        for _ in range(PASSES if high else 0):
            grid = [low + (high - low) * k / FAN for k in range(1, FAN)]
            between = F.when((F.col("d") > low * F.col("c")) & (F.col("d") <= high * F.col("c")), F.col("d") / F.col("c"))
            kept = items.agg(*[F.sum(F.when(F.col("d") > lam * F.col("c"), F.col("c")).otherwise(0.0)).alias(f"k{k}") for k, lam in enumerate(grid)], F.min(between).alias("least"), F.max(between).alias("most")).first()
            if kept.least == kept.most:  # one step of the frontier is left, and it is over the target
                break
            over = [k for k in range(len(grid)) if kept[k] > target]
            low, high = grid[over[-1]] if over else low, grid[over[-1] + 1] if over and over[-1] + 1 < len(grid) else high if over else grid[0]
        ok = F.col("d") > high * F.col("c")
        none = F.lit(0.0)
        r = items.agg(F.sum(F.when(ok, 1).otherwise(0)).alias("n"), F.sum(F.when(ok, F.col("c")).otherwise(none)).alias("c"), F.sum(F.when(ok, F.col("d")).otherwise(none)).alias("d")).first()
    finally:
        items.unpersist()
    row = (float(high), int(r.n or 0), int(r.c or 0), float(r.d or 0), int(target - (r.c or 0)))
    return items.sparkSession.createDataFrame([row], "multiplier double, n_kept long, n_bytes long, damage double, slack long")


def low_rank(gram: np.ndarray, rank: int) -> tuple[np.ndarray, float]:
    """Orthonormal directions (rows) that keep most of a matrix with this Gram matrix, and the share of its energy that they leave."""
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    value = np.maximum(value[::-1], 0)
    return vector[:, ::-1][:, :rank].T, float(value[rank:].sum() / max(value.sum(), np.finfo(float).tiny))


def fit_codebook(rows: DataFrame, vector: str, weight: str, size: int, rounds: int = 8) -> np.ndarray:
    """Code vectors by weighted Lloyd rounds; a round sends `size` sums to the driver.

    Starts from the rows with the smallest hashes that differ; a code that nothing is nearest
    to stays. Ties go to the smaller number. Null vectors and weights of 0 or less are left out.
    """
    v = rows.select(F.col(vector).cast("array<double>").alias("v"), F.col(weight).cast("double").alias("w")).filter("v is not null and w > 0")
    first = v.select("v").distinct().orderBy(F.xxhash64("v"), F.col("v")).limit(size).collect()
    codes = np.array([r.v for r in first])
    for _ in range(rounds if len(codes) else 0):
        place = F.posexplode("v").alias("i", "x")
        sums = nearest(v, codes).select("code", "w", place).groupBy("code", "i").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").alias("w")).collect()
        new = codes.copy()
        for r in sums:
            new[r.code, r.i] = r.s / r.w
        if np.allclose(new, codes, rtol=0, atol=1e-12):
            break
        codes = new
    return codes


def nearest(v: DataFrame, codes: np.ndarray, vector: str = "v") -> DataFrame:
    """v with code and error: the nearest code vector's number and squared distance; the codes are a literal."""
    book = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in codes])
    far = F.transform(book, lambda c, k: F.struct(F.aggregate(F.zip_with(vector, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x).alias("error"), k.alias("code")))
    return v.withColumn("best", F.array_min(far)).select("*", F.col("best.code").alias("code"), F.col("best.error").alias("error")).drop("best")
