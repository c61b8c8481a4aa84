"""Places, running sums and exact quantiles within groups of any size, in two levels.

Rows are dealt by ranges of (group, order), so a group that holds a third of a table lies in
many ranges. Each range counts and sums its own rows; the ranges' totals, a few numbers each,
are summed up over the ranges before; the two levels together give every row its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.streaming.events import shared_folder


def placed(rows: DataFrame, keys: list[str], order: list[Column | str], value: str | None = None) -> DataFrame:
    """rows with place (1 for a group's first row), n (rows of the group) and, with a value, before (sum of it over earlier rows).

    order must tell all rows of a group apart, or equal rows take places in any order. Null
    keys are a group. The dealt rows are written once to the checkpoint folder.
    """
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(rows.sparkSession))
    n_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n_tasks, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = dealt.withColumn("part_", F.spark_partition_id()).withColumn("id_", F.monotonically_increasing_id()).checkpoint()
    sums = [F.sum(value).alias("sum_")] if value else []
    totals = dealt.groupBy(*keys, "part_").agg(F.min("id_").alias("first_"), F.count(F.lit(1)).alias("count_"), *sums)
    earlier = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    more = [F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("sum_before_")] if value else []
    totals = totals.select(*[F.col(k).alias(f"{k}_key_") for k in keys], F.col("part_").alias("of_"), "first_", F.coalesce(F.sum("count_").over(earlier), F.lit(0)).alias("rows_before_"), F.sum("count_").over(Window.partitionBy(*keys)).alias("n"), *more)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_key_")) for k in keys]
    out = dealt.join(totals, [dealt["part_"] == totals["of_"], *same])
    place = (F.col("id_") - F.col("first_") + F.col("rows_before_") + 1).alias("place")
    if not value:
        return out.select(*rows.columns, place, "n")
    w = Window.partitionBy("part_", *keys).orderBy("id_").rowsBetween(Window.unboundedPreceding, -1)
    before = (F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col("sum_before_")).alias("before")
    return out.select(*rows.columns, place, "n", before)


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Row per group: the keys and each named quantile, linear between order statistics.

    Null values are left out; a group without others has no row.
    """
    p = placed(rows.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null"), keys, ["v"])
    at = lambda q: (F.col("n") - 1) * F.lit(q)
    ends = [F.struct(F.lit(name).alias("name"), (at(q) - F.floor(at(q))).alias("part"), F.floor(at(q)).alias("low")) for name, q in shares.items()]
    wanted = p.withColumn("e", F.explode(F.array(*ends))).filter((F.col("place") - 1 == F.col("e.low")) | ((F.col("place") - 2 == F.col("e.low")) & (F.col("e.part") > 0)))
    weight = F.when(F.col("place") - 1 == F.col("e.low"), 1 - F.col("e.part")).otherwise(F.col("e.part"))
    return wanted.groupBy(*keys).agg(*[F.sum(F.when(F.col("e.name") == name, weight * F.col("v"))).alias(name) for name in shares])
