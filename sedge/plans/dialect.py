"""One text for two SQL dialects: `<<spark||other>>` marks where they differ."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from sedge.functions import draws
from sedge.plans.registry import REGISTRY, Query

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_FORK = re.compile(r"<<(.*?)\|\|(.*?)>>", re.S)
_TABLE = re.compile(r"\b(from|join)\s+(" + "|".join(TABLES) + r")\b", re.I)


def sha(x: str) -> str:
    return f"<<sha2({x}, 256)||sha256({x})>>"


def md5_int(x: str) -> str:
    """The first 15 hex digits of md5 as a long."""
    return f"<<cast(conv(substr(md5({x}), 1, 15), 16, 10) as bigint)||cast('0x' || substr(md5({x}), 1, 15) as bigint)>>"


def sha_byte(x: str) -> str:
    """The first byte of sha256 as a long."""
    return f"<<cast(conv(substr(sha2({x}, 256), 1, 2), 16, 10) as bigint)||cast('0x' || substr(sha256({x}), 1, 2) as bigint)>>"


def quantile(x: str, q: float) -> str:
    """Linear interpolation between order statistics."""
    return f"<<percentile({x}, {q})||quantile_cont({x}, {q})>>"


def count_if(x: str) -> str:
    return f"cast(coalesce(sum(case when {x} then 1 else 0 end), 0) as bigint)"


def strip(x: str) -> str:
    """All white space at both ends, not spaces alone."""
    return f"<<regexp_replace({x}, '^\\\\s+|\\\\s+$', '')||regexp_replace({x}, '^\\s+|\\s+$', '', 'g')>>"


def for_spark(sql: str) -> str:
    return _FORK.sub(lambda m: m[1], sql)


def for_oracle(sql: str) -> str:
    return _FORK.sub(lambda m: m[2], sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs the Spark side; the tables that it names become views of this folder's."""
    text = for_spark(sql)
    if draws.NAME in text or draws.SUMS in text:
        draws.register(spark)
    for name in {m[2].lower() for m in _TABLE.finditer(text)}:
        table(spark, sf_dir, name).createOrReplaceTempView(f"sedge_{name}")
    return spark.sql(_TABLE.sub(lambda m: f"{m[1]} sedge_{m[2].lower()}", text))


def sql_query(key: str, sql: str) -> None:
    REGISTRY[key] = Query(key, lambda spark, sf_dir: run_sql(spark, sf_dir, sql), for_oracle(sql))


def same_query(key: str, of: str) -> None:
    """A second name for a query."""
    REGISTRY[key] = replace(REGISTRY[of], key=key)


def frame_query(key: str, oracle: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir), with SQL of the same result where there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        REGISTRY[key] = Query(key, f, oracle and for_oracle(oracle))
        return f

    return put


#: Events as paired measurements: a base and a candidate value, a cluster, a domain and a slot number.
EVENTS = """ev as (
  select event_id, user_id, event_type, value as base,
         value * ((90 + 20 * ((event_id * 7919) % 101) / cast(100 as double)) / 100) as cand,
         cast(<<get_json_object(props, '$.k')||json_extract_string(props, '$.k')>> as bigint) as k, ts
  from events)"""

#: Line items as a candidate ledger by layer and expert.
LEDGER = """led as (
  select l_suppkey as layer, l_partkey as expert, l_orderkey, l_linenumber, l_returnflag as mode_a, l_linestatus as mode_b,
         l_quantity as weight, l_extendedprice as base, l_extendedprice * (1 - l_discount) * (1 + l_tax) as cand
  from lineitem)"""
