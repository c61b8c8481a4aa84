"""All queries by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A query over the tables of a folder, and SQL with the same result where SQL has it."""

    key: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


REGISTRY: dict[str, Query] = {}
