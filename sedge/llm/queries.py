"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedge.llm.curve_packing import op1_curve_packing
from sedge.llm.embedding_dedup import op9_embedding_dedup
from sedge.llm.language_id import op10_language_id
from sedge.llm.media_columns import op8_media_columns
from sedge.llm.minhash_dedup import op6_minhash_dedup
from sedge.llm.oracles import ORACLES
from sedge.llm.piece_codec import op4_piece_codec
from sedge.llm.quality_crf import op5_quality_crf
from sedge.llm.secret_scan import op2_secret_scan
from sedge.llm.substring_dedup import op3_substring_dedup
from sedge.llm.suffix_dedup import op7_suffix_dedup
from sedge.shipping import ship

_ALL = [op1_curve_packing, op2_secret_scan, op3_substring_dedup, op4_piece_codec, op5_quality_crf, op6_minhash_dedup, op7_suffix_dedup, op8_media_columns, op9_embedding_dedup, op10_language_id]


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
