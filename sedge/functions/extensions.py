"""Where a user's own code comes in: tokenizers as functions of text batches, and functions for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import hashing
from sedge.shipping import ship

#: Texts to token ids, a batch at a time.
Tokenizer = Callable[[list[str]], list[list[int]]]


def tokens(tokenizer: Tokenizer) -> Callable[[Column | str], Column]:
    """A function of a text column to array<int>, batch by batch; null texts have null tokens.

    The tokenizer is pickled with the query, so it should load its files when it is first called.
    """

    def f(text: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(text), index=text.index, dtype=object)
        known = text.notna()
        if known.any():
            out[known] = pd.Series(tokenizer(text[known].tolist()), index=text.index[known], dtype=object)
        return out

    return F.pandas_udf(f, "array<int>")


def chunks(rows: DataFrame, text: str, size: int, overlap: int = 0) -> DataFrame:
    """rows without the text, once for each chunk of `size` words: chunk (from 0), n_words, words.

    Words are runs of other than white space; a chunk starts size - overlap words after the one before, and
    the last one may be short. Texts without words have no chunk. Built-in functions only.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    w = rows.withColumn("words_", F.filter(F.split(text, r"\s+"), lambda x: x != "")).filter(F.size("words_") > 0)
    last = F.greatest(F.ceil((F.size("words_") - overlap) / step), F.lit(1)).cast("int") - 1
    w = w.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    w = w.withColumn("words", F.slice("words_", F.col("chunk") * step + 1, size))
    return w.select(*[c for c in rows.columns if c != text], F.col("chunk").cast("long").alias("chunk"), F.size("words").cast("long").alias("n_words"), "words")


def register(spark: SparkSession, **tokenizers: Tokenizer) -> None:
    """Makes blake2b_128(text), sampled_16(epoch, token) and each named tokenizer callable from SQL."""
    ship(spark)
    spark.udf.register("blake2b_128", hashing.blake2b_128())
    spark.udf.register("sampled_16", hashing.sampled(16))
    for name, t in tokenizers.items():
        spark.udf.register(name, tokens(t))
