"""Hashes that Spark SQL lacks, Arrow batch by batch."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def blake2b_128():
    """UDF: hex of the 16-byte blake2b of a text's UTF-8; null stays null."""

    def f(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=16).hexdigest())

    return F.pandas_udf(f, "string")


def big_fold(modulus: int):
    """UDF: the 128-bit big-endian integer of a hex digest, modulo."""

    def f(digest: pd.Series) -> pd.Series:
        return digest.map(lambda x: None if x is None else int(x, 16) % modulus).astype("Int64")

    return F.pandas_udf(f, "long")


def little_fold(modulus: int):
    """UDF: the 64-bit little-endian integer of an 8-byte blake2b of the key's text, modulo."""

    def f(key: pd.Series) -> pd.Series:
        return key.map(lambda k: None if k is None else int.from_bytes(hashlib.blake2b(str(k).encode(), digest_size=8).digest(), "little") % modulus).astype("Int64")

    return F.pandas_udf(f, "long")


def splitmix64(x: np.ndarray) -> np.ndarray:
    """Public splitmix64 step with its fixed constants."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled(rate: int):
    """UDF of (epoch, token): whether splitmix64(epoch xor token) is a multiple of rate; null where either is null."""

    def f(epoch: pd.Series, token: pd.Series) -> pd.Series:
        known = epoch.notna() & token.notna()
        x, y = (c[known].to_numpy(np.int64).view(np.uint64) for c in (epoch, token))
        out = pd.Series(None, index=epoch.index, dtype="boolean")
        out[known] = splitmix64(x ^ y) % np.uint64(rate) == 0
        return out

    return F.pandas_udf(f, "boolean")
