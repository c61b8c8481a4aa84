"""Poisson weights of resampled clusters: md5 of many short texts at once, word by word over arrays."""

from __future__ import annotations

from math import exp, factorial, floor, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType

from sedge.shipping import ship

SCALE = 10**9
#: From so many billionths on a draw weighs 1, 2, ...: the distribution of mean one summed up.
STEPS = [round(SCALE * exp(-1) * sum(1 / factorial(j) for j in range(k + 1))) for k in range(12)]
#: The SQL functions' names.
NAME, SUMS = "sedge_draws", "sedge_drawn_sums"
#: Digests that are worked out together: their words stay in the processor's cache.
_CHUNK = 16384
_K = [floor(abs(sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [[(np.array(s, np.uint32), np.array(32 - s, np.uint32)) for s in of] for of in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]
_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))


def _block(state: list, words: list, shape: tuple[int, ...]) -> list[np.ndarray]:
    """State after one block of 16 words: arrays of a shape that broadcasts to `shape`, or numbers."""
    a, b, c, d = (np.broadcast_to(np.asarray(x, np.uint32), shape).copy() for x in state)
    t, f = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        r = i >> 4
        if r == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif r == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) & 15
        elif r == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) & 15
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (7 * i) & 15
        np.add(a, f, out=a)
        number = isinstance(words[g], int)
        np.add(a, np.array((_K[i] + (words[g] if number else 0)) & 0xFFFFFFFF, np.uint32), out=a)
        if not number:
            np.add(a, words[g], out=a)
        left, right = _SHIFTS[r][i & 3]
        np.left_shift(a, left, out=t)
        np.right_shift(a, right, out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [np.add(x, y) for x, y in zip((a, b, c, d), state, strict=True)]


def _uniform(prefixes: list[bytes], units: np.ndarray) -> np.ndarray:
    """The first 15 hex digits of md5(prefix + unit) modulo SCALE, a row per prefix; all have one length, and so have the units (bytes, a row each)."""
    p, (n, length) = len(prefixes[0]), units.shape
    size = p + length
    blocks = (size + 8) // 64 + 1
    head = np.zeros((len(prefixes), blocks * 64), np.uint8)
    head[:, :p] = np.frombuffer(b"".join(prefixes), np.uint8).reshape(len(prefixes), p)
    head[:, size] = 0x80
    head[:, -8:] = np.frombuffer((size * 8).to_bytes(8, "little"), np.uint8)
    tail = np.zeros((n, blocks * 64), np.uint8)
    tail[:, p:size] = units
    head, tail = head.view("<u4").astype(np.uint32), tail.view("<u4").astype(np.uint32)
    shape, state = (len(prefixes), n), list(_START)
    for k in range(0, blocks * 16, 16):
        words = []
        for j in range(k, k + 16):
            of_unit = j * 4 < size and (j + 1) * 4 > p
            words.append(head[:, j, None] | tail[None, :, j] if of_unit else int(head[0, j]) if (head[:, j] == head[0, j]).all() else head[:, j, None])
        state = _block(state, words, shape)
    first = (state[0].byteswap().astype(np.uint64) << np.uint64(28)) | (state[1].byteswap() >> np.uint32(4))
    return (first - first // np.uint64(SCALE) * np.uint64(SCALE)).astype(np.uint32)


def weights(seed: str, units: list[bytes | None], replicates: int) -> np.ndarray:
    """Row per unit, a column per replicate: how many of STEPS md5 of 'seed:replicate:unit' reaches; 0 for null units."""
    out = np.zeros((len(units), replicates), np.int8)
    lengths = np.array([-1 if u is None else len(u) for u in units], np.int64)
    names = [f"{seed}:{r}:".encode() for r in range(replicates)]
    for length in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == length)
        of = np.frombuffer(b"".join(units[i] for i in rows), np.uint8).reshape(len(rows), length)
        for digits in sorted({len(x) for x in names}):
            reps = [r for r, x in enumerate(names) if len(x) == digits]
            wide = min(len(rows), _CHUNK)
            deep = max(1, _CHUNK // wide)
            for i in range(0, len(rows), wide):
                for j in range(0, len(reps), deep):
                    some = reps[j : j + deep]
                    u = _uniform([names[r] for r in some], of[i : i + wide])
                    w = np.zeros(u.shape, np.int8)
                    for t in STEPS:
                        w += u >= np.uint32(t)
                    out[rows[i : i + wide], some[0] : some[-1] + 1] = w.T
    return out


def _of_batch(unit: pa.Array, seed: pa.Array, replicates: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Weights of a batch's different units, each row's place among them, and the number of replicates."""
    n, d = replicates[0].as_py(), unit.dictionary_encode()
    texts = [None if u is None else u.encode() for u in d.dictionary.to_pylist()]
    table = np.concatenate([weights(seed[0].as_py(), texts, n), np.zeros((1, n), np.int8)])  # the last row is the null unit's
    return table, d.indices.fill_null(len(texts)).to_numpy(zero_copy_only=False), n


def _lists(values: pa.Array, size: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size, dtype=np.int32)), values)


@F.arrow_udf(ArrayType(ByteType()))
def draws(unit: pa.Array, seed: pa.Array, replicates: pa.Array) -> pa.Array:
    """The weights of each unit as an array."""
    if not len(unit):
        return pa.array([], pa.list_(pa.int8()))
    table, at, n = _of_batch(unit, seed, replicates)
    return _lists(pa.array(table[at].ravel()), n)


@F.arrow_udf(ArrayType(ArrayType(DoubleType())))
def drawn_sums(unit: pa.Array, seed: pa.Array, replicates: pa.Array, n_keys: pa.Array, *columns: pa.Array) -> pa.Array:
    """Partial sums of a batch: the last row of each key has, for each replicate, the sum of weights and of weight x value of each value; other rows null.

    columns are n_keys keys and then the values. A value that is null in all of a key's rows has a null sum.
    """
    kind = pa.list_(pa.list_(pa.float64()))
    if not len(unit):
        return pa.array([], kind)
    table, at, n = _of_batch(unit, seed, replicates)
    keys, values = columns[: n_keys[0].as_py()], columns[n_keys[0].as_py() :]
    code = np.zeros(len(unit), np.int64)
    for k in keys:
        d = k.dictionary_encode()
        code = np.unique(code * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    w = table[at[order]].astype(float)
    sums = np.empty((len(starts), n, len(values) + 1))
    none = np.zeros(sums.shape, bool)
    sums[:, :, 0] = np.add.reduceat(w, starts)
    for k, v in enumerate(values, 1):
        there = v.is_valid().to_numpy(zero_copy_only=False)[order]
        x = v.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)[order]
        sums[:, :, k] = np.add.reduceat(w * x[:, None], starts)
        none[:, :, k] = (np.add.reduceat(there.astype(np.int64), starts) == 0)[:, None]
    per_key = _lists(_lists(pa.array(sums.ravel(), mask=none.ravel()), len(values) + 1), n)
    place = np.full(len(unit), -1)
    place[np.append(order[starts[1:] - 1], order[-1])] = np.arange(len(starts))
    return per_key.take(pa.array(place, mask=place < 0))


def register(spark: SparkSession) -> None:
    """Makes NAME(unit, seed, replicates) and SUMS(unit, seed, replicates, n_keys, keys..., values...) SQL functions of the session."""
    ship(spark)
    spark.udf.register(NAME, draws)
    spark.udf.register(SUMS, drawn_sums.asNondeterministic())  # so that each batch is summed up once, and whole
