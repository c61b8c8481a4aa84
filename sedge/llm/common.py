"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.word_cache import forget_all

#: Bytes of text that one chunk or reduce task is planned for; fixes the number of partitions.
TASK_BYTES = 8 << 20

U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the folder from spark.checkpoint.dir; only in local mode, where that is unset, makes one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sedge-checkpoint-"))


@contextlib.contextmanager
def conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Sets SQL settings for a block; a double underscore in a name stands for a dot."""
    old = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder; runs at once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checkpointed_by(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Checkpoint of df, dealt out by keys; later groups by the same keys need no new exchange.

    Adaptive execution hides a plan's partitioning from the checkpoint, so it is off here.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with conf(df.sparkSession, spark__sql__adaptive__enabled="false"):
        return df.repartition(n, *keys).sortWithinPartitions(*keys).checkpoint()


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; reads one column and sends one number per task."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def task_count(spark: SparkSession, n_bytes: int, per_task: int = TASK_BYTES) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // per_task))


def pack(data: bytes | np.ndarray) -> bytes:
    return zstandard.compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes(), 1)


def unpack(blob: bytes) -> bytes:
    return zstandard.decompress(blob, max_output_size=1 << 31)


def pack_longs(a: np.ndarray) -> bytes:
    """Longs by byte plane: equal high bytes then cost almost nothing."""
    return pack(np.ascontiguousarray(a.astype("<i8")).view(np.uint8).reshape(-1, 8).T)


def unpack_longs(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(blob), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (fixed public constants of splitmix64)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_ODD = 0x9E3779B97F4A7C15


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two stretches that follow each other, from theirs; not linear in either."""
    x = a * U64(_ODD)
    x ^= x >> U64(32)
    x += b
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


class Doubled:
    """Hashes of stretches of 64-bit units: those of 2n units are joined of two of n units.

    units are the hashes of every stretch of `base` places.
    """

    def __init__(self, units: np.ndarray, base: int = 1):
        self.levels, self.top = {base: units}, base

    def level(self, length: int) -> int:
        """The largest level of at most this length."""
        while 2 * self.top <= length:
            h, n = self.levels[self.top], self.top
            self.levels[2 * n] = join(h[: max(len(h) - n, 0)], h[n:])
            self.top *= 2
        return max(n for n in self.levels if n <= length)

    def all(self, length: int) -> np.ndarray:
        """Of every stretch of this length."""
        n = self.level(length)
        h = self.levels[n]
        return h if n == length else join(h[: max(len(h) - length + n, 0)], h[length - n :])

    def at(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of one stretch from each start, of at least the base's length."""
        if not len(start):
            return np.zeros(0, U64)
        n = self.level(int(length.min()))
        h = self.levels[n]
        out = h[start]
        for k in range(1, -(-int(length.max()) // n)):
            out = join(out, h[start + np.minimum(k * n, length - n)])
        return join(out, length.astype(U64))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the end."""
    buffer = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", buffer, strides=(1,))


#: Longer stretches of bytes are hashed one by one.
LONG = 256
_FIRST = U64((1 << 64) - 1) >> (U64(64) - np.arange(8, 72, 8).astype(U64))


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, eight at a time."""
    size = ends - starts
    out = mix(size)
    if not len(data):
        return out
    loads = eights(data)
    rows = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(rows):
        left = size[rows] - at
        out[rows] = join(out[rows], loads[starts[rows] + at] & _FIRST[np.minimum(left, 8) - 1])
        rows, at = rows[left > 8], at + 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], pa.Array]:
    """The different stretches of bytes among those given, which come in order and don't overlap, and the place of each stretch's in that list."""
    size = ends - starts
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    flat = data if len(data) == size.sum() else data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]
    found = pa.Array.from_buffers(pa.large_binary(), len(size), buffers).dictionary_encode()
    return sliced(found.dictionary), found.indices


def offsets(a: pa.LargeBinaryArray) -> np.ndarray:
    """Where each value begins in the array's bytes, and the end of the last."""
    return np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)


def sliced(a: pa.LargeBinaryArray) -> list[bytes]:
    """What to_pylist() gives, if nothing is null; several times faster."""
    if not len(a):
        return []
    at = offsets(a)
    line = a.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes()
    at = (at - at[0]).tolist()
    return [line[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], words: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow; memory that it freed goes back to the machine when its task ends, for workers stay.

    words: f remembers words; the tasks of others empty what is remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not words:
            forget_all()
        yield from f(batches)
        release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def parts(b: pa.RecordBatch, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of a batch's rows with about limit bytes of text together, and their texts (null: empty).

    A text counts a few bytes besides its own, so that empty ones don't gather without end.
    """
    texts = [t.as_py() or b"" for t in b.column("text").cast(pa.large_binary())]
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= limit):
            size += len(texts[to]) + 64
            to += 1
        yield b.slice(at, to - at), texts[at:to]
        at = to
