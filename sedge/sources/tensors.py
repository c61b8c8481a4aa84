"""Tensor files: eight bytes of header length, a JSON header, raw little-endian data.

`encode` and `decode_*` work on bytes in columns, so that any store Spark reads will do; the
data source reads and writes files of the format by path.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Types of the format that numpy has, by name (fixed values).
TYPES = {"BOOL": "?", "U8": "u1", "I8": "i1", "I16": "<i2", "I32": "<i4", "I64": "<i8", "F16": "<f2", "F32": "<f4", "F64": "<f8"}


def encode(tensors: dict[str, np.ndarray]) -> bytes:
    names = {np.dtype(v).str.lstrip("<|"): k for k, v in TYPES.items()}
    header, at, parts = {}, 0, []
    for name, a in sorted(tensors.items()):
        data = np.ascontiguousarray(a).tobytes()
        header[name] = {"dtype": names[a.dtype.str.lstrip("<|")], "shape": list(a.shape), "data_offsets": [at, at + len(data)]}
        at += len(data)
        parts.append(data)
    text = json.dumps(header, separators=(",", ":")).encode()
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def header_of(data: bytes) -> dict:
    n = int.from_bytes(data[:8], "little")
    if n <= 0 or n > len(data) - 8:
        raise ValueError("the header's length is beyond the file")
    header = json.loads(data[8 : 8 + n])
    header.pop("__metadata__", None)
    end = len(data) - 8 - n
    for name, t in header.items():
        a, b = t["data_offsets"]
        if t["dtype"] in TYPES and b - a != int(np.prod(t["shape"])) * np.dtype(TYPES[t["dtype"]]).itemsize or not 0 <= a <= b <= end:
            raise ValueError(f"tensor {name} does not fit its extent")
    return header


def tensor_of(data: bytes, name: str) -> np.ndarray:
    t, n = header_of(data)[name], 8 + int.from_bytes(data[:8], "little")
    a, b = t["data_offsets"]
    return np.frombuffer(data[n + a : n + b], TYPES[t["dtype"]]).reshape(t["shape"])


HEADERS = "name string, dtype string, shape array<long>, begin long, end long"


def headers(files: DataFrame, key: str, content: str) -> DataFrame:
    """Row per tensor of each file (binary column): key and the header's fields."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, t["dtype"], t["shape"], *t["data_offsets"]) for k, c in zip(b.column(0).to_pylist(), b.column(1), strict=True) for n, t in header_of(c.as_py()).items()]
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "name", "dtype", "shape", "begin", "end"])

    return files.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).mapInArrow(f, f"key string, {HEADERS}").withColumnRenamed("key", key)


class _Part(InputPartition):
    def __init__(self, path: str, name: str, first: int, stop: int):
        self.path, self.name, self.first, self.stop = path, name, first, stop


class TensorSource(DataSource):
    """Format `tensors`: rows (file, tensor, row, values) of two-dimensional tensors.

    Options: path (a file or folder, or the URI of one in a store that Arrow knows), tensor (only this one), rows (a partition, 4096).
    """

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return "file string, tensor string, row long, values array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        path, rows = self.options["path"], int(self.options.get("rows", 4096))
        store, path = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), os.path.abspath(path))
        found = store.get_file_info(path)
        files = sorted(f.path for f in store.get_file_info(FileSelector(path)) if f.path.endswith(".safetensors")) if found.type == FileType.Directory else [path]
        out: list[InputPartition] = []
        for f in files:
            with store.open_input_file(f) as h:
                n = int.from_bytes(h.read(8), "little")
                header = json.loads(h.read(n))
            for name, t in header.items():
                if name != "__metadata__" and len(t["shape"]) == 2 and self.options.get("tensor", name) == name:
                    out += [_Part(f, name, a, min(a + rows, t["shape"][0])) for a in range(0, t["shape"][0], rows)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (LocalFileSystem(), None)
        with store.open_input_file(partition.path) as h:
            n = int.from_bytes(h.read(8), "little")
            t = json.loads(h.read(n))[partition.name]
            kind, width = np.dtype(TYPES[t["dtype"]]), t["shape"][1]
            h.seek(8 + n + t["data_offsets"][0] + partition.first * width * kind.itemsize)
            count = partition.stop - partition.first
            a = np.frombuffer(h.read(count * width * kind.itemsize), kind).reshape(count, width).astype(float)
        rows = list(range(partition.first, partition.stop))
        yield pa.RecordBatch.from_pydict({"file": [os.path.basename(partition.path)] * count, "tensor": [partition.name] * count, "row": pa.array(rows, pa.int64()), "values": pa.array(list(a), pa.list_(pa.float64()))})


class _Written(WriterCommitMessage):
    def __init__(self, path: str, final: str):
        self.path, self.final = path, final


class _Writer(DataSourceWriter):
    """One file a task; files get their names when all tasks have ended well."""

    def __init__(self, options: dict):
        self.options = options

    def store(self) -> tuple[FileSystem, str]:
        path = self.options["path"]
        return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), os.path.abspath(path))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, folder = self.store()
        store.create_dir(folder, recursive=True)
        tensors: dict[str, list] = {}
        for r in rows:
            tensors.setdefault(r.tensor, []).append((r.row, r["values"]))
        name = f"part-{uuid.uuid4().hex}.safetensors"
        path = f"{folder}/.{name}.open"
        with store.open_output_stream(path) as h:
            h.write(encode({k: np.array([x for _, x in sorted(v)], np.float64).reshape(len(v), -1) for k, v in tensors.items()}))
        return _Written(path, f"{folder}/{name}")

    def commit(self, messages: list) -> None:
        store, _ = self.store()
        for m in messages:
            if m:
                store.move(m.path, m.final)

    def abort(self, messages: list) -> None:
        store, _ = self.store()
        for m in messages:
            if m and store.get_file_info(m.path).type == FileType.File:
                store.delete_file(m.path)
