"""Operator 7: repeated byte strings, by ranks of positions at growing offsets.

Positions that may start a repeated string meet by the 32 bytes that their window chose (see
`repeats`): what no other place shares drops out before, and whole runs of positions that equal
earlier ones are settled at once. The others are ranked by prefix doubling: pairs of a position's
rank and the rank at an offset of 8, 16, 32 bytes and so on are sorted and ranked again; positions
with a rank of their own leave, and those that are left past the threshold of 100 bytes are
repeats. Each is compared with the first of its rank byte by byte.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import common as C
from sedge.llm.repeats import HOT, Chunk, Rule, repeats

WINDOW = 100
GRAM = 32


def rerank(rank: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of pairs, and which of them are shared."""
    order = np.lexsort((other, rank))
    r, o = rank[order], other[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (o[1:] != o[:-1]))) if len(r) else np.zeros(0, bool)
    found = np.empty(len(rank), np.int64)
    found[order] = np.cumsum(new) - 1
    return found, (np.bincount(found) > 1)[found]


def decide(window: int, stretches: list[bytes], windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which positions have an earlier one with the same bytes: smaller doc_id, then by order."""
    data = np.frombuffer(b"".join(stretches), np.uint8)
    sizes = np.array([len(t) for t in stretches], np.int64)
    begins = np.cumsum(sizes) - sizes
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begins, windows)
    doc = np.repeat(docs, windows)
    reach = 8 if window >= 8 else 1
    loads = C.eights(data)
    units = loads[: max(len(data) - 7, 0)] if reach == 8 else data.astype(np.uint64)
    ranks = C.Doubled(units, reach)
    live = np.arange(len(at))
    rank, shared = rerank(np.zeros(len(at), np.int64), units[at])
    while reach < window:
        live, rank = live[shared], rank[shared]
        step = min(reach, window - reach)
        rank, shared = rerank(rank, ranks.all(reach)[at[live] + step])
        reach += step
    live, rank = live[shared], rank[shared]
    late = np.zeros(len(at), bool)
    while len(live):
        order = np.lexsort((live, doc[live], rank))
        new = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
        head = np.empty(len(live), np.int64)
        head[order] = live[order][new][np.cumsum(new) - 1]
        same = np.ones(len(live), bool)
        for k in range(0, window, 8):
            if window >= 8:
                k = min(k, window - 8)
                same &= loads[at[live] + k] == loads[at[head] + k]
            else:
                same &= (loads[at[live]] ^ loads[at[head]]) << np.uint64(64 - 8 * window) == 0
        late[live[same]] = live[same] != head[same]
        # two strings of one rank: those unlike the first are looked at among themselves
        live, rank = live[~same], rank[~same]
    return late


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Row per document: doc_id, n_bytes, n_removed, n_spans, spans, kept (binary).

    Texts are UTF-8 bytes, null ones empty; matches never cross documents. A byte goes if a
    `window`-byte string that covers it also starts earlier: in a document with a smaller
    doc_id or before in the same one, overlaps included, judged on the input. spans lists
    [start, end) of the maximal removed runs. A null doc_id counts as -1; of rows that repeat
    a doc_id, the one that the scan meets first is the earlier. Other columns are ignored.
    """

    def emit(chunk: Chunk, k: int, hit: np.ndarray) -> tuple:
        text = chunk.text(k)
        if not hit.any():
            return len(text), 0, 0, [], text
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
        spans = edge.reshape(-1, 2)
        return len(text), int(hit.sum()), len(spans), spans.tolist(), np.frombuffer(text, np.uint8)[~hit].tobytes()

    schema = "n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary"
    return repeats(docs, Rule(False, window, gram, partial(decide, window), hot), schema, emit)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(C.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
