"""Operator 1: packing along a space-filling curve.

A document's token ids are hashed into a vector, the vector is projected to three
dimensions, and the cell that it falls in has a place on a Hilbert curve. Documents are
range-sorted by that place (and doc_id, so that copies can part), and each range is cut into
sequences: neighbours on the curve share sequences. All sequences of a range are full; what
is left at its end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import common as C
from sedge.llm.pair_merge import END, PairMerge
from sedge.llm.word_cache import WordCache
from sedge.shipping import ship

VOCABULARY = "word_bpe_49k.json"
LENGTH = 2048
END_ID = 1
BUCKETS, DIMENSIONS, BITS = 256, 3, 10
#: Punctuation that is a token by itself after letters.
MARKS = {b".", b",", b"!", b"?", b";", b":"}
#: Lower case of a whole text looks at this letter's place, that of single letters does not.
SIGMA = "\u03a3"
#: Token bytes (two an id) that a range is planned for.
RANGE_BYTES = 16 << 20
#: A generation of remembered tokens; an executor's limit holds for all its workers and a full heap.
CACHE_BYTES = 64 << 20
#: Pieces that are returned together, of a sequence's bytes each at most.
PIECES_OUT = 256
#: By byte: ASCII letters, the marks, and what a letter is in lower case.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[m[0] for m in MARKS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordCoder:
    """ids of texts by way of their words: this vocabulary's pieces never reach over white space.

    The strings of added tokens are cut out of a whole text before that, as the library does. The tokenizer file says how a word falls into tokens (its normalizers and pattern) and which
    merges these go through; words that are new to a worker are merged together. The tests hold
    the ids against the tokenizers library over whole tables.
    """

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        norms = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if norms != ["NFC", "Replace", "Lowercase"] or not split["invert"] or split["behavior"] != "Removed" or model["unk_token"]:
            raise ValueError("this vocabulary has other rules than its words are cut by here")
        self.tokens = regex.compile(split["pattern"]["Regex"] + "|\n")
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens are looked for in plain text here")
        self.added = {t["content"].encode(): t["id"].to_bytes(2, "little") for t in added}
        # of tokens that start at one place the longest counts
        self.cut = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + b")")
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = PairMerge({(vocabulary[a], vocabulary[b]): (k, vocabulary[a + b]) for k, (a, b) in reversed([*enumerate(merges)])})
        names = byte_names()
        self.inner = np.array([vocabulary[c] for c in names], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in names], np.int64)
        self.seen = WordCache(self.encode_tokens, limit=CACHE_BYTES)

    def tokens_of(self, words: list[bytes]) -> tuple[list[int], str, list[int]]:
        """How many tokens each word has, the tokens' text end to end, and the characters of each; the pattern is only asked where more than letters come."""
        text = b"\n".join(words).decode()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if SIGMA not in text else "".join([c.lower() for c in text])
        found: list[list[str]] = [[w] for w in text.split("\n")]
        asked = [k for k, [w] in enumerate(found) if not w.isalpha()]
        for k in asked:
            found[k] = []
        line, numbers = found[asked[0]] if asked else [], iter(asked[1:])
        for t in self.tokens.findall("\n".join([w for w in text.split("\n") if not w.isalpha()])):
            if t == "\n":
                line = found[next(numbers)]
            else:
                line.append(t)
        tokens = list(chain.from_iterable(found))
        return [len(f) for f in found], "".join(tokens), [len(t) for t in tokens]

    def encode_words(self, words: list[bytes]) -> pa.Array:
        """16-bit ids of each word; tokens, which are fewer than words, are remembered."""
        if not words:
            return pa.array([], pa.large_binary())
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        last = np.cumsum(sizes) - 1
        # one or two tokens of ASCII letters and a mark are told from others by arrays
        odd = np.add.reduceat(~_LETTER[data], last - sizes + 1, dtype=np.int64)
        marked = (odd == 1) & _MARK[data[last]] & (sizes > 1)
        plain = marked | (odd == 0)
        counts = 1 + marked
        others = np.flatnonzero(~plain)
        counts[others], text, chars = self.tokens_of([words[k] for k in others.tolist()]) if len(others) else ([], "", [])
        strange_raw = np.frombuffer(text.encode(), np.uint8)
        # a character's first byte is no continuation
        places = np.append(np.flatnonzero(strange_raw & 0xC0 != 0x80), len(strange_raw))
        owner = np.repeat(np.arange(len(words)), counts)
        first = np.cumsum(counts) - counts
        lengths = np.ones(len(owner), np.int64)
        lengths[first[plain]] = (sizes - marked)[plain]
        strange = ~plain[owner]
        lengths[strange] = np.diff(places[np.cumsum([0, *chars])])
        bytewise = np.repeat(strange, lengths)
        raw = np.zeros(len(bytewise), np.uint8)
        raw[~bytewise] = _LOWER[data[np.repeat(plain, sizes)]]
        raw[bytewise] = strange_raw
        ends = np.cumsum(lengths)
        keys, which = C.distinct(raw, ends - lengths, ends)
        coded = pa.array(self.seen.values(keys), pa.large_binary()).take(which)
        edges = np.concatenate(([0], np.cumsum(counts)))
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(C.offsets(coded)[edges]), coded.buffers()[2]])

    def encode_tokens(self, tokens: list[bytes]) -> list[bytes]:
        """16-bit ids of each token."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        flat = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        flat[ends] = self.last[raw[ends]]
        which, ids, n_ids = [], [], np.zeros(len(tokens), np.int64)
        for rows, got in self.merges.merge_all(flat, lengths):
            full = got != END
            which.append(rows)
            n_ids[rows] = full.sum(axis=1)
            ids.append(got[full].astype("<u2"))
        blob = stretches(np.concatenate(ids), n_ids, np.concatenate(which)).tobytes()
        edges = np.concatenate(([0], np.cumsum(2 * n_ids))).tolist()
        return [blob[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """16-bit ids and the end id of each text."""
        marked = {k: self.cut.split(t) for k, t in enumerate(texts) if any(a in t for a in self.added)}
        # every other part of such a text is an added token's string
        plain = [p for k, t in enumerate(texts) for p in (marked[k][::2] if k in marked else [t])]
        data = np.frombuffer(b"\n".join(plain), np.uint8)
        begins, ends = C.word_spans(data)
        starts = np.cumsum([0] + [len(p) + 1 for p in plain])
        edges = np.searchsorted(begins, starts)
        keys, ids = C.distinct(data, begins, ends)
        coded = self.encode_words(keys).take(ids)
        at = C.offsets(coded)[edges].tolist()
        line = coded.buffers()[2]
        blobs = iter([line[a:b].to_pybytes() if a < b else b"" for a, b in zip(at[:-1], at[1:], strict=True)])
        end = END_ID.to_bytes(2, "little")
        return [b"".join([self.added[p] if i % 2 else next(blobs) for i, p in enumerate(marked.get(k, [b""]))]) + end for k in range(len(texts))]


def stretches(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Stretches by number, of flat that has them end to end in another order."""
    begins = np.zeros(len(sizes), np.int64)
    held = sizes[order]
    begins[order] = np.cumsum(held) - held
    return flat[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))]


def byte_names() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


@lru_cache(maxsize=4)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMENSIONS))


@lru_cache(maxsize=1)
def _buckets() -> tuple[np.ndarray, np.ndarray]:
    h = C.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def cells(ids: list[np.ndarray]) -> np.ndarray:
    """Grid cell of each document: its hashed, normed vector in few dimensions."""
    bucket, sign = _buckets()
    v = np.array([np.bincount(bucket[x], sign[x], BUCKETS) for x in ids]).reshape(-1, BUCKETS)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    p = (v / np.where(norm > 0, norm, 1)) @ _projection()
    return np.clip((p + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(cell: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each cell (rows) on the Hilbert curve, by Skilling's transposition."""
    x = cell.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def cuts(total: int, length: int) -> np.ndarray:
    """Sequence lengths for so many tokens: full ones, then powers of two."""
    rest = total % length
    return np.array([length] * (total // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def pieces(batches: Iterator[pa.RecordBatch], length: int, sequence: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents with ids (packed) as pieces of sequences numbered from this one on, at most PIECES_OUT a batch and a sequence's more."""
    # at most one sequence is open; a document is cut as it comes
    filled = 0
    held: list[tuple] = []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=NAMES)

    done: list[tuple] = []
    for b in batches:
        for doc, n, blob in zip(b.column("doc_id").to_pylist(), b.column("doc_tokens").to_pylist(), b.column("ids"), strict=True):
            ids = np.frombuffer(C.unpack(blob.as_py()), "<u2").astype("<u4")
            start = 0
            while start < n:
                size = min(n - start, length - filled)
                held.append((doc, start, size, n, sequence, filled, ids[start : start + size].tobytes()))
                start, filled = start + size, filled + size
                if filled == length:
                    done += held
                    held, filled, sequence = [], 0, sequence + 1
                if len(done) >= PIECES_OUT:
                    yield out(done)
                    done = []
    ends = np.cumsum(cuts(filled, length))
    for doc, start, size, n, _, at, ids in held:
        to = at + size
        while at < to:
            k = int(np.searchsorted(ends, at, "right"))
            step = min(to, int(ends[k])) - at
            done.append((doc, start, step, n, sequence + k, at - (int(ends[k - 1]) if k else 0), ids[: 4 * step]))
            at, start, ids = at + step, start + step, ids[4 * step :]
    yield out(done)


def pack_documents(docs: DataFrame, length: int = LENGTH, vocabulary_path: str | None = None) -> DataFrame:
    """Row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (32-bit little-endian).

    Each id of each document, with an end id, lies in exactly one piece. A null or empty text
    is the end id alone. Documents are cut freely at sequence ends. Rows that repeat a doc_id
    are packed each; a null doc_id stays null. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    path = vocabulary_path or public_tokenizers.path(VOCABULARY)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                blobs = coder.encode([t.as_py() or b"" for t in part.column("text").cast(pa.large_binary())])
                keys = hilbert(cells([np.frombuffer(x, "<u2") for x in blobs]))
                cols = [part.column("doc_id"), pa.array(keys), pa.array([len(x) // 2 for x in blobs], pa.int64()), pa.array([C.pack(x) for x in blobs], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "place", "doc_tokens", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pieces(batches, length, TaskContext.get().partitionId() << 32)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = C.checkpointed(docs.mapInArrow(C.lean(encode, words=True), "doc_id long, place long, doc_tokens long, ids binary"))
    tokens = coded.agg(F.sum("doc_tokens")).first()[0] or 0
    ranges = coded.repartitionByRange(C.task_count(spark, 2 * tokens, RANGE_BYTES), "place", "doc_id").sortWithinPartitions("place", "doc_id")
    return ranges.mapInArrow(C.lean(pack, words=True), ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in NAMES))


NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(C.documents(spark, sf_dir)))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last: sequences of all documents that are left."""
    return digest(pack_documents(docs))
