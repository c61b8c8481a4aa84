"""Operator 4: SentencePiece encoding and decoding with merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs, best score first and leftmost first
among equals, as the library does; many segments go through their agendas in step. No piece of such a vocabulary has a space mark after
another character, and none holds a line end, so a text falls apart at these places into
segments that are encoded once each while a worker remembers them. Every segment that the
agenda encodes is checked against the sentencepiece library, a list of them for each Arrow
batch; a difference is an error. Decoding is the library's own, over the ids of whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import common as C
from sedge.llm.pair_merge import END, PairMerge
from sedge.llm.word_cache import WordCache
from sedge.shipping import ship

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Documents that are decoded and returned together.
ROWS_OUT = 512
SEGMENT = re.compile(f"\n[^\n{MARK}]*|{MARK}+[^\n{MARK}]*")


class Agenda:
    """Encoder for one model file."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        ids = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in ids}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece of this vocabulary reaches over a segment's end")
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.decimal = pa.array([b"%d " % i for i in range(n)], pa.large_binary())
        # symbols are piece ids; other characters of pieces come after those, all others are negative
        chars = sorted(set("".join(self.ids)) - self.ids.keys())
        symbols = self.ids | {c: n + k for k, c in enumerate(chars)}
        self.of_char = -1 - np.arange(0x110000, dtype=np.int64)
        self.of_char[:128] = self.bytes[:128]
        for c, s in symbols.items():
            if len(c) == 1 and not (s >= n and ord(c) < 128):
                self.of_char[ord(c)] = s
        pairs = {}
        scores = sorted({lib.get_score(i) for i in ids}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    x, y = (int(self.of_char[ord(s)]) if len(s) == 1 else symbols[s] for s in (p[:k], p[k:]))
                    pairs[x, y] = rank[lib.get_score(i)], i
        self.agendas = PairMerge(pairs)
        self.n = n
        self.seen = WordCache(self.encode_segments)

    def encode_segments(self, keys: list[str]) -> list[bytes]:
        """32-bit ids of each segment, checked against the library."""
        texts = [k if k.startswith("\n") else MARK + k for k in keys]
        flat = self.of_char[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
        sizes = np.array([len(t) for t in texts])
        out: list[bytes] = [b""] * len(keys)
        for rows, got in self.agendas.merge_all(flat, sizes):
            full = got != END
            line, width = got.astype("<i4").tobytes(), 4 * got.shape[1]
            for k, (r, n) in enumerate(zip(rows.tolist(), (4 * full.sum(axis=1)).tolist(), strict=True)):
                out[r] = line[k * width : k * width + n]
            for k in np.flatnonzero((((got < 0) & full) | (got >= self.n)).any(axis=1)).tolist():
                out[rows[k]] = np.array([*chain.from_iterable(self.fallback(i) for i in got[k][full[k]].tolist())], "<i4").tobytes()
        lead, line = self.library.encode("\n")[:-1], self.library.encode("\n")[-1:]
        # a line end before each segment keeps the library's own mark at the start apart
        got = self.library.encode([("" if k.startswith("\n") else "\n ") + k.replace(MARK, " ") for k in keys], num_threads=1)
        before, inside = (np.array(x, "<i4").tobytes() for x in (lead + line, lead))
        want = [(inside if k.startswith("\n") else before) + ids for k, ids in zip(keys, out, strict=True)]
        if [4 * len(g) for g in got] != [len(w) for w in want] or np.fromiter(chain.from_iterable(got), "<i4").tobytes() != b"".join(want):
            k = next(k for k, (g, w) in enumerate(zip(got, want, strict=True)) if np.array(g, "<i4").tobytes() != w)
            raise RuntimeError(f"the agenda and the library differ on {keys[k]!r}: {np.frombuffer(want[k], '<i4').tolist()} and {got[k]}")
        return out

    def fallback(self, symbol: int) -> list[int]:
        """ids of the bytes of a character that is no piece."""
        if 0 <= symbol < self.n:
            return [symbol]
        code = -1 - symbol if symbol < 0 else int(np.flatnonzero(self.of_char == symbol)[0])
        return [self.bytes[b] for b in chr(code).encode()]

    @staticmethod
    def segments(text: str) -> list[str]:
        """Keys of a text's segments: a line end and what follows it, or else the text after a mark."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            found = SEGMENT.findall(MARK + text.replace(" ", MARK))
            return [s[1:] if s[0] == MARK else s for s in found]
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> list[list[tuple[str, list[int]]]]:
        """Of each text's segments: decimal ids, joined by one space, and ids."""
        keys = [self.segments(t) for t in texts]
        different = list(dict.fromkeys(chain.from_iterable(keys)))
        ids = {k: np.frombuffer(v, "<i4").tolist() for k, v in zip(different, self.seen.values(different), strict=True)}
        return [[(" ".join([str(i) for i in ids[k]]), ids[k]) for k in ks] for ks in keys]

    def encode_whole(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """ids of each text, and those in decimal, each with a space after it."""
        keys = [self.segments(t) for t in texts]
        found = pa.array(list(chain.from_iterable(keys)), pa.large_string()).dictionary_encode()
        different = [k.decode() for k in C.sliced(found.dictionary.cast(pa.large_binary()))]
        ids = pa.array(self.seen.values(different), pa.large_binary()).take(found.indices)
        edges = C.offsets(ids)[np.cumsum([0, *map(len, keys)])] // 4
        flat = np.frombuffer(ids.buffers()[2], "<i4", int(edges[-1])) if edges[-1] else np.zeros(0, np.int32)
        names = self.decimal.take(pa.array(flat))
        places, line = C.offsets(names)[edges].tolist(), names.buffers()[2]
        edges = edges.tolist()
        return [(flat[a:b].tolist(), line[x:y].to_pybytes().decode() if x < y else "") for a, b, x, y in zip(edges[:-1], edges[1:], places[:-1], places[1:], strict=True)]


@lru_cache(maxsize=4)
def agenda(path: str) -> Agenda:
    return Agenda(path)


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Row per document: doc_id, n_tokens, ids (decimal, joined by one space, with the end id), decoded.

    A null text is empty and so has the end id alone. Very long texts are one document like
    others. Rows that repeat a doc_id are all encoded. Other columns of docs are ignored.
    model_path None: the public 32k vocabulary, where each worker has it.
    """
    ship(docs.sparkSession)
    path = model_path or public_tokenizers.path(MODEL)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = agenda(path)
        lib = coder.library
        end = lib.eos_id()
        for b in batches:
            for at in range(0, b.num_rows, ROWS_OUT):
                part = b.slice(at, ROWS_OUT)
                n, ids, decoded = [], [], []
                for every, line in coder.encode_whole([x.as_py() or "" for x in part.column("text")]):
                    every.append(end)
                    n.append(len(every))
                    ids.append(line + str(end))
                    decoded.append(lib.decode(every))
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "decoded"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(C.lean(f, words=True), "doc_id long, n_tokens long, ids string, decoded string")


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(C.documents(spark, sf_dir))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
