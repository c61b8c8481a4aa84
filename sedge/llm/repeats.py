"""Windows that occur before: which sampled positions share ranks, and what decides among those.

Every sequence (bytes or words) is cut into windows of a fixed length, one at each position.
Which windows started earlier is decided in rounds, and only what is shared goes on:

* round 0 ranks the `gram` that a window chose as its minimum by hash (equal windows choose
  the same gram at the same place, so nothing is lost; one choice serves a run of windows);
* round 1 ranks the union of all windows of a run (between one and two windows long): a run
  that equals an earlier one repeats as a whole;
* round 2 takes the runs that are the first of their union but share their gram with others.
  Their stretches of text meet, dealt by gram, and an operator's own engine decides window by
  window over the true text: subtrees of suffixes for words, rank pairs by doubling for bytes.

A gram with more than `Rule.hot` distinct unions would fill a task; its windows are ranked one
by one instead, each dealt by its own hash.

Texts stay in chunks that are written once and never move again. What moves in rounds 0 and 1
is, for each chunk and bucket of ranks, one row of sorted distinct ranks and, back, one or two
bits for each. A rank that fills the corpus so costs one entry a chunk: no task holds all its
occurrences. Unions and the windows of hot grams are compared by two 64-bit hashes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sedge.llm import common as C
from sedge.shipping import ship

U64 = np.uint64
#: Bits for the place in a sliding minimum; the others are the hash. Texts are below 2**31 bytes.
PLACE_BITS = 32
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20
#: Distinct stretches of one gram that meet in one task, and bytes of stretches that are decided at a time.
HOT = 4096
PART_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """What counts as earlier: words ask for a smaller doc_id, bytes also take the same document.

    decide: (stretches, windows) for each stretch of a bucket, and its doc_id, to one flag a
    window, whether it repeats an earlier one; stretches come in the order of chunks and places.
    """

    words: bool
    window: int
    gram: int
    decide: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]
    hot: int = HOT

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.window:
            raise ValueError("gram must be between 1 and window")

    def units(self, data: np.ndarray, starts: np.ndarray | None, ends: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, C.Doubled]:
        """Starts, ends and hashes of words, or of single bytes."""
        if self.words:
            return starts, ends, C.Doubled(C.stretch_hashes(data, starts, ends))
        whole = self.gram >= 8
        units = C.eights(data)[: max(len(data) - 7, 0)] if whole else C.mix(data.astype(U64) + U64(1))
        at = np.arange(len(data))
        return at, at + 1, C.Doubled(units, 8 if whole else 1)


@dataclass
class Slice:
    """Some whole documents of a chunk, or a part of a long one: the first one's number, the first byte, units as places from there."""

    doc: int
    offset: int
    begins: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: C.Doubled
    #: Of a part: its first unit in the document, and whether another part follows.
    first: int = 0
    more: bool = False


class Chunk:
    """A group of whole documents with their bytes end to end."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:8], "little")
        m = int.from_bytes(blob[8:16], "little")
        meta = C.unpack_longs(blob[16 : 16 + m]).reshape(2, n)
        self.ids, sizes = meta[0], meta[1]
        self.data = C.unpack(blob[16 + m :]) if sizes.sum() else b""
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))

    @staticmethod
    def pack(ids: np.ndarray, texts: list[bytes]) -> bytes:
        meta = C.pack_longs(np.concatenate((ids, [len(t) for t in texts])).astype(np.int64))
        return len(ids).to_bytes(8, "little") + len(meta).to_bytes(8, "little") + meta + C.pack(b"".join(texts))

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]]

    def slices(self, rule: Rule) -> Iterator[Slice]:
        """Runs of whole documents of up to SLICE bytes; a longer one comes in parts that share window - 1 units."""
        n, k = len(self.ids), 0
        while k < n:
            to = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + SLICE, "right")) - 1)
            at = int(self.offsets[k])
            data = np.frombuffer(self.data, np.uint8, int(self.offsets[to]) - at, at) if self.data else np.zeros(0, np.uint8)
            offsets = self.offsets[k : to + 1] - at
            starts, ends = doc_words(data, offsets) if rule.words else (None, None)
            if len(data) <= SLICE:
                yield Slice(k, at, np.searchsorted(starts, offsets) if rule.words else offsets, *rule.units(data, starts, ends))
            else:
                units = len(starts) if rule.words else len(data)
                step = SLICE // 4 if rule.words else SLICE
                for first in range(0, max(units, 1), step):
                    stop = min(first + step + rule.window - 1, units)
                    if rule.words:
                        low, high = (int(starts[first]), int(ends[stop - 1])) if units else (0, 0)
                        part = rule.units(data[low:high], starts[first:stop] - low, ends[first:stop] - low)
                    else:
                        low = first
                        part = rule.units(data[first:stop], None, None)
                    yield Slice(k, at + low, np.array([0, stop - first]), *part, first, first + step < units)
            k = to


def doc_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts that lie end to end; none reaches over the edge of a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = C.word_spans(data)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    at = np.searchsorted(starts, inner, "right") - 1
    cut = inner[(at >= 0) & (starts[at] < inner) & (ends[at] > inner)] if len(starts) else inner[:0]
    cut = np.unique(cut)
    return np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    done = 1
    while done < w:
        step = min(done, w - done)
        v = np.minimum(v[: len(v) - step], v[step:])
        done += step
    return v


@dataclass
class Runs:
    """Runs of windows of a chunk that chose the same gram.

    first and last window and the gram's place count units from the start of the slice; from
    and to are the bytes of all the run's windows in the chunk.
    """

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    slice: np.ndarray
    gram: np.ndarray
    union: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def take(self, which: np.ndarray) -> Runs:
        return Runs(*[getattr(self, f)[which] for f in Runs.__dataclass_fields__])


def runs_of(rule: Rule, chunk: Chunk, unions: bool) -> Runs:
    """Runs of all documents, with their unions' hashes or (cheaper) without."""
    w = rule.window - rule.gram + 1
    low = U64((1 << PLACE_BITS) - 1)
    parts: list[tuple] = []
    for s, x in enumerate(chunk.slices(rule)):
        if len(x.starts) < rule.window:
            continue
        grams = x.hashes.all(rule.gram)
        best = sliding_min((C.mix(grams) & ~low) | np.arange(len(grams), dtype=U64), w) & low
        wide = np.diff(x.begins) >= rule.window
        edge = np.zeros(len(best) + 1, np.int8)
        np.add.at(edge, x.begins[:-1][wide], 1)
        np.add.at(edge, x.begins[1:][wide] - rule.window + 1, -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]).astype(bool))
        if not len(at):
            continue
        b = best[at].astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (at[1:] != at[:-1] + 1))))
        first, last = at[new], at[np.concatenate((new[1:] - 1, [len(at) - 1]))]
        place = b[new]
        length = last - first + rule.window
        union = C.join(x.hashes.at(first, length), (place - first).astype(U64)) if unions else np.zeros(len(first), U64)
        doc = x.doc + np.searchsorted(x.begins, first, "right") - 1
        parts.append((doc, first, last, np.full(len(first), s), grams[place], union, x.offset + x.starts[first], x.offset + x.ends[first + length - 1]))
    kinds = (np.int64, np.int64, np.int64, np.int64, U64, U64, np.int64, np.int64)
    return Runs(*([np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in kinds]))


def bucket_of(ranks: np.ndarray, n_buckets: int) -> np.ndarray:
    return (((C.mix(ranks) >> U64(32)) * U64(n_buckets)) >> U64(32)).astype(np.int64)


def bucket_order(ranks: np.ndarray, n_buckets: int) -> np.ndarray:
    """Order by bucket, rank and place; rows of a chunk are made, and answered, in it."""
    return np.lexsort((ranks, bucket_of(ranks, n_buckets)))


def bucket_rows(chunk: int, kind: int, n_buckets: int, ranks: np.ndarray, *columns: np.ndarray | list[bytes]) -> list[tuple]:
    """Rows (bucket, kind, chunk, blob) of ranks in the order of buckets, and what goes with them."""
    if not len(ranks):
        return []
    bucket = bucket_of(ranks, n_buckets)
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        parts = [ranks[a:b].tobytes()]
        for c in columns:
            if isinstance(c, list):
                parts.append(C.pack(b"".join(c[a:b])))
            elif c.dtype == U64:
                parts.append(c[a:b].tobytes())
            else:
                parts.append(C.pack_longs(c[a:b]))
        rows.append((int(bucket[a]), kind, chunk, b"".join(len(p).to_bytes(4, "little") + p for p in parts)))
    return rows


def open_blob(blob: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        parts.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return parts


ROWS = "bucket long, kind int, chunk long, blob binary"
_ROWS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
SEEN, UNION, GRAM, WINDOW, TEXT = 0, 1, 2, 3, 4
#: Bits of an answer.
WIDTH = {SEEN: 1, UNION: 2, GRAM: 2, WINDOW: 2}


def table(rows: list[tuple]) -> pa.Table:
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS)}, schema=_ROWS)


def local_first(ranks: np.ndarray, more: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each occurrence among distinct (rank, more), and where each of these occurs first (by doc_id, then place)."""
    order = np.lexsort((docs, more, ranks))
    r, m = ranks[order], more[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (m[1:] != m[:-1]))) if len(r) else np.zeros(0, bool)
    index = np.empty(len(ranks), np.int64)
    index[order] = np.cumsum(new) - 1
    return index, order[new]


class Distinct:
    """A chunk's distinct (rank, more) in the order of buckets, with the smallest doc_id of each."""

    def __init__(self, ranks: np.ndarray, more: np.ndarray, docs: np.ndarray, n_buckets: int):
        index, head = local_first(ranks, more, docs)
        order = bucket_order(ranks[head], n_buckets)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.index, self.head = place[index], head[order]
        self.ranks, self.more, self.docs = ranks[self.head], more[self.head], docs[self.head]

    def first(self, rule: Rule, answer: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which occurrences nothing earlier equals. Words don't mind the same doc_id elsewhere."""
        if rule.words:
            return (answer >= 1)[self.index] & (docs == self.docs[self.index])
        out = np.zeros(len(docs), bool)
        out[self.head] = answer == 2
        return out


def two_bits(a: np.ndarray) -> np.ndarray:
    return np.unpackbits(a.astype(np.uint8)[:, None], axis=1)[:, 6:].ravel()


def ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)


def decide_in_parts(rule: Rule, grams: np.ndarray, texts: list[bytes], counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """rule.decide for a bucket, some whole grams of about PART_BYTES of text at a time."""
    order = np.argsort(grams, kind="stable")
    sizes = np.array([len(t) for t in texts], np.int64)[order]
    new = np.flatnonzero(np.concatenate(([True], grams[order][1:] != grams[order][:-1])))
    _, first = np.unique((np.cumsum(sizes) - sizes)[new] // PART_BYTES, return_index=True)
    edges = [*new[first].tolist(), len(order)]
    begins, bits = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), bool)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = order[a:b]
        bits[ranges(begins[part], counts[part])] = rule.decide([texts[k] for k in part.tolist()], counts[part], docs[part])
    return bits


def reduce_bucket(rule: Rule, t: pa.Table) -> pa.Table:
    """Answers each entry; but for TEXT, an entry is a chunk's only one of its rank.

    SEEN: the rank occurs more than once. UNION and WINDOW: 2 if this chunk holds the first
    occurrence (smallest doc_id, then smallest chunk), 1 if it holds that doc_id. GRAM: 1 if
    different unions follow, 2 if more than rule.hot do. TEXT: the flags of all its windows.
    """
    out = []
    kinds, chunks, bucket = t.column("kind").to_numpy(), t.column("chunk").to_numpy(), t.column("bucket")[0].as_py()
    blobs = t.column("blob")
    for kind in np.unique(kinds).tolist():
        rows = np.flatnonzero(kinds == kind)
        rows = rows[np.argsort(chunks[rows], kind="stable")]
        parts = [open_blob(blobs[int(i)].as_py()) for i in rows]
        ranks = [np.frombuffer(p[0], U64) for p in parts]
        longs = lambda j, parts=parts: np.concatenate([C.unpack_longs(p[j]) for p in parts])
        plain = lambda j, parts=parts: np.concatenate([np.frombuffer(p[j], U64) for p in parts])
        every = np.concatenate(ranks)
        if kind == TEXT:
            # columns: doc_id, windows and bytes of each stretch, and the stretches
            ends = [np.cumsum(C.unpack_longs(p[3])).tolist() for p in parts]
            texts = [x[a:b] for p, e in zip(parts, ends, strict=True) for x in [C.unpack(p[4])] for a, b in zip([0, *e[:-1]], e, strict=True)]
            bits = decide_in_parts(rule, every, texts, longs(2), longs(1))
            at = np.concatenate(([0], np.cumsum([int(C.unpack_longs(p[2]).sum()) for p in parts])))
        else:
            if kind == SEEN:
                distinct, index = np.unique(every, return_inverse=True)
                bits = (np.bincount(index, longs(1), len(distinct)) > 1)[index]
            elif kind == GRAM:
                distinct, index = np.unique(every, return_inverse=True)
                least, most = np.full(len(distinct), np.iinfo(np.uint64).max, U64), np.zeros(len(distinct), U64)
                np.minimum.at(least, index, plain(1))
                np.maximum.at(most, index, plain(2))
                many = np.bincount(index, longs(3), len(distinct)) > rule.hot
                bits = two_bits(np.where(least == most, 0, np.where(many, 2, 1))[index])
            else:
                docs = longs(2)
                index, head = local_first(every, plain(1), docs)
                answer = (docs == docs[head][index]).astype(np.uint8)
                answer[head] = 2
                bits = two_bits(answer)
            at = np.concatenate(([0], np.cumsum([len(r) for r in ranks]))) * WIDTH[kind]
        out += [(bucket, kind, int(chunks[i]), C.pack(np.packbits(bits[a:b]))) for i, a, b in zip(rows, at[:-1], at[1:], strict=True)]
    return table(out)


def answers(t: pa.Table, kind: int, counts: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """A chunk's answers in the order of its ranks; counts: bits of each rank."""
    rows = sorted((b, x) for b, k, x in zip(t.column("bucket").to_pylist(), t.column("kind").to_pylist(), t.column("blob").to_pylist(), strict=True) if k == kind)
    edges = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(buckets) else np.zeros(0, np.int64)
    sizes = np.add.reduceat(counts, edges) if len(edges) else edges
    if [b for b, _ in rows] != buckets[edges].tolist():
        raise RuntimeError("a chunk's ranks changed between rounds")
    parts = [np.unpackbits(np.frombuffer(C.unpack(x), np.uint8), count=int(n)) for (_, x), n in zip(rows, sizes, strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def numbers(t: pa.Table, kind: int, ranks: np.ndarray, n_buckets: int) -> np.ndarray:
    """Answers of WIDTH bits to a chunk's ranks."""
    width = WIDTH[kind]
    bits = answers(t, kind, np.full(len(ranks), width), bucket_of(ranks, n_buckets))
    return bits.reshape(-1, width) @ (np.array([2, 1]) if width == 2 else np.array([1]))


class State:
    """What a chunk knows after the rounds whose answers it has."""

    def __init__(self, rule: Rule, n_buckets: int, blob: bytes, got: pa.Table, rounds: int):
        self.rule, self.n_buckets = rule, n_buckets
        self.chunk = Chunk(blob)
        every = runs_of(rule, self.chunk, True)
        seen = np.unique(every.gram)
        seen = seen[bucket_order(seen, n_buckets)]
        shared = np.sort(seen[numbers(got, SEEN, seen, n_buckets) == 1])
        place = np.minimum(np.searchsorted(shared, every.gram), max(len(shared) - 1, 0))
        self.runs = r = every.take(shared[place] == every.gram if len(shared) else np.zeros(len(every.gram), bool))
        self.docs = self.chunk.ids[r.doc]
        self.unions = Distinct(r.union, r.gram, self.docs, n_buckets)
        if rounds < 2:
            return
        self.first = self.unions.first(rule, numbers(got, UNION, self.unions.ranks, n_buckets), self.docs)
        grams = np.unique(r.gram)
        grams = grams[bucket_order(grams, n_buckets)]
        many = numbers(got, GRAM, grams, n_buckets)
        by_value = np.argsort(grams)
        many = many[by_value][np.searchsorted(grams[by_value], r.gram)] if len(grams) else np.zeros(0, np.int64)
        self.text = np.flatnonzero(self.first & (many == 1))
        self.text = self.text[bucket_order(r.gram[self.text], n_buckets)]
        self.hot = np.flatnonzero(self.first & (many == 2))
        self.window_run, self.window_at = spread(r, self.hot)
        ranks = np.zeros(len(self.window_run), U64)
        wanted = np.unique(r.slice[self.window_run])
        for s, x in enumerate(self.chunk.slices(rule) if len(wanted) else ()):
            if s in wanted:
                y = r.slice[self.window_run] == s
                ranks[y] = x.hashes.at(self.window_at[y], np.full(int(y.sum()), rule.window))
        self.windows = Distinct(ranks, r.gram[self.window_run], self.docs[self.window_run], n_buckets)
        if rounds < 3:
            return
        self.late = ~self.windows.first(rule, numbers(got, WINDOW, self.windows.ranks, n_buckets), self.docs[self.window_run])
        counts = (r.last - r.first + 1)[self.text]
        self.text_late = answers(got, TEXT, counts, bucket_of(r.gram[self.text], n_buckets)).astype(bool)

    def ask_unions(self, chunk: int) -> list[tuple]:
        u, r = self.unions, self.runs
        rows = bucket_rows(chunk, UNION, self.n_buckets, u.ranks, u.more, u.docs)
        order = np.lexsort((u.ranks, u.more))
        g, x = u.more[order], u.ranks[order]
        new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
        last = np.concatenate((new[1:] - 1, [len(g) - 1])).astype(np.int64) if len(g) else new
        by_bucket = bucket_order(g[new], self.n_buckets)
        return rows + bucket_rows(chunk, GRAM, self.n_buckets, *[c[by_bucket] for c in (g[new], x[new], x[last], last - new + 1)])

    def ask_windows(self, chunk: int) -> list[tuple]:
        w, r, k = self.windows, self.runs, self.text
        stretches = [self.chunk.data[a:b] for a, b in zip(r.start[k].tolist(), r.end[k].tolist(), strict=True)]
        rows = bucket_rows(chunk, TEXT, self.n_buckets, r.gram[k], self.docs[k], (r.last - r.first + 1)[k], (r.end - r.start)[k], stretches)
        return rows + bucket_rows(chunk, WINDOW, self.n_buckets, w.ranks, w.more, w.docs)

    def covered(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each document, which of its units a window with an earlier start covers."""
        r, window = self.runs, self.rule.window
        run, at = spread(r, self.text)
        run, at = np.concatenate((run[self.text_late], self.window_run[self.late])), np.concatenate((at[self.text_late], self.window_at[self.late]))
        long = np.zeros(0, bool)
        for s, x in enumerate(self.chunk.slices(self.rule)):
            edge = np.zeros(int(x.begins[-1]) + 1, np.int32)
            whole = (r.slice == s) & ~self.first
            np.add.at(edge, r.first[whole], 1)
            np.add.at(edge, r.last[whole] + window, -1)
            one = at[r.slice[run] == s]
            np.add.at(edge, one, 1)
            np.add.at(edge, one + window, -1)
            hit = np.cumsum(edge[:-1]) > 0
            if not x.first and not x.more:
                for j in range(len(x.begins) - 1):
                    yield x.doc + j, hit[x.begins[j] : x.begins[j + 1]]
                continue
            # parts overlap: the units that two share are covered if either says so
            long = hit if not x.first else np.concatenate((long, np.zeros(x.first + len(hit) - len(long), bool)))
            long[x.first :] |= hit
            if not x.more:
                yield x.doc, long


def spread(r: Runs, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and place of each window of some runs."""
    n = (r.last - r.first + 1)[which]
    return np.repeat(which, n), ranges(r.first[which], n)


def repeats(docs: DataFrame, rule: Rule, schema: str, emit: Callable[[Chunk, int, np.ndarray], tuple], carry: tuple[str, ...] = (), chunk_bytes: int = C.TASK_BYTES) -> DataFrame:
    """Row doc_id, emit(chunk, k, covered) for each document; see the module's text for the rounds.

    A task holds a chunk's text (chunk_bytes, or one longer document), and for its runs of
    windows a few bytes for each byte of it; the hashes are made SLICE bytes at a time.

    Columns to carry come back as carried_0, carried_1, ... beside each document; they lie with
    its chunk meanwhile, so that no join brings them back.
    """
    spark = docs.sparkSession
    ship(spark)
    size = C.text_bytes(docs)
    n_buckets = C.task_count(spark, size)
    carried = [f"carried_{k}" for k in range(len(carry))]
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), "text", *[F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)])
    carried_fields = docs.schema.fields[2:]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for b in batches:
            for part, texts in C.parts(b, chunk_bytes):
                sink = pa.BufferOutputStream()
                rest = part.select(carried)
                with pa.ipc.new_stream(sink, rest.schema) as w:
                    w.write_batch(rest)
                blob = Chunk.pack(part.column("doc_id").to_numpy(zero_copy_only=False), texts)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int64()), "texts": pa.array([blob], pa.binary()), "rest": pa.array([C.pack(sink.getvalue().to_pybytes())], pa.binary())})
                k += 1

    store = C.checkpointed_by(docs.mapInArrow(C.lean(chunks), "chunk long, texts binary, rest binary"), n_buckets, "chunk")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, blob in zip(b.column("chunk").to_pylist(), b.column("texts"), strict=True):
                ranks, n = np.unique(runs_of(rule, Chunk(blob.as_py()), False).gram, return_counts=True)
                order = bucket_order(ranks, n_buckets)
                yield from table(bucket_rows(c, SEEN, n_buckets, ranks[order], np.minimum(n, 2)[order])).to_batches()

    def ask(rounds: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def f(left: pa.Table, got: pa.Table) -> pa.Table:
            rows = []
            for c, blob in zip(left.column("chunk").to_pylist(), left.column("texts"), strict=True):
                s = State(rule, n_buckets, blob.as_py(), got, rounds)
                rows += s.ask_unions(c) if rounds == 1 else s.ask_windows(c)
            return table(rows)

        return f

    out_schema = T.StructType([*T._parse_datatype_string(f"doc_id long, {schema}").fields, *carried_fields])

    def last(left: pa.Table, got: pa.Table) -> pa.Table:
        tables = []
        for blob, rest in zip(left.column("texts"), left.column("rest"), strict=True):
            s = State(rule, n_buckets, blob.as_py(), got, 3)
            rows = [(int(s.chunk.ids[k]), *emit(s.chunk, k, hit)) for k, hit in s.covered()]
            own = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(own_schema)]
            beside = pa.ipc.open_stream(C.unpack(rest.as_py())).read_all()
            tables.append(pa.table([*own, *[beside.column(n) for n in carried]], names=[*own_schema.names, *carried]))
        return pa.concat_tables(tables)

    own_schema = to_arrow_schema(T.StructType(out_schema.fields[: len(out_schema) - len(carried)]))

    def reduce(t: pa.Table) -> pa.Table:
        return reduce_bucket(rule, t)

    def meet(asked: DataFrame) -> DataFrame:
        # dealt by number, for adaptive execution would join buckets that look small while they are packed
        return C.checkpointed(asked.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(reduce, ROWS))

    by_chunk = store.groupBy("chunk")
    got = meet(store.mapInArrow(C.lean(seen), ROWS))
    for rounds in (1, 2):
        more = by_chunk.cogroup(got.groupBy("chunk")).applyInArrow(ask(rounds), ROWS)
        got = C.checkpointed(got.unionByName(meet(more)))
    return by_chunk.cogroup(got.groupBy("chunk")).applyInArrow(last, out_schema)

