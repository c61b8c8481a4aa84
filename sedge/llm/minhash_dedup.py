"""Operator 6: near-duplicate documents by improved consistent weighted sampling.

A document is its multiset of five-word shingles, weighted by tf-idf. Document frequencies are
counted over all documents in a fixed number of hashed slots, so the table that every task gets
has a fixed size; idf saturates, for a shingle that up to a fifth of all documents share tells
as much about a copy as a rarer one. Samples are grouped in bands; documents that agree in a
band are compared by exact weighted Jaccard similarity.

Texts of equal words are one node. The node of a bucket whose own buckets hold most is its hub
(of a group of copies, their original or what is nearest to it), and all of the bucket are
compared with that first. The hub's nodes that then lie in other components than its own are dealt
to blocks, as are those in its own; a task takes two blocks, one of the former kind at least, and
compares all their pairs at once by matrix products, so a node's shingles move once a block, not
once a pair, and no link between components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import common as C
from sedge.llm.components import components
from sedge.llm.repeats import doc_words
from sedge.shipping import ship

U64 = np.uint64
WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 3
SLOT_BITS, SEGMENTS = 18, 16
#: idf is log(documents / df), at most that of a fifth of the documents and at least half of it.
IDF_HIGH = float(np.log(5))
IDF_LOW = IDF_HIGH / 2
TABLE_BITS = 16
#: The bar for a document's samples lies where so many are expected below it.
LIKELY = 4
PART_BYTES = 1 << 20
#: Bits of a shingle's hash that are kept to compare two documents.
KEPT_BYTES = 5
#: Nodes of a hub that a block is planned for, and columns of a product.
BLOCK, COLUMNS = 256, 8192
SLACK = 1e-3


def shingles(texts: list[bytes], n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct shingle (by document, hash); words and hash of each text.

    A text of fewer words is one shingle of all of them; one without words has none.
    """
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    a, b = doc_words(data, offsets)
    begins = np.searchsorted(a, offsets)
    counts = np.diff(begins)
    hashes = C.stretch_hashes(data, a, b)
    line = hashes.tobytes()
    whole = np.array([int.from_bytes(hashlib.blake2b(line[8 * x : 8 * y], digest_size=8).digest(), "little") for x, y in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)], U64)
    each = np.where(counts >= n_words, counts - n_words + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), each)
    start = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + begins[:-1][doc]
    h = whole[doc]
    full = counts[doc] >= n_words
    h[full] = C.Doubled(hashes).all(n_words)[start[full]]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
    return doc[new], h[new], np.diff(np.concatenate((new, [len(h)]))), counts, whole


def slot(h: np.ndarray) -> np.ndarray:
    return (C.mix(h) >> U64(64 - SLOT_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by slot, and in all; a fixed 2**SLOT_BITS numbers whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << SLOT_BITS, np.int64), 0
        for b in batches:
            for part, texts in C.parts(b, PART_BYTES):
                doc, h, *_ = shingles(texts)
                pair = np.unique(doc.astype(np.int64) << SLOT_BITS | slot(h))
                df += np.bincount(pair & (1 << SLOT_BITS) - 1, minlength=len(df))
                n += part.num_rows
        if n:
            blobs = [C.pack_longs(x) for x in np.split(df, SEGMENTS)] + [C.pack_longs(np.array([n]))]
            yield pa.RecordBatch.from_pydict({"segment": pa.array(range(SEGMENTS + 1), pa.int32()), "counts": pa.array(blobs, pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            for x in b.column("counts"):
                total = total + C.unpack_longs(x.as_py())
        yield pa.RecordBatch.from_pydict({"segment": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([C.pack_longs(total)], pa.binary())})

    counted = docs.select("text").mapInArrow(C.lean(count), "segment int, counts binary")
    got = {r.segment: C.unpack_longs(bytes(r.counts)) for r in counted.groupBy("segment").applyInArrow(add, "segment int, counts binary").collect()}
    if not got:
        return np.zeros(1 << SLOT_BITS, np.int64), 0
    return np.concatenate([got[k] for k in range(SEGMENTS)]), int(got[SEGMENTS][0])


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    return np.clip(np.log(max(n, 1) / np.maximum(df, 1)), IDF_LOW, IDF_HIGH).astype(np.float32)


@lru_cache(maxsize=1)
def variables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each sample: an odd multiplier, and r, log c - r and beta by hash of the shingle."""
    rng = np.random.default_rng(6)
    n = BANDS * ROWS
    odd = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    r = rng.gamma(2, 1, (n, 1 << TABLE_BITS)).astype(np.float32)
    c = np.log(rng.gamma(2, 1, (n, 1 << TABLE_BITS))).astype(np.float32) - r
    return odd, r, c, rng.random((n, 1 << TABLE_BITS)).astype(np.float32)


def log_a(log_w: np.ndarray, r: np.ndarray, c: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log a and t of shingles by their weights and variables (c: log c - r)."""
    t = np.floor(log_w / r + beta)
    return c - r * (t - beta), t


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and the keys of their bands.

    A sample is the shingle with the least a and its quantised log weight t. log a is at least
    (log c - r) - log weight, and the least a of a document is exponential with the sum of its
    weights as rate. So shingles whose bound is under a bar, which a least a passes once in e**LIKELY
    times, are worked out; where nothing is found well under the bar, all of the document's are.
    """
    odd, r, c, beta = variables()
    edge = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    keys = np.zeros((len(edge), BANDS), U64)
    if not len(edge):
        return doc[edge], keys
    sizes = np.diff(np.concatenate((edge, [len(doc)])))
    local = np.repeat(np.arange(len(edge)), sizes)
    log_w = np.log(weight).astype(np.float32)
    bar = np.log(LIKELY / np.add.reduceat(weight, edge)).astype(np.float32)
    under = log_w + bar[local]
    mixed = C.mix(h ^ U64(0xD1B54A32D192ED03))
    for j in range(BANDS * ROWS):
        i = (mixed * odd[j] >> U64(64 - TABLE_BITS)).view(np.int64)

        def least(at: np.ndarray, i: np.ndarray = i, j: int = j) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of the documents of these shingles: the shingle with the least a, that and its t."""
            k = i[at]
            value, t = log_a(log_w[at], r[j][k], c[j][k], beta[j][k])
            own = local[at]
            begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            low = np.minimum.reduceat(value, begins)
            equal = np.flatnonzero(value == np.repeat(low, np.diff(np.concatenate((begins, [len(at)])))))
            if len(equal) > len(begins):
                equal = equal[np.lexsort((mixed[at[equal]], own[equal]))]
                equal = equal[np.concatenate(([True], own[equal][1:] != own[equal][:-1]))]
            return at[equal], low, t[equal]

        first, t = np.zeros(len(edge), np.int64), np.zeros(len(edge), np.float32)
        left = np.ones(len(edge), bool)
        at = np.flatnonzero(c[j][i] <= under)
        if len(at):
            found, low, its = least(at)
            clear = low < bar[local[found]] - SLACK
            own = local[found][clear]
            first[own], t[own], left[own] = found[clear], its[clear], False
        if left.any():
            first[left], _, t[left] = least(np.flatnonzero(np.repeat(left, sizes)))
        sample = C.mix(h[first] ^ C.mix(t.astype(np.int64).view(U64)))
        keys[:, j // ROWS] = C.mix(keys[:, j // ROWS] * U64(31) ^ sample)
    return doc[edge], keys


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed documents."""
    (ha, ia, na), (hb, ib, nb) = unpack_set(a), unpack_set(b)
    h, inverse = np.unique(np.concatenate((ha, hb)), return_inverse=True)
    x, y = np.bincount(inverse[: len(ha)], ia * na, len(h)), np.bincount(inverse[len(ha) :], ib * nb, len(h))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def similarities(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """All similarities between two lists of packed documents.

    The n-th occurrence of a shingle is a feature of its own; the weight that two documents
    share then is a product of 0/1 rows, summed over blocks of columns.
    """
    docs = [unpack_set(x) for x in (*left, *right)]
    row = np.repeat(np.arange(len(docs)), [int(n.sum()) for _, _, n in docs])
    h = np.concatenate([np.repeat(h, n) for h, _, n in docs])
    w = np.concatenate([np.repeat(i, n) for _, i, n in docs])
    level = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for _, _, n in docs])
    total = np.bincount(row, w, len(docs))
    _, feature = np.unique(C.mix(h) ^ C.mix(level.astype(U64)), return_inverse=True)
    shared = np.zeros((len(left), len(right)))
    order = np.argsort(feature, kind="stable")
    row, feature, w = row[order], feature[order], w[order]
    for first in range(0, int(feature[-1]) + 1 if len(feature) else 0, COLUMNS):
        a, b = np.searchsorted(feature, (first, first + COLUMNS))
        x = np.zeros((len(docs), COLUMNS), np.float32)
        x[row[a:b], feature[a:b] - first] = np.sqrt(w[a:b])
        shared += x[: len(left)] @ x[len(left) :].T
    return shared / (total[: len(left), None] + total[None, len(left) :] - shared)


def pack_set(h: np.ndarray, idf: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted truncated hashes, their idf and counts."""
    raw = np.ascontiguousarray((h >> U64(64 - 8 * KEPT_BYTES)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES]
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in (idf.astype("<f4"), n.astype("<i4"))]
    return len(h).to_bytes(4, "little") + C.pack(raw.tobytes() + b"".join(planes))


def unpack_set(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(C.unpack(blob[4:]), np.uint8)
    h = np.zeros((n, 8), np.uint8)
    h[:, :KEPT_BYTES] = raw[: n * KEPT_BYTES].reshape(n, KEPT_BYTES)
    idf, count = (np.ascontiguousarray(raw[n * (KEPT_BYTES + k) : n * (KEPT_BYTES + k + 4)].reshape(4, n).T) for k in (0, 4))
    return h.view("<u8").ravel(), idf.view("<f4").ravel().astype(float), count.view("<i4").ravel().astype(np.int64)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Row per document: doc_id, class_id (smallest doc_id of its class), kept (doc_id = class_id).

    Two documents link when the weighted Jaccard similarity of their shingles is at least `least`;
    classes are the components of links. Texts without words (null, empty, white space) are
    classes of their own; texts of fewer than five words are one shingle. Rows that repeat a
    doc_id each have a row and may have different classes. A null doc_id counts as -1. A pair
    of similarity 0.8 misses all bands once in a hundred thousand. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), "text")
    idf = spark.sparkContext.broadcast(idf_table(*document_frequencies(docs)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in C.parts(b, PART_BYTES):
                doc, h, n, counts, whole = shingles(texts)
                which, keys = signatures(doc, h, n * idf.value[slot(h)])
                rows = [None] * len(texts)
                for k, x in zip(which.tolist(), keys.view(np.int64).tolist(), strict=True):
                    rows[k] = x
                node = pa.array(whole.view(np.int64), mask=counts == 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), node, pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"])

    signed = C.checkpointed(docs.mapInArrow(C.lean(sign), "doc_id long, node long, bands array<long>"))
    nodes = C.checkpointed(signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))

    entries = nodes.select("node", "doc_id", F.posexplode("bands").alias("band", "key"))
    # written, as hubs are below, so that a large bucket's rows meet it in a join of its own, which can split them
    buckets = C.checkpointed(entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = C.checkpointed(entries.join(buckets, ["band", "key"]))
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = C.checkpointed(members.join(weight, "node").groupBy("band", "key").agg(F.max(F.struct("weight", "node"))["node"].alias("hub")))
    family = C.checkpointed(members.join(hubs, ["band", "key"]).select("hub", "node").distinct())

    def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in C.parts(b, PART_BYTES):
                doc, h, n, _, whole = shingles(texts)
                w = idf.value[slot(h)]
                edges = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
                blobs = [pack_set(h[a:z], w[a:z], n[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    wanted = members.select("doc_id").distinct()
    sets = C.checkpointed(docs.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(C.lean(collect_sets), "node long, shingles binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similarity(x.as_py(), y.as_py()) >= least for x, y in zip(b.column("left"), b.column("right"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = family.filter("hub != node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    links = C.checkpointed(both.mapInArrow(C.lean(compare), "a long, b long"))

    placed = family.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = C.checkpointed(placed)
    # nodes in the hub's own component need no comparison with each other
    main = placed.filter("hub = node").select("hub", F.col("component").alias("main"))
    placed = C.checkpointed(placed.join(main, "hub").select("hub", "node", "component", (F.col("component") == F.col("main")).alias("is_main")))
    split = placed.groupBy("hub").agg(F.count_if("is_main").alias("n_main"), F.count_if(~F.col("is_main")).alias("n_minor")).filter("n_minor > 0")
    # written, so that a hub's rows meet it in a join of its own, which can split them
    split = C.checkpointed(split.select("hub", F.ceil(F.col("n_main") / BLOCK).alias("mains"), F.ceil(F.col("n_minor") / BLOCK).alias("minors")))
    h = F.xxhash64("node")
    block = F.when(F.col("is_main"), F.pmod(h, "mains")).otherwise(F.col("mains") + F.pmod(h, "minors"))
    still = placed.join(split, "hub").withColumn("block", block).join(sets, "node")
    others = F.sequence(F.when(F.col("is_main"), F.col("mains")).otherwise(F.lit(0).cast("long")), F.col("mains") + F.col("minors") - 1)
    dealt = still.select("hub", "node", "component", "block", "shingles", F.explode(others).alias("other"))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def compare_blocks(t: pa.Table) -> pa.Table:
        node, component, block = (t.column(c).to_numpy() for c in ("node", "component", "block"))
        blobs = t.column("shingles").to_pylist()
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        s = similarities([blobs[k] for k in left], [blobs[k] for k in right])
        i, j = np.nonzero((s >= least - SLACK) & (component[left][:, None] != component[right][None, :]))
        clear = s[i, j] >= least + SLACK
        i, j = left[i], right[j]
        links: dict[tuple[int, int], tuple[int, int]] = {}
        # one link for two components is enough; single precision decides nothing near the bound
        for k in [*np.flatnonzero(clear).tolist(), *np.flatnonzero(~clear).tolist()]:
            x, y = component[i[k]], component[j[k]]
            if (min(x, y), max(x, y)) not in links and (clear[k] or similarity(blobs[i[k]], blobs[j[k]]) >= least):
                links[min(x, y), max(x, y)] = int(node[i[k]]), int(node[j[k]])
        return pa.table({"a": pa.array([x for x, _ in links.values()], pa.int64()), "b": pa.array([y for _, y in links.values()], pa.int64())})

    more = C.checkpointed(dealt.groupBy("hub", "low", "high").applyInArrow(compare_blocks, "a long, b long"))
    whole = components(links.union(more))

    placed = whole.join(nodes.select("node", "doc_id"), "node")
    low = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    class_of = placed.join(low, "component").select("node", "class_id")
    alone = nodes.join(class_of, "node", "left_anti").select("node", F.col("doc_id").alias("class_id"))
    out = signed.select("doc_id", "node").join(class_of.union(alone), "node", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the one with the smallest doc_id, of rows that repeat it any one.

    A null doc_id counts as -1. Texts without words are classes of their own, row by row.
    """
    ship(spark)
    numbered = C.checkpointed(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("whole"), F.monotonically_increasing_id().alias("row")))
    classes = near_duplicates(numbered.select(F.col("row").alias("doc_id"), F.col("whole")["text"].alias("text")))
    classes = C.checkpointed(classes.select(F.col("doc_id").alias("row"), "class_id"))
    ids = numbered.select("row", F.coalesce(F.col("whole")["doc_id"].cast("long"), F.lit(-1)).alias("doc_id"))
    best = classes.join(ids, "row").groupBy("class_id").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row"))
    # only rows that go meet the texts again, each by a number of its own
    gone = classes.join(best, "row", "left_anti").select("row")
    return numbered.join(gone, "row", "left_anti").select("whole.*")
