"""Operator 5: quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and its neighbours'; the chain's
forward-backward marginals, weighted by line length, add up to a document's quality, which a
fitted logistic curve turns into a probability. Labels are of documents: in fitting, a line has
its document's label, and the chain's transitions carry the agreement of lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import common as C
from sedge.llm.language_id import fold
from sedge.shipping import ship

#: Fitting takes the rows with the smallest hashes among learnable labels: at most so many, of so many bytes and lines each.
SAMPLE, SAMPLE_BYTES, SAMPLE_LINES = 3000, 1 << 15, 256
STEPS, RATE, DECAY = 150, 0.05, 1e-3
THRESHOLD = 0.3
#: Bytes of text that are scored together.
PART_BYTES = 1 << 20

_SETS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"#$%&*@^~=+\\", b"|", b"<>{}[]()/_", b".,;:?'\"-", b" \t\r", b"aeiou", bytes(range(128, 256))]
_CLASSES = np.zeros((256, len(_SETS)), bool)
for _k, _s in enumerate(_SETS):
    _CLASSES[np.frombuffer(_s, np.uint8), _k] = True
_END = np.zeros(256, bool)
_END[np.frombuffer(b".!?:;\"'", np.uint8)] = True
#: Features of a line itself.
OWN = len(_SETS) + 6


@dataclass
class Lines:
    """Lines of texts, text by text: own features (the last says whether a line is repeated in its text), bytes, text."""

    own: np.ndarray
    size: np.ndarray
    doc: np.ndarray

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a line is its text's first, and last."""
        first = np.concatenate(([True], self.doc[1:] != self.doc[:-1]))
        return first, np.concatenate((first[1:], [True]))

    def full(self) -> np.ndarray:
        """Own features, those of the line before and after, and the edges."""
        first, last = self.edges()
        before = np.where(first[:, None], 0, np.roll(self.own, 1, 0))
        after = np.where(last[:, None], 0, np.roll(self.own, -1, 0))
        return np.column_stack((self.own, before, after, first, last))

    def weigh(self, w: np.ndarray) -> np.ndarray:
        """full() @ w, without that matrix."""
        first, last = self.edges()
        own, before, after = (self.own @ v for v in np.split(w[: 3 * OWN], 3))
        out = own + first * w[-2] + last * w[-1]
        out[1:] += np.where(first[1:], 0, before[:-1])
        out[:-1] += np.where(last[:-1], 0, after[1:])
        return out


def piece_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features but the last, size and hash of the lines that end within data."""
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts
    n = np.maximum(size, 1)
    own = np.zeros((len(ends), OWN), np.float32)
    for k in range(len(_SETS)):
        total = np.concatenate(([0], np.cumsum(_CLASSES[data, k], dtype=np.int64)))
        own[:, k] = (total[ends] - total[starts]) / n
    a, b = C.word_spans(data)
    line = np.searchsorted(ends, a)
    words = np.bincount(line, minlength=len(ends))
    pair = np.unique(C.join(C.stretch_hashes(data, a, b), line.astype(np.uint64)), return_index=True)[1]
    distinct = np.bincount(line[pair], minlength=len(ends))
    some = size > 0
    k = len(_SETS)
    own[:, k] = np.log1p(size)
    own[:, k + 1] = np.where(words > 0, (size / np.maximum(words, 1)).clip(0, 30) / 10, 0)
    own[:, k + 2] = np.where(words > 0, distinct / np.maximum(words, 1), 1)
    own[:, k + 3] = some & _END[data[np.maximum(ends - 1, 0)]]
    own[:, k + 4] = some & _CLASSES[data[starts], 0]
    return own, size, C.stretch_hashes(data, starts, ends)


def lines_of(texts: list[bytes]) -> Lines:
    """Lines of texts, of which each has one at least; bytes' own arrays are made for about PART_BYTES of whole lines at a time."""
    data = np.frombuffer(b"".join([t + b"\n" for t in texts]), np.uint8)
    ends = np.flatnonzero(data == 10)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), ends, "right")
    cuts = np.unique(np.concatenate((ends[np.searchsorted(ends, np.arange(PART_BYTES, len(data), PART_BYTES))] + 1, [0, len(data)])))
    found = [piece_features(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    own, size, whole = (np.concatenate(c) for c in zip(*found, strict=True))
    _, which, times = np.unique(C.join(whole, doc.astype(np.uint64)), return_inverse=True, return_counts=True)
    own[:, -1] = (times[which] > 1) & (size > 0)
    return Lines(own, size, doc)


def lines_in_parts(texts: list[bytes]) -> Lines:
    """lines_of for many texts, PART_BYTES at a time."""
    found, first, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= PART_BYTES or k + 1 == len(texts):
            x = lines_of(texts[first : k + 1])
            found.append((x.own, x.size, x.doc + first))
            first, size = k + 1, 0
    return Lines(*[np.concatenate(c) for c in zip(*found, strict=True)])


class Chains:
    """Lines of texts as chains that are walked side by side, line number by line number, longest first."""

    def __init__(self, doc: np.ndarray, n_docs: int):
        counts = np.bincount(doc, minlength=n_docs)
        order = np.argsort(-counts, kind="stable")
        self.begins = (np.cumsum(counts) - counts)[order]
        self.longest = int(counts.max(initial=1))
        #: Chains of more than k lines, for each k.
        self.alive = np.searchsorted(-counts[order], -np.arange(1, self.longest + 1), "right").tolist()

    def messages(self, u: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log odds; t[y, z] scores label y before label z."""
        fwd, bwd = u.copy(), np.zeros(len(u))
        for k in range(1, self.longest):
            at = self.begins[: self.alive[k]] + k
            x = fwd[at - 1]
            fwd[at] += np.logaddexp(x + t[1, 1], t[0, 1]) - np.logaddexp(x + t[1, 0], t[0, 0])
        for k in range(self.longest - 2, -1, -1):
            at = self.begins[: self.alive[k + 1]] + k
            x = u[at + 1] + bwd[at + 1]
            bwd[at] = np.logaddexp(x + t[1, 1], t[1, 0]) - np.logaddexp(x + t[0, 1], t[0, 0])
        return fwd, bwd


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(x, -60, 60) / 2))


class Field:
    """Weights of lines' features, transitions, and the curve from marginals to probability."""

    def __init__(self, n: int):
        self.mean, self.scale = np.zeros(n), np.ones(n)
        self.w, self.bias, self.t = np.zeros(n), 0.0, np.zeros((2, 2))
        self.curve = (0.0, 1.0)

    def marginals(self, lines: Lines, chains: Chains) -> np.ndarray:
        w = self.w / self.scale
        fwd, bwd = chains.messages(lines.weigh(w) + (self.bias - self.mean @ w), self.t)
        return sigmoid(fwd + bwd)

    def quality(self, lines: Lines, n: int) -> np.ndarray:
        """Length-weighted mean marginal of each of n texts; an empty text has its one empty line's."""
        p = self.marginals(lines, Chains(lines.doc, n))
        weight = np.maximum(lines.size, 1e-3)
        return np.bincount(lines.doc, p * weight, n) / np.bincount(lines.doc, weight, n)

    def score(self, texts: list[bytes]) -> np.ndarray:
        q = np.clip(self.quality(lines_of(texts), len(texts)), 1e-4, 1 - 1e-4)
        return sigmoid(self.curve[0] + self.curve[1] * np.log(q / (1 - q)))


def fit(texts: list[bytes], labels: np.ndarray) -> Field:
    """Adam on the penalised likelihood of the chains, then Newton steps for the curve."""
    field = Field(3 * OWN + 2)
    if not texts:
        return field
    lines = lines_in_parts(texts)
    doc, z = lines.doc, lines.full().astype(float)
    field.mean, field.scale = z.mean(0), np.maximum(z.std(0), 1e-6)
    z -= field.mean
    z /= field.scale
    y = labels[doc].astype(float)
    chains = Chains(doc, len(texts))
    follow = np.flatnonzero(doc[1:] == doc[:-1])
    seen = np.array([[((1 - y[follow]) * (1 - y[follow + 1])).sum(), 0], [0, (y[follow] * y[follow + 1]).sum()]])
    g1, g2 = np.zeros(z.shape[1] + 5), np.zeros(z.shape[1] + 5)
    for step in range(1, STEPS + 1):
        u = z @ field.w + field.bias
        fwd, bwd = chains.messages(u, field.t)
        p = sigmoid(fwd + bwd)
        i, j = follow, follow + 1
        ahead = u[j] + bwd[j]
        s = np.stack([field.t[0, 0] + 0 * ahead, field.t[0, 1] + ahead, field.t[1, 0] + fwd[i], field.t[1, 1] + fwd[i] + ahead])
        s = np.exp(s - s.max(0, initial=-np.inf))
        pairs = (s / s.sum(0)).sum(1).reshape(2, 2)
        n = len(y)
        grad = np.concatenate((z.T @ (y - p) / n - DECAY * field.w, [(y - p).mean()], ((seen - pairs) / n - DECAY * field.t).ravel()))
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad**2
        move = RATE * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.999**step)) + 1e-8)
        field.w += move[: len(field.w)]
        field.bias += move[len(field.w)]
        field.t += move[-4:].reshape(2, 2)
    q = np.clip(field.quality(lines, len(texts)), 1e-4, 1 - 1e-4)
    a = np.column_stack((np.ones(len(q)), np.log(q / (1 - q))))
    c = np.array([0.0, 1.0])
    for _ in range(25):
        p = sigmoid(a @ c)
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        c = c + np.linalg.solve(h, a.T @ (labels - p) - 0.1 * (c - [0, 1]))
    field.curve = (float(c[0]), float(max(c[1], 1e-3)))
    return field


def sample_labels(docs: DataFrame, labels: DataFrame, rows: int, max_bytes: int, max_lines: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of the bounded sample; the ids are chosen before any text moves.

    Of rows that repeat a picked doc_id one counts, the one with the smallest text by hash.
    """
    picked = labels.filter(F.col("quality").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    fits = (F.octet_length("text") <= max_bytes) & (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < max_lines)
    texts = docs.filter(fits).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    one = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    got = one.orderBy("doc_id").select("text", "quality").collect()
    return [r.text.encode() for r in got], np.array([float(r.quality > 0) for r in got])


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Row per document: doc_id, held_out, score, predicted.

    Learns from at most `rows` labelled documents of up to SAMPLE_BYTES bytes and SAMPLE_LINES lines whose crc32(doc_id
    as text) mod 5 is not 0 (a doc_id with several labels counts with the highest); every whole
    text is scored from its text alone. Null texts are empty; an empty text is one empty line.
    Without any label to learn from, all scores are 0.5. Repeated rows are scored each; a null
    doc_id is not held out. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(fit(*sample_labels(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), rows, SAMPLE_BYTES, SAMPLE_LINES)))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in C.parts(b, PART_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(model.value.score(texts))], names=["doc_id", "held_out", "score"])

    docs = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    out = docs.mapInArrow(C.lean(f), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not rejected; scored and filtered row by row, so no text moves."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(fit(*sample_labels(ids, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), rows, SAMPLE_BYTES, SAMPLE_LINES)))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in C.parts(b, PART_BYTES):
                yield part.filter(pa.array(model.value.score(texts) >= THRESHOLD))

    return docs.mapInArrow(C.lean(f), docs.schema)
