"""Operator 10: language by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces (forward algorithm), a text's the
product over its words. The pieces' probabilities are fitted by expectation-maximisation with
the backward pass, on a bounded sample of documents of each language.
"""

from __future__ import annotations

import hashlib
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedge.llm import common as C
from sedge.llm.word_cache import WordCache
from sedge.shipping import ship

MODEL = "piece_bpe_32k.model"
#: Fitting takes at most so many documents of each language, of at most so many bytes each.
SAMPLE, SAMPLE_BYTES = 300, 1 << 14
#: Languages that a model holds at most, and parts of one whose ids are looked through apart.
LANGUAGES, PARTS = 256, 8
ROUNDS = 3
#: Longest piece, and the longest stretch of a word that is scored as one.
PIECE, STRETCH = 12, 32
#: Letters by Unicode category; a number sign such as a half or a square is none.
LETTERS = regex.compile(rf"\p{{L}}{{1,{STRETCH}}}")
#: Bytes of words' logs that are summed at a time.
SUM_BYTES = 8 << 20
FLOOR = 1e-7
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters; longer ones fall into stretches."""
    return LETTERS.findall(text.lower())


class Pieces:
    """Pieces of words: numbers of the vocabulary's pieces within each word's lattice."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {lib.id_to_piece(i).lower() for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        found = sorted(p for p in found if len(p) <= PIECE and (q := p.lstrip("▁")) and LETTERS.fullmatch(q) and len(p) - len(q) <= 1)
        self.number = {p: k for k, p in enumerate(found)}
        #: The number of every single letter that is no piece.
        self.other = len(found)

        letters = sorted(set().union(*found))
        #: A letter's number by code point, 0 where it occurs in no piece.
        self.letter = np.zeros(sys.maxunicode + 1, np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        heads = sorted({p[:k] for p in found for k in range(len(p) + 1)} | {""})
        node = {h: k for k, h in enumerate(heads)}
        #: Nodes of the tree of all beginnings: each one's piece, and its parent and last letter as one number.
        self.piece = np.array([self.number.get(h, -1) for h in heads], np.int32)
        self.keys = np.array([-1] + [node[h[:-1]] * self.width + int(self.letter[ord(h[-1])]) for h in heads[1:]], np.int64)
        bits = len(heads).bit_length() + 2
        self.shift, self.slots = C.U64(64 - bits), np.zeros(1 << bits, np.int32)
        left = np.arange(1, len(heads), dtype=np.int32)
        slot = self.slot(self.keys[left])
        while len(left):  # a node whose slot another took goes to the next
            free = self.slots[slot] == 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) % len(self.slots)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(C.U64) * C.U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def children(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node that a letter leads to from each node, 0 where there is none."""
        keys = nodes * self.width + letters
        slot = self.slot(keys)
        out = self.slots[slot]
        wrong = np.flatnonzero((out > 0) & (self.keys[out] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % len(self.slots)
            got = out[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(got > 0) & (self.keys[got] != keys[wrong])]
        return out

    def lattice(self, words: list[str]) -> np.ndarray:
        """[word, end, length - 1] for marked words of one length: piece numbers, -1 where there is none.

        From every place of all words the tree is walked in step, as far as it has the letters.
        """
        n, size = len(words), len(words[0])
        out = np.full((n, size, PIECE), -1, np.int32)
        flat = out.reshape(-1)
        letters = self.letter[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        end = np.arange(n * size)
        after = end[::-1] % size
        nodes = np.zeros(n * size, np.int64)
        for k in range(PIECE):
            nodes = self.children(nodes, letters[end]).astype(np.int64)
            p = self.piece[nodes]
            flat[end[p >= 0] * PIECE + k] = p[p >= 0]
            on = (nodes > 0) & (after > 0)
            end, after, nodes = end[on] + 1, after[on] - 1, nodes[on]
            if not len(end):
                break
        single = out[:, :, 0]
        single[single < 0] = self.other
        return out


def forward(lattice: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities of the first i characters (axis 1) of each word, summed over segmentations.

    p: piece by language, a last row of zeros for -1.
    """
    n, size, _ = lattice.shape
    a = np.zeros((n, size + 1, p.shape[1]))
    a[:, 0] = 1
    for end in range(1, size + 1):
        top = min(PIECE, end)
        q = p[lattice[:, end - 1, :top]]
        a[:, end] = np.einsum("nlk,nlk->nk", q, a[:, end - top : end][:, ::-1])
    return a


def backward(lattice: np.ndarray, p: np.ndarray) -> np.ndarray:
    n, size, _ = lattice.shape
    b = np.zeros((n, size + 1, p.shape[1]))
    b[:, size] = 1
    for start in range(size - 1, -1, -1):
        for length in range(1, min(PIECE, size - start) + 1):
            b[:, start] += p[lattice[:, start + length - 1, length - 1]] * b[:, start + length]
    return b


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        out.setdefault(len(w), []).append(k)
    return out


def fit(texts: dict[str, list[str]], path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and log-free piece probabilities by language (a last row of zeros)."""
    pieces, langs = Pieces(path), sorted(texts)
    if not langs:
        return [], np.zeros((pieces.other + 2, 0))
    counts = [Counter(chain.from_iterable(words_of(t) for t in texts[k])) for k in langs]
    words = sorted(set().union(*counts))
    marked = ["▁" + w for w in words]
    weight = np.array([[c[w] for c in counts] for w in words], float).reshape(-1, len(langs))
    groups = [(np.array(ks), pieces.lattice([marked[k] for k in ks])) for ks in by_length(marked).values()]
    n = pieces.other + 1
    size = np.array([len(p) for p in pieces.number] + [1], float)
    start = np.exp(-size)[:, None]
    p = np.vstack([np.repeat(start / start.sum(), len(langs), 1), np.zeros((1, len(langs)))])
    for _ in range(rounds):
        expected = np.zeros((n + 1, len(langs)))
        for ks, lattice in groups:
            for at in range(0, len(ks), 4096):
                lat, w = lattice[at : at + 4096], weight[ks[at : at + 4096]]
                a, b = forward(lat, p), backward(lat, p)
                share = w / a[:, -1]
                for end in range(1, lat.shape[1] + 1):
                    for length in range(1, min(PIECE, end) + 1):
                        ids = lat[:, end - 1, length - 1]
                        ok = ids >= 0
                        if ok.any():
                            np.add.at(expected, ids[ok], a[ok, end - length] * p[ids[ok]] * b[ok, end] * share[ok])
        p = expected[:n] / np.maximum(expected[:n].sum(0), 1)
        p = np.vstack([np.maximum(p, FLOOR), np.zeros((1, len(langs)))])
    return langs, p


class Scorer:
    """Log probabilities of words by language, remembered as bytes."""

    def __init__(self, path: str, p: np.ndarray):
        self.pieces, self.p = Pieces(path), p
        self.seen = WordCache(self.score_words, lambda v: 40 + len(v), 192 << 20)

    def score_words(self, words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        marked = ["▁" + w for w in words]
        for ks in by_length(marked).values():
            for at in range(0, len(ks), 4096):
                part = ks[at : at + 4096]
                logs = np.log(forward(self.pieces.lattice([marked[k] for k in part]), self.p)[:, -1])
                for k, x in zip(part, logs, strict=True):
                    out[k] = x.tobytes()
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """Sum over a text's words for each language, in their order; nan without a letter."""
        words: list[str] = []
        size = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            ws = words_of(t)
            words += ws
            size[k] = len(ws)
        known = self.seen.known_for(words)
        n = self.p.shape[1]
        out, text = np.zeros((len(texts), n)), np.repeat(np.arange(len(texts)), size)
        step = SUM_BYTES // (8 * max(n, 1))
        for at in range(0, len(words), step):
            part, of = words[at : at + step], text[at : at + step]
            logs = np.frombuffer(b"".join(map(known.__getitem__, part))).reshape(len(part), n).copy()
            first, last = of[0], of[-1] + 1
            logs[0] += out[first]  # of the words before this step
            for k in range(n):
                out[first:last, k] = np.bincount(of - first, logs[:, k], last - first)
        out[size == 0] = np.nan
        return out


_scorers: dict[bytes, Scorer] = {}


def learning(docs: DataFrame) -> DataFrame:
    """Rows that a model may learn from: crc32(doc_id as text) mod 5 is not 0."""
    return docs.filter(fold() != 0)


def fold() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def sample_texts(docs: DataFrame, per_language: int, max_bytes: int) -> dict[str, list[str]]:
    """Texts of the sample by language: the smallest hashes of doc_id among rows of up to max_bytes.

    The ids are found first, without texts; each task passes on at most per_language of each.
    Of rows that repeat a picked doc_id and language one counts, the one with the smallest text
    by hash. At most LANGUAGES languages are learned, those with most rows.
    """
    rows = learning(docs).filter(F.col("lang").isNotNull() & (F.octet_length("text") <= max_bytes))
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    rows = rows.join(F.broadcast(langs), "lang")
    ids = rows.select("doc_id", "lang").distinct().withColumn("part", F.pmod(F.hash("doc_id"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):  # a common language's ids are thinned out in parts first
        w = Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_language)
    ids = ids.select("doc_id", "lang")
    one = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    got: dict[str, list[str]] = {}
    for r in one.orderBy("doc_id", "lang").collect():
        got.setdefault(r.lang, []).append(r.text)
    return got


def identify(docs: DataFrame, per_language: int = SAMPLE, model_path: str | None = None) -> DataFrame:
    """Row per document: doc_id, held_out, lang_pred, score (posterior of the answer, even prior).

    Learns from text and lang of at most per_language documents of each language, of at most
    SAMPLE_BYTES bytes, where crc32(doc_id as text) mod 5 is not 0; the whole text of every
    document is scored. A null text, one without a letter, or tables without any learnable row
    give `und` and score 0. Equal scores go to the first language by name. Rows that repeat a
    doc_id are scored each; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    path = model_path or public_tokenizers.path(MODEL)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    langs, p = fit(sample_texts(docs, per_language, SAMPLE_BYTES), path)
    model = spark.sparkContext.broadcast(p)
    key = hashlib.sha256(p.tobytes() + path.encode()).digest()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(path, model.value)
        scorer = _scorers[key]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = scorer.score([x.as_py() or "" for x in part.column("text")])
                none = np.isnan(s).any(axis=1) if len(langs) else np.ones(part.num_rows, bool)
                pred, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if len(langs):
                    s = np.where(none[:, None], 0, s)
                    best = s.argmax(axis=1)
                    post = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                    pred[~none], score[~none] = np.array(langs, object)[best][~none], post[~none]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    docs = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return docs.mapInArrow(C.lean(f, words=True), "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(C.documents(spark, sf_dir))
