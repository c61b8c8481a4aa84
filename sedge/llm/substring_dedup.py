"""Operator 3: repeated passages of words, by suffix trees of prefix groups.

A window of 13 words is where a suffix starts. Suffixes are grouped by the five words that
their window chose as its least by hash (see `repeats`), so that a stretch of text goes to a
group once for all its suffixes; what only one document has, and whole stretches that equal
earlier ones, never get there. Where more than HOT stretches share the five words, the prefix is
the whole window instead. The task that holds a group sorts its suffixes and knows how many words
neighbours share, which is the group's subtree; its internal nodes of 13 words and more are the
repeats. A node's smallest doc_id keeps its words, in all other documents they go.
"""

from __future__ import annotations

from functools import partial
from itertools import chain, compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import common as C
from sedge.llm.repeats import HOT, Chunk, Rule, repeats

WINDOW = 13
GRAM = 5


class Subtree:
    """The suffix tree of some suffixes, cut off at a depth: sorted leaves, and words that neighbours share."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, depth: int):
        bits = max(1, int(words.max(initial=0)).bit_length())
        keys = []
        for k in range(0, depth, 63 // bits):
            key = np.zeros(len(starts), np.int64)
            for j in range(k, min(k + 63 // bits, depth)):
                key = key << bits | words[starts + j]
            keys.append(key)
        self.leaves = np.lexsort(keys[::-1])
        at = starts[self.leaves]
        self.shared = np.zeros(max(len(at) - 1, 0), np.int64)
        same = np.ones(len(self.shared), bool)
        for j in range(depth):
            same &= words[at[1:] + j] == words[at[:-1] + j]
            self.shared += same

    def nodes(self, depth: int) -> np.ndarray:
        """For each leaf in order, the number of the topmost node of this depth or more above it, or its own."""
        return np.cumsum(np.concatenate(([0], self.shared < depth))) if len(self.leaves) else self.leaves


def decide(window: int, stretches: list[bytes], windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which suffixes lie below a node that a smaller doc_id is below as well."""
    split = [t.split() for t in stretches]
    known: dict[bytes, int] = {}
    words = np.array([known.setdefault(w, len(known)) for w in chain.from_iterable(split)], np.int64)
    sizes = np.array([len(s) for s in split], np.int64)
    begins = np.cumsum(sizes) - sizes
    starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begins, windows)
    tree = Subtree(words, starts, window)
    node, doc = tree.nodes(window), np.repeat(docs, windows)
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc[tree.leaves])
    late = np.empty(len(node), bool)
    late[tree.leaves] = doc[tree.leaves] > least[node]
    return late


def rule_of(window: int, gram: int, hot: int) -> Rule:
    return Rule(True, window, gram, partial(decide, window), hot)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Row per document: doc_id, n_words, n_removed, spans, kept (words joined by one space).

    Words are runs of other than ASCII white space, unchanged. A word goes if some `window`
    consecutive words of its document that cover it also occur, from any word on, in a document
    with a smaller doc_id of the input. Null or empty text: no words, kept is ''. A null
    doc_id counts as -1. Rows that repeat a doc_id are documents of their own that don't
    erase each other. spans lists [start, end) of the maximal runs of words that go. Other
    columns of docs are ignored.
    """

    def emit(chunk: Chunk, k: int, hit) -> tuple:
        words = chunk.text(k).split()
        kept = list(compress(words, ~hit)) if hit.any() else words
        spans = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])))).reshape(-1, 2).tolist() if hit.any() else []
        return len(words), len(words) - len(kept), spans, b" ".join(kept).decode("utf-8", "replace")

    return repeats(docs, rule_of(window, gram, hot), "n_words long, n_removed long, spans array<array<long>>, kept string", emit)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(C.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the words that remain as text; a text that loses nothing stays as it is.

    Documents that lose all their words go. The other columns lie with the texts meanwhile.
    """

    def emit(chunk: Chunk, k: int, hit) -> tuple:
        text = chunk.text(k)
        if hit.any():
            text = b" ".join(compress(text.split(), ~hit))
        return text.decode("utf-8", "replace"), bool(hit.any())

    columns = docs.columns
    rest = [c for c in columns if c not in ("text", "n_chars")]
    null = next(n for k in range(len(columns) + 1) if (n := f"text_is_null_{k}") not in columns)
    whole = docs.withColumn(null, F.col("text").isNull())
    out = repeats(whole, rule_of(window, gram, HOT), "kept string, changed boolean", emit, carry=(*rest, null))
    out = out.filter(~F.col("changed") | (F.col("kept") != ""))
    text = F.when(F.col("changed") | ~F.col(f"carried_{len(rest)}"), F.col("kept"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"carried_{rest.index(c)}").alias(c) for c in columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return without_repeats(docs)
