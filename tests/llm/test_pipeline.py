"""The pipeline from end to end: what each stage keeps, against plain computations of the same."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sedge.llm import minhash_dedup, quality_crf, secret_scan


@pytest.fixture(scope="module")
def kept(spark, data):
    """(doc_id, text) after quality, as the classifier's own query decides."""
    scores = {r.doc_id: r.predicted for r in quality_crf.op5_quality_crf(spark, data).collect()}
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect() if scores[r.doc_id])


def one_of_each_class(spark, docs):
    texts = [t.encode() for _, t in docs]
    doc, h, n, *_ = minhash_dedup.shingles(texts)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    table = minhash_dedup.idf_table(*minhash_dedup.document_frequencies(df))
    sets = [{} for _ in docs]
    for d, x, w in zip(doc.tolist(), h.tolist(), (n * table[minhash_dedup.slot(h)]).tolist(), strict=True):
        sets[d][x] = w
    low = list(range(len(docs)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if sets[a].keys() & sets[b].keys():
                least = sum(min(w, sets[b][x]) for x, w in sets[a].items() if x in sets[b])
                if least >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - least):
                    x, y = root(a), root(b)
                    low[max(x, y)] = min(x, y)
    return [d for k, d in enumerate(docs) if root(k) == k]


def without_passages(docs):
    first, out = {}, []
    for i, t in docs:
        w = t.split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, t in docs:
        w = t.split()
        hit = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                hit[p : p + 13] = [True] * 13
        left = " ".join(x for x, h in zip(w, hit, strict=True) if not h) if any(hit) else t
        if left or not any(hit):
            out.append((i, left))
    return out


def masked(spark, docs):
    """Base spans by plain patterns; the linked ones are the operator's, which has its own tests."""
    linked = {r.doc_id: [(s["start"], s["end"]) for s in r.linked] for r in secret_scan.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = []
    for i, t in docs:
        spans = [m.span() for m in assign.finditer(t) if len(m[1]) >= 6]
        spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        at, text = 0, ""
        for a, b in sorted(spans + linked[i]):
            if a >= at:
                text += t[at:a] + "[REDACTED]"
            at = max(at, b)
        out.append((i, text + t[at:]))
    return out


def test_rows_of_the_whole_run(spark, data, kept):
    assert 0 < len(kept) < 200
    want = masked(spark, without_passages(one_of_each_class(spark, kept)))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, data).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == {i for i, _ in want}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in want:
        ids, at = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes())), hashlib.sha256(t.encode()).hexdigest()
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_take_what_the_one_before_kept(spark, data, tmp_path):
    docs, columns = spark.read.parquet(f"{data}/documents.parquet"), None
    before = None
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, data)
        if k + 1 < len(corpus_pipeline.STAGES):
            columns = columns or docs.columns
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and (before is None or ids <= before), name
        before = ids
