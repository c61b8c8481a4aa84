"""Each operator's query on a whole small table against a plain computation of the same."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sedge.llm import minhash_dedup
from sedge.llm.hnsw import build
from sedge.llm.language_id import fit, forward, words_of
from sedge.llm.queries import queries


@pytest.fixture(scope="module")
def docs(spark, data):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect())


@pytest.fixture(scope="module")
def results(spark, data):
    cache = {}

    def get(name):
        if name not in cache:
            cache[name] = queries()[name](spark, data).collect()
        return cache[name]

    return get


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_packing(docs, results):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in results("op1_curve_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for (i, _), e in zip(docs, tok.encode_batch([t for _, t in docs], add_special_tokens=False), strict=True):
        ids, at = np.array([*e.ids, 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_secrets(docs, results):
    got = {r.doc_id: r for r in results("op2_secret_scan")}
    assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for i, t in docs:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        line = ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(spans))
        n = Counter(k for _, k, _ in spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == (n[0], n[1], n[2], sha(line))


def test_repeated_words(docs, results):
    got, first = {r.doc_id: r for r in results("op3_substring_dedup")}, {}
    for i, t in docs:
        w = t.encode().split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, t in docs:
        w = t.encode().split()
        hit = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                hit[p : p + 13] = [True] * 13
        kept = b" ".join(x for x, h in zip(w, hit, strict=True) if not h)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(hit), sha(kept))


def test_repeated_bytes(docs, results):
    got, seen = {r.doc_id: r for r in results("op7_suffix_dedup")}, set()
    for i, t in docs:
        b = t.encode()
        hit = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            if (x := b[p : p + 100]) in seen:
                hit[p] += 1
                hit[p + 100] -= 1
            seen.add(x)
        hit = np.cumsum(hit)[:-1] > 0
        runs = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~hit].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(hit.sum()), runs, sha(kept))


def test_pieces(docs, results):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in results("op4_piece_codec")}
    for (i, _), ids in zip(docs, lib.encode([t for _, t in docs], add_eos=True), strict=True):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


def test_quality(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # the smallest table has 19 held-out labels only
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = queries()["op5_quality_crf"](spark, data).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_near_duplicates(spark, data, docs, results):
    texts = [t.encode() for _, t in docs]
    doc, h, n, *_ = minhash_dedup.shingles(texts)
    table = minhash_dedup.idf_table(*minhash_dedup.document_frequencies(spark.read.parquet(f"{data}/documents.parquet")))
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
    got = {r.doc_id: r.class_id for r in results("op6_minhash_dedup")}
    assert got == {docs[k][0]: docs[root(k)][0] for k in range(len(docs))}


def test_media(docs, results):
    got = {r.doc_id: r for r in results("op8_media_columns")}
    for i, t in docs:
        b = t.encode()
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), sha(p), zlib.crc32(p[-64:]))
        media = f"P5\n64 {len(p) // 64}\n255\n".encode() + p
        step = sum(abs(p[k + 64] - p[k]) for k in range(len(p) - 64)) / len(p)
        mean = sum(p) / len(p)
        want = f"rows={len(p) // 64};mean={mean:.6f};var={sum(x * x for x in p) / len(p) - mean**2:.6f};step={step:.6f}"
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), sha(media), want)
        lines = [x for line in t.split("\n") if (x := " ".join(line.split()))]
        assert (r.n_items, r.position) == (len(lines) + 1, 1 if t.split("\n")[0].split() else 0)
        assert r.caption == (" ".join(lines[0][:80].split()) if lines else f"{len(t)} characters")


def test_vectors(spark, data, results):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    link = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    got = {r.vec_id: r.n_links for r in results("op9_embedding_dedup")}
    assert got == {r.vec_id: int(link[k].sum()) for k, r in enumerate(rows)}


def test_graph_finds_neighbours():
    x = np.random.default_rng(3).normal(size=(600, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = build(x, np.arange(600)).search(x, 32)
    best = np.argsort(-(x @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids, best, strict=True)]) >= 0.9


def test_language(spark, data, results):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = [r for r in results("op10_language_id") if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_forward_sums_all_segmentations():
    from sedge.llm.language_id import Pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    langs, p = fit({"a": ["ab abc bca"], "b": ["xyz zyx"]}, path, 2)
    pieces = Pieces(path)
    word = "▁" + words_of("abcab")[0]

    def total(k):
        if k == len(word):
            return np.ones(len(langs))
        out = np.zeros(len(langs))
        for n in range(1, min(12, len(word) - k) + 1):
            i = pieces.number.get(word[k : k + n], pieces.other if n == 1 else None)
            if i is not None:
                out = out + p[i] * total(k + n)
        return out

    assert np.allclose(forward(pieces.lattice([word]), p)[0, -1], total(0))


def test_words_fall_into_the_tokens_of_the_library():
    import random

    from sedge.llm.curve_packing import word_coder

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng, letters = random.Random(1), "abXY'sS’Σσς.,!éÉ́Åİıſß123_日本ª²ⅧͅΩǅ'tre llvem|-🙂\x00\x85\xa0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    got = word_coder(path).encode([t.encode() for t in texts])
    want = [np.array([*e.ids, 1], "<u2").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_added_tokens_are_those_of_the_library(spark):
    import random

    from sedge.llm.curve_packing import pack_documents, word_coder

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng, parts = random.Random(3), ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|", "é", "\u0301", "don", "'s", " ", "\n", "Σ", "ab"]
    texts = ["end of text <|endoftext|> next"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    want = [np.array([*e.ids, 1], "<u2").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert word_coder(path).encode([t.encode() for t in texts]) == want
    row = pack_documents(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).orderBy("start").collect()
    assert np.frombuffer(b"".join(r.ids for r in row), "<u4").tolist() == [806, 539, 4160, 49407, 1131, 1]


def test_segments_merge_as_in_the_library():
    import random

    from sedge.llm.piece_codec import agenda

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng, letters = random.Random(2), "ab theing \n\n  ▁é日\x00\t🙂<s>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(5000)]
    got = [[i for s in ss for i in s[1]] for ss in agenda(path).encode(texts)]
    assert got == lib.encode(texts)


def test_samples_are_least_over_all_shingles_though_few_are_worked_out(monkeypatch):
    from sedge.llm import common, minhash_dedup

    rng = np.random.default_rng(4)
    sizes = np.array([1, 2, 3, *rng.integers(1, 40, 30), *rng.integers(300, 600, 30)])
    doc = np.repeat(np.arange(len(sizes)) * 2, sizes)
    h = rng.integers(0, 1 << 63, len(doc)).astype(np.uint64)
    # one shingle may weigh more than all others, and all may weigh next to nothing
    weight = rng.uniform(0.8, 1.6, len(doc)) * np.where(rng.random(len(doc)) < 0.01, 5000, 1)
    weight[doc == 70] *= 1e-6
    odd, r, c, beta = minhash_dedup.variables()
    mixed, log_w = common.mix(h ^ np.uint64(0xD1B54A32D192ED03)), np.log(weight).astype(np.float32)
    want = []
    for d in np.unique(doc):
        at, keys = np.flatnonzero(doc == d), np.zeros(minhash_dedup.BANDS, np.uint64)
        for j in range(minhash_dedup.BANDS * minhash_dedup.ROWS):
            i = (mixed[at] * odd[j] >> np.uint64(64 - minhash_dedup.TABLE_BITS)).astype(np.int64)
            t = np.floor(log_w[at] / r[j][i] + beta[j][i])
            k = np.lexsort((mixed[at], c[j][i] - r[j][i] * (t - beta[j][i])))[:1]
            sample = common.mix(h[at][k] ^ common.mix(t[k].astype(np.int64).view(np.uint64)))
            band = slice(j // minhash_dedup.ROWS, j // minhash_dedup.ROWS + 1)
            keys[band] = common.mix(keys[band] * np.uint64(31) ^ sample)
        want.append(keys)
    counted, log_a = [], minhash_dedup.log_a
    monkeypatch.setattr(minhash_dedup, "log_a", lambda w, *a: counted.append(len(w)) or log_a(w, *a))
    which, got = minhash_dedup.signatures(doc, h, weight)
    assert (which == np.unique(doc)).all() and (got == np.array(want)).all()
    assert sum(counted) < len(doc) * len(odd) / 4
