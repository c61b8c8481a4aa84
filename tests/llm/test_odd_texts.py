"""Long and odd texts, planted collisions, repeated rows and rules that whole tables seldom meet."""

from __future__ import annotations

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sedge.llm import curve_packing, embedding_dedup, language_id, media_columns, piece_codec, quality_crf, repeats, substring_dedup, suffix_dedup


def table(spark, texts):
    return spark.createDataFrame([*enumerate(texts, 1)], "doc_id long, text string")


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") & 1] for k in range(n))


def test_words_that_beat_polynomial_hashes(spark):
    a, b = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    around = " ".join(f"q{k}" for k in range(6))
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(table(spark, [f"{around} {x} {around}" for x in (a, b, a)])).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def passages(rng, n):
    """Texts that share passages with many different surroundings."""
    words = [f"w{k}" for k in range(12)]
    common = " ".join(rng.choice(words) for _ in range(30))
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(2)]
        cut = common.split()
        parts.insert(1, " ".join(cut[rng.randint(0, 4) : rng.randint(20, 30)]))
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    return out + out[:3]


@pytest.mark.parametrize("hot", [0, 3, 4096])
def test_hot_grams_give_the_same_words(spark, hot):
    texts = passages(random.Random(4), 40)
    first, want = {}, {}
    for i, t in enumerate(texts, 1):
        w = t.split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, t in enumerate(texts, 1):
        w = t.split()
        hit = np.zeros(len(w), bool)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                hit[p : p + 13] = True
        want[i] = (int(hit.sum()), " ".join(x for x, h in zip(w, hit, strict=True) if not h))
    got = substring_dedup.remove_repeats(table(spark, texts), hot=hot).collect()
    assert {r.doc_id: (r.n_removed, r.kept) for r in got} == want
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize("hot", [0, 3, 4096])
def test_hot_grams_give_the_same_bytes(spark, hot):
    texts = passages(random.Random(5), 25)
    seen, want = set(), {}
    for i, t in enumerate(texts, 1):
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                hit[p : p + 100] = True
            seen.add(b[p : p + 100])
        want[i] = bytes(x for x, h in zip(b, hit, strict=True) if not h)
    got = suffix_dedup.remove_repeated_bytes(table(spark, texts), hot=hot).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == want


@pytest.mark.parametrize("words", [True, False])
def test_long_texts_in_parts(monkeypatch, words):
    """Slices of long documents give the same runs' windows, each once, with the same bytes."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["ab", "c", "defg"]) for _ in range(n)).encode() for n in (300, 2, 90, 500)] + [b"", b" " * 700, b"x" * 400]
    chunk = repeats.Chunk(repeats.Chunk.pack(np.arange(len(texts)), texts))
    rule = repeats.Rule(words, 13 if words else 40, 5 if words else 16, None)

    def windows():
        slices = list(chunk.slices(rule))
        r = repeats.runs_of(rule, chunk, True)
        run, at = repeats.spread(r, np.arange(len(r.doc)))
        got = []
        for k, a in zip(run.tolist(), at.tolist(), strict=True):
            x = slices[r.slice[k]]
            begin = x.offset + int(x.starts[a]) - int(chunk.offsets[r.doc[k]])
            got.append((int(r.doc[k]), begin, int(r.gram[k])))
        assert all(chunk.data[a:b].split() if words else b - a >= 40 for a, b in zip(r.start.tolist(), r.end.tolist(), strict=True))
        return sorted(got)

    whole = windows()
    monkeypatch.setattr(repeats, "SLICE", 200)
    assert windows() == whole and len({w[:2] for w in whole}) == len(whole)


@pytest.mark.parametrize("slices", [64, 256])
def test_long_documents_lose_the_same(monkeypatch, slices):
    """What late windows cover, put together from parts."""
    texts = [" ".join(passages(random.Random(k), 4)) for k in range(6)]
    chunk = repeats.Chunk(repeats.Chunk.pack(np.arange(6), [t.encode() for t in texts]))
    rule = repeats.Rule(True, 13, 5, substring_dedup.rule_of(13, 5, 99).decide)

    def covered():
        s = repeats.State.__new__(repeats.State)
        s.rule, s.chunk = rule, chunk
        s.runs = repeats.runs_of(rule, chunk, True)
        run, at = repeats.spread(s.runs, np.arange(len(s.runs.doc)))
        x = list(chunk.slices(rule))
        # every seventh window of a document is late, by its place in the document
        place = np.array([x[s.runs.slice[k]].first + a - x[s.runs.slice[k]].begins[s.runs.doc[k] - x[s.runs.slice[k]].doc] for k, a in zip(run.tolist(), at.tolist(), strict=True)])
        s.text, s.text_late = np.arange(len(s.runs.doc)), place % 31 == 0
        s.first = np.ones(len(s.runs.doc), bool)
        s.window_run, s.window_at, s.late = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return [(k, hit.tolist()) for k, hit in s.covered()]

    whole = covered()
    assert len(whole) == 6
    monkeypatch.setattr(repeats, "SLICE", slices)
    assert covered() == whole


def test_buckets_are_decided_in_parts(monkeypatch):
    """Whatever the parts, a window's first occurrence stays: each gram's stretches come together and in order."""
    rng = np.random.default_rng(11)
    grams = rng.integers(0, 9, 60).astype(np.uint64)
    texts = [b"a%d g%d x%d b" % (rng.integers(0, 2), g, rng.integers(0, 3)) for g in grams]
    counts, docs = np.full(60, 2), rng.integers(0, 20, 60)
    rule = substring_dedup.rule_of(3, 1, 100)
    whole = substring_dedup.decide(3, texts, counts, docs)
    monkeypatch.setattr(repeats, "PART_BYTES", 50)
    assert (repeats.decide_in_parts(rule, grams, texts, counts, docs) == whole).all() and whole.any()


def test_subtree_depths():
    words = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 9])
    tree = substring_dedup.Subtree(words, np.array([0, 3, 6]), 3)
    assert tree.leaves.tolist() == [0, 2, 1] and tree.shared.tolist() == [3, 2]
    assert tree.nodes(3).tolist() == [0, 0, 1] and tree.nodes(2).tolist() == [0, 0, 0]


def test_one_rank_of_different_strings():
    """Strings that collide are told apart by their bytes: ranks are made equal by hand."""
    texts = [b"a" * 100, b"b" * 100, b"a" * 100, b"b" * 100]
    rerank = suffix_dedup.rerank
    suffix_dedup.rerank = lambda rank, other: (np.zeros(len(rank), np.int64), np.ones(len(rank), bool))
    try:
        got = suffix_dedup.decide(100, texts, np.ones(4, np.int64), np.arange(4))
    finally:
        suffix_dedup.rerank = rerank
    assert got.tolist() == [False, False, True, True]


@pytest.mark.parametrize("letters", ["etaoinshrdlu", "aé日b", "ab0"])
def test_unbroken_runs_are_coded_as_by_the_libraries(letters):
    rng = random.Random(6)
    t = "".join(rng.choice(letters) for _ in range(50_000))
    path = public_tokenizers.path("word_bpe_49k.json")
    want = [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1]
    assert np.frombuffer(curve_packing.word_coder(path).encode([t.encode()])[0], "<u2").tolist() == want
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = [i for s in piece_codec.agenda(path).encode([t])[0] for i in s[1]]
    assert got == sentencepiece.SentencePieceProcessor(model_file=path).encode(t)


def test_chains_sum_over_all_labellings():
    rng = np.random.default_rng(7)
    field = quality_crf.Field(3 * quality_crf.OWN + 2)
    field.w, field.t, field.bias = rng.normal(size=len(field.w)), rng.normal(size=(2, 2)), 0.3
    field.mean, field.scale = rng.normal(size=len(field.w)), rng.uniform(1, 2, len(field.w))
    texts = [b"Hello world.\nAAA !!!\nfoo bar\nfoo bar\n\n12|3", b"", b"one", b"\n\n"]
    lines = quality_crf.lines_of(texts)
    unary = ((lines.full() - field.mean) / field.scale) @ field.w + field.bias
    got, t = field.marginals(lines, quality_crf.Chains(lines.doc, len(texts))), field.t
    quality = field.quality(lines, len(texts))
    for d in range(len(texts)):
        u, size = unary[lines.doc == d], np.maximum(lines.size[lines.doc == d], 1e-3)
        total, sums = 0.0, np.zeros(len(u))
        for y in itertools.product((0, 1), repeat=len(u)):
            s = np.exp(sum(u[k] * y[k] for k in range(len(u))) + sum(t[y[k], y[k + 1]] for k in range(len(u) - 1)))
            total, sums = total + s, sums + s * np.array(y)
        assert np.allclose(got[lines.doc == d], sums / total, atol=1e-5)
        assert np.isclose(quality[d], (sums / total * size).sum() / size.sum(), atol=1e-5)


def test_many_blank_lines_are_scored_within_bounds():
    import tracemalloc

    field = quality_crf.Field(3 * quality_crf.OWN + 2)
    tracemalloc.start()
    assert np.allclose(field.score([b"\n" * 100_000] + [b""] * 2000), 0.5)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_pieces_of_long_texts_have_the_same_features(monkeypatch):
    texts = [b"some words here\nAND there !\n\n" * 50, b"", b"x" * 300 + b"\ny"]
    whole = quality_crf.lines_of(texts)
    monkeypatch.setattr(quality_crf, "PART_BYTES", 64)
    parts = quality_crf.lines_of(texts)
    assert (whole.own == parts.own).all() and (whole.size == parts.size).all() and (whole.doc == parts.doc).all()


def test_repeated_rows_do_not_widen_samples(spark):
    rows = [(k % 7, f"text {k} und so", "de") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(7)], "doc_id long, quality int")
    texts, _ = quality_crf.sample_labels(docs, labels, 100, 1000, 10)
    assert 0 < len(texts) <= 7
    assert 0 < len(language_id.sample_texts(docs, 100, 1000)["de"]) <= 7


def test_number_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(["some words of text", "more of this text", "½ ²", "①Ⅷ", "ª", "x½"])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert [got[k] for k in range(6)] == ["en", "en", "und", "und", "en", "en"]


def test_vectors_of_one_id(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, x, 1), (5, y, 2), (6, x, 1), (7, y, 2), (8, [0.0, 0.99, 0.01], 2), (9, [0.0, 0.0, 1.0], 1), (9, [1.0, 0.05, 0.0], 1)]
    got = embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 2, 5), (8, 2, 5), (9, 0, 5), (9, 2, 5)]


def test_audits_widen_beams():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x[1500:] = x[:1500] + 0.01 * rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embedding_dedup.build(x.astype(np.float32), np.arange(3000))
    true = {tuple(p) for p in np.argwhere(x @ x.T >= 0.98)}
    for beam in (1, 64):
        q, n = embedding_dedup.links_of(x, x, graph, 0.98, np.arange(3000) % 20 == 0, beam)
        found = set(zip(q.tolist(), n.tolist(), strict=True))
        assert found <= true and len(found) >= 0.97 * len(true)


def test_figures_keep_their_captions():
    html = "<p>a<figure><figcaption>Cap <b>x</b></figcaption><img src='digest:1' alt=z></figure><img src=b alt=q><template><img src=t></template><noscript>n<img src=u></noscript>end<figure><img src=c><p>in</p><img src=d><figcaption>two<br>lines</figcaption></figure>"
    got = [x[1:] for x in media_columns.sequence_of(html)]
    assert got == [("text", "a", None, None), ("media", None, "1", "Cap x"), ("media", None, "b", "q"), ("text", "end", None, None), ("media", None, "c", "two lines"), ("text", "in", None, None), ("media", None, "d", "two lines")]


def test_pages_give_ordered_items(spark, data):
    """Real pages with references planted between their elements, by way of a digest join."""
    rng = random.Random(9)
    pages, want = [], {}
    for r in spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").limit(20).collect():
        parts, names = r.html.split("<p>"), []
        for k in range(1, len(parts)):
            if rng.random() < 0.5:
                names.append((f"d{rng.randint(0, 5)}", f"page {r.page_id} item {k}"))
                parts[k] = f"<figure><img src='digest:{names[-1][0]}'><figcaption>{names[-1][1]}</figcaption></figure>" + parts[k]
        pages.append((r.page_id, "<p>".join(parts)))
        want[r.page_id] = names
    store = spark.createDataFrame([(f"d{k}", k * 10) for k in range(5)], "digest string, size long")
    seq = media_columns.interleave(spark.createDataFrame(pages, "page_id long, html string"), "page_id", "html")
    plain = {r.page_id: r["items"] for r in media_columns.interleave(spark.read.parquet(f"{data}/pages.parquet"), "page_id", "html").collect()}
    for r in seq.collect():
        assert [x["position"] for x in r["items"]] == list(range(len(r["items"])))
        text = lambda items: " ".join(x["text"] for x in items if x["kind"] == "text")
        assert text(r["items"]).split() == text(plain[r.page_id]).split() and "track(" not in text(r["items"])
    got = {}
    for r in media_columns.resolve(seq, "page_id", store).orderBy("page_id", "position").collect():
        got.setdefault(r.page_id, []).append((r.digest, r.caption))
        assert r["size"] == (int(r.digest[1:]) * 10 if r.digest != "d5" else None)
    assert got == {k: v for k, v in want.items() if v}


def test_tokens_are_merged_once_and_long_documents_leave_in_small_batches():
    import pyarrow as pa

    from sedge.llm import common

    coder = curve_packing.WordCoder(public_tokenizers.path("word_bpe_49k.json"))
    merged, merge_all = [], coder.merges.merge_all
    coder.merges.merge_all = lambda flat, sizes: merged.extend(sizes.tolist()) or merge_all(flat, sizes)
    texts = ["Word, word WORD. word!! Été été", "", "word. ,"]
    want = [[*Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(t, add_special_tokens=False).ids, 1] for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode([t.encode() for t in texts])] == want
    # word, a comma, a full stop, two exclamation marks and the French word
    assert sorted(merged) == sorted(len(t.encode()) for t in ["word", ",", ".", "!!", "été"])
    ids = np.arange(4 * 5000 + 3, dtype="<u2")
    rows = pa.RecordBatch.from_pydict({"doc_id": [7], "doc_tokens": [len(ids)], "ids": [common.pack(ids)]})
    out = [b.to_pydict() for b in curve_packing.pieces(iter([rows]), 4, 0)]
    assert max(len(b["doc_id"]) for b in out) <= curve_packing.PIECES_OUT
    assert np.frombuffer(b"".join(x for b in out for x in b["ids"]), "<u4").tolist() == ids.tolist()


def test_whole_texts_are_coded_by_their_different_segments():
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coder = piece_codec.agenda(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", "the and the", "  two  spaces \n\n line ▁ mark", "日本 é🙂 the", "\n", " ", "", "and the \x00\t"]
    want = [lib.encode(t) for t in texts]
    assert coder.encode_whole(texts) == [(w, "".join([f"{i} " for i in w])) for w in want]
    assert coder.encode_whole(["", ""]) == [([], "")] * 2 and coder.encode_whole([]) == []
