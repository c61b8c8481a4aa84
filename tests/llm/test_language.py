"""Lattices and sums of operator 10, against plain loops."""

from __future__ import annotations

import random
import sys

import numpy as np
import public_tokenizers
import pytest

from sedge.llm import language_id
from sedge.llm.language_id import MODEL, PIECE, STRETCH, Pieces, Scorer, by_length, fit, forward, words_of

PATH = public_tokenizers.path(MODEL)


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PATH)


def odd_words(n):
    rng = random.Random(3)
    found = sorted(Pieces(PATH).number)
    letters = "abeinrstßéİſςΣЖ日本語あ한ªǅ𐐷𝒜𠀀"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) + rng.choice(found).lstrip("▁") + rng.choice(found).lstrip("▁") for _ in range(n)]
    return sorted({w for t in out for w in words_of(t)} | {"a", "e" * STRETCH, "q" * (STRETCH - 1)})


def test_lattices_hold_every_piece(pieces):
    words = ["▁" + w for w in odd_words(3000)]
    seen = 0
    for ks in by_length(words).values():
        part = [words[k] for k in ks]
        for w, lattice in zip(part, pieces.lattice(part), strict=True):
            want = np.full((len(w), PIECE), -1)
            for end in range(1, len(w) + 1):
                for n in range(1, min(PIECE, end) + 1):
                    want[end - 1, n - 1] = pieces.number.get(w[end - n : end], pieces.other if n == 1 else -1)
            assert (lattice == want).all(), w
            seen += int((want >= 0).sum())
    assert seen > 30_000


def test_lattices_are_not_looked_up_letter_by_letter(pieces):
    words = ["▁" + w[:8] for w in odd_words(3000) if len(w) >= 8]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        pieces.lattice(words)
    finally:
        sys.setprofile(None)
    assert calls < len(words)


def test_runs_of_letters_fall_into_stretches():
    run = "Ab" * 50
    assert words_of(f"{run} x½y, {run[:32]}ß") == [run.lower()[at : at + STRETCH] for at in range(0, 100, STRETCH)] + ["x", "y", run[:32].lower(), "ß"]


@pytest.mark.parametrize("block", [1, 100, 8 << 20])
def test_sums_go_over_a_text_in_order(monkeypatch, block):
    monkeypatch.setattr(language_id, "SUM_BYTES", max(block, 16))
    rng = random.Random(5)
    words = odd_words(200)
    _, p = fit({"a": words[:150], "b": words[50:]}, PATH, 2)
    texts = ["", " ".join(rng.choices(words, k=300)), "½ 12", *(" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(40)), "", "?"]
    scorer = Scorer(PATH, p)
    for t, got in zip(texts, scorer.score(texts), strict=True):
        want = np.zeros(2)
        for w in words_of(t):
            want = want + np.log(forward(scorer.pieces.lattice(["▁" + w]), p)[0, -1])
        assert np.isnan(got).all() if not words_of(t) else np.allclose(got, want, rtol=1e-13, atol=0)
    assert scorer.score([]).shape == (0, 2) and Scorer(PATH, p[:, :0]).score(texts).shape == (len(texts), 0)
