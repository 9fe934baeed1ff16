from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semtab.llm import tokens as K

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [
    "", " ", "   ", "a", " a", "a ", "  a  b  ", "a\nb\tc", "\n", "\n a", "▁", "▁a ▁", "\x00", "<s>", "</s> <unk> <pad>", "x<s>y", "naïve café", "日本語 テキスト",
    "😀 👨‍👩‍👧", " a　b", "é", "ﬁ", "word" * 2_000, "the " * 20_000, "1234567890 3.14", "﻿a", "\r\n",
]


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def test_counts_are_those_of_the_library(make, sample, path, library):
    odd = [(i, t) for i, t in enumerate([None, *ODD])]
    for df in (make(odd + odd[:9] + [(None, "a b")], extra=True), sample):
        got = K.count_tokens(df, path)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "n_whole", "over_limit"]
        texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        want = Counter((i, len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 4096) for i, t in texts)
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == want
        assert all(0 <= r["n_whole"] <= r["n_tokens"] for r in got.collect())
    assert K.count_tokens(make([]), path).collect() == []


def test_whole_words_are_one_token(path, library):
    with open(path, "rb") as f:
        words = K.whole_words(f.read())
    assert len(words) > 1_000 and all(len(library.encode(w)) == 1 for w in words if w)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab T.\n\t▁<s>é日 "), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_pre_tokens_add_up(text):
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = f.read()
    if "words" not in _cache:
        _cache["words"] = K.whole_words(model)
    library, whole, _ = K._known(model, _cache["words"])
    assert sum(1 if p in whole else len(library.encode(p)) for p in K._pre_tokens(text)) == len(library.encode(text))


_cache: dict = {}


def test_memory_of_merged_words_is_bounded(monkeypatch, make, path, library):
    monkeypatch.setattr(K, "REMEMBERED", 3)
    text = " ".join(f"zq{i}xv" for i in range(50))
    df = make([(i, text) for i in range(4)])
    assert {r["n_tokens"] for r in K.count_tokens(df, path).collect()} == {len(library.encode(text))}
