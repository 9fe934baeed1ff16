from __future__ import annotations

import base64
import hashlib
from array import array
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semtab.llm import byte_bpe as B
from semtab.llm.queries import QUERIES
from tests.conftest import SF

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

PATTERN = public_tokenizers.PATTERN
ODD = [
    "", " ", "   ", "a", " a ", "a\nb\tc\r\n", "\x00", "\x1c\x1d \x85", "<|endoftext|>", "ĀāĂ ǿ", "▁a ▁", "naïve café's it'll", "日本語　テキスト", "😀 👨‍👩‍👧", "x" * 3_000,
    "the " * 30_000, "1234567890 3.14", " " * 5_000, "ab" * 40_000 + "é", "ﬁ", "zq" + "\n" * 200 + "y",
]


def ids_of(text, loaded):
    return list(array("i", B.encode([text], loaded)[0]))


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def library_of(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library(path):
    return library_of(path)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_are_those_of_the_library_and_decode_to_the_text(make, sample, name):
    path = public_tokenizers.path(name)
    library = library_of(path)
    odd = [(i, t) for i, t in enumerate([None, *ODD])]
    for df in (make(odd + odd[:9] + [(None, "a b")], extra=True), sample):
        got = B.decode_ids(B.encode_texts(df, path, PATTERN), path)
        assert got.columns == ["doc_id", "ids", "decoded"]
        texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        want = Counter((i, tuple(library.encode_ordinary(t)), t.encode()) for i, t in texts)
        assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got.collect()) == want
    assert B.encode_texts(make([]), path, PATTERN).collect() == []


def test_query_over_a_whole_table(spark, library):
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.add((r["doc_id"], len(ids), digest, hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    assert {tuple(r) for r in QUERIES["op13_byte_bpe"](spark, SF).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abt' \n\t1.sé日"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    if not _cache:
        _cache.append((B.read_ranks(path), library_of(path)))
    table, library = _cache[0]
    assert ids_of(text, B._load(table, PATTERN)) == library.encode_ordinary(text)


_cache: list = []


def test_whole_tokens_that_no_merge_reaches():
    """``abc`` is a token but neither ``ab`` nor ``bc`` is: only the match itself gives it."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"xy", b"xyx"]
    table = b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens))
    loaded = B._load(table, r"\S+|\s")
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s", mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    for text in ("abc", "abcabc", "xyx xyxy", "abc xyxyx"):
        assert ids_of(text, loaded) == own.encode_ordinary(text)


def test_long_matches_are_cut_where_no_token_reaches_across(monkeypatch, path, library):
    monkeypatch.setattr(B, "LONG", 16)
    loaded = B._load(B.read_ranks(path), PATTERN)
    cut = 0
    for text in ("qzxkjvwq" * 40, "é日x" * 100, "!?#~" * 90, "antidisestablishmentarianism" * 9):
        cut += len(list(B._cuts(text.encode(), loaded[4]))) > 1
        assert ids_of(text, loaded) == library.encode_ordinary(text)
    assert cut >= 2


def test_memory_of_matches_is_bounded(monkeypatch, make, path, library):
    monkeypatch.setattr(B, "REMEMBERED", 3)
    monkeypatch.setattr(B, "AT_ONCE", 20)
    text = " ".join(f"zq{i}xv the" for i in range(50)) + " " + "w" * 100
    loaded = B._load(B.read_ranks(path), PATTERN)
    for _ in range(3):
        assert ids_of(text, loaded) == library.encode_ordinary(text)
        assert len(loaded[3]) <= 20


def test_decoding_keeps_other_columns(spark, path):
    df = spark.createDataFrame([(1, [262, 262], "a", "o"), (2, [], "b", "p"), (3, None, "c", "q")], "k int, ids array<int>, _ids string, decoded string")
    got = B.decode_ids(df, path)
    assert got.columns == ["k", "ids", "_ids", "decoded"]
    assert {(r["k"], r["_ids"], None if r["decoded"] is None else bytes(r["decoded"])) for r in got.collect()} == {(1, "a", b" the the"), (2, "b", b""), (3, "c", None)}


def test_tables_of_ranks_are_checked():
    full = [base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)]
    assert len(B.tokens_by_rank(b"\n".join(full))) == 256
    with pytest.raises(ValueError, match="no token of their own"):
        B.tokens_by_rank(b"\n".join(full[:-1]))
    with pytest.raises(ValueError, match="gap"):
        B.tokens_by_rank(b"\n".join(full + [base64.b64encode(b"ab") + b" 300"]))
