from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semtab.llm import middle as M

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain_version(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def texts():
    draw = random.Random(5)
    shared = " ".join(draw.choice(["copy", "naïve", "日本", "x1", "\n"]) for _ in range(900))
    odd = [None, "", "a", "é", "<P>", "a <M", "<<S", "P> <S", "a<S>b", "\x00\n\n", "Zz9zZ", "w" * 70_000, "\n" * 5_000, "日本語" * 9_000, "ab " * 60_000, shared, shared]
    odd += [draw.choice(["x ", "é"]) * k + shared + str(k) for k in range(40)]
    return odd + ["".join(draw.choice("ab é日1\n<PSM>") for _ in range(draw.randrange(3_000))) for _ in range(60)]


def test_against_the_contract_and_back(make):
    rows = list(enumerate(texts())) + [(None, "one two"), (3, "é"), (3, "é")]
    df = make(rows, extra=True)
    got = M.fill_in_middle(df)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_version(i, t) for i, t in rows), key=repr)
    back = got.select("doc_id", M.restored().alias("text"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    forms = {r["form"] for r in got.collect()}
    assert forms == {"plain", "psm", "spm"}
    assert M.fill_in_middle(make([])).collect() == []


def test_small_chunks_give_the_same_cuts(monkeypatch):
    monkeypatch.setattr(M, "LEAST", 1)
    monkeypatch.setattr(M, "ZERO_BITS", 2)
    monkeypatch.setattr(M, "MOST", 9)
    monkeypatch.setattr(M, "PART", 50)
    M._tables.clear()
    try:
        for text in texts()[:30]:
            data = (text or "")[:2_000].encode()
            units = UNIT.findall(data.decode())
            cutter = M.Cutter(data)
            assert cutter.units[-1] == len(units)
            for k in {0, 1, 2, len(units) // 3, len(units) // 2, len(units) - 1, len(units), len(units) + 1} & set(range(len(units) + 2)):
                head = "".join(units[:k])
                assert cutter.cut(k) == (len(head.encode()), len(head))
    finally:
        M._tables.clear()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abZ é日\n<"), st.characters(exclude_categories=["Cs"])), max_size=80), st.integers(0, 90))
def test_any_cut(text, k):
    units = UNIT.findall(text)
    head = "".join(units[:k])
    assert M.Cutter(text.encode()).cut(k) == (len(head.encode()), len(head))


def test_chunks_follow_the_content():
    draw = random.Random(9)
    shared = "".join(draw.choice("abcdefgh ") for _ in range(40_000)).encode()
    found = [{c for c in M.Cutter(draw.randbytes(k).hex().encode() + shared).chunks} for k in (100, 777, 5_000)]
    common = set.intersection(*found)
    assert sum(map(len, common)) > 0.8 * len(shared)
    assert all(b"".join(M.Cutter(d).chunks) == d for d in (b"", b"a", shared, b"x" * 100_000))


def test_remembered_chunks_are_verified_and_bounded(monkeypatch):
    monkeypatch.setattr(M, "REMEMBERED", 3_000)
    M._memo.clear()
    for k in range(100):
        chunk = b"ab " * (k + 1)
        assert M.remembered(chunk) == M.summary(chunk) == M.remembered(chunk)
        assert sum(len(c) for part in M._memo[:2] for c in part) < 10_000
    M._memo.clear()


@pytest.mark.parametrize("form, output", [("psm", "<P>a <<S>d<M>b"), ("spm", "<S>d<P>a <<M>b")])
def test_marks_next_to_parts_of_marks(spark, form, output):
    df = spark.createDataFrame([(form, output), ("plain", "<P>x"), (None, None)], "form string, output string")
    assert [r[0] for r in df.select(M.restored()).collect()] == ["a <bd", "<P>x", None]
