from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from semtab.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_version(rows, least=3, top=200):
    """The contract with whole numbers of any size; rows are ``(text, source, lang)``."""
    rows = [(TERM.findall((t or "").translate(LOWER)), s or "", g or "") for t, s, g in rows]
    out = set()
    for lang in {r[2] for r in rows}:
        df, by_source = Counter(), defaultdict(Counter)
        for terms, source, _ in (r for r in rows if r[2] == lang):
            df.update(set(terms))
            by_source[source].update(terms)
        kept = {t for t, n in df.items() if n >= least}
        shares = {}
        for source, counts in [*by_source.items(), (None, sum(by_source.values(), Counter()))]:
            total = sum(counts[t] for t in kept)
            shares[source] = {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        for g in by_source:
            pairs = [(-sum(f(shares[g][t], shares[o][t]) for t in kept), o.encode(), o) for o in by_source if o != g]
            terms = [(-f(shares[g][t], shares[None][t]), t.encode(), t) for t in kept if by_source[g][t] and shares[g][t] > shares[None][t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, g, part, item, -value, k) for k, (value, _, item) in enumerate(items, 1)}
    return out


def draw_rows(n, seed=3):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdé日" for b in "xyzÀ"] + ["The", "THE", "the", "Ünder", "\U0001f600", "￿"]
    rows = [(" 1,".join(draw.choices(words, weights=range(len(words), 0, -1), k=draw.randrange(60))), draw.choice(["s1", "s2", "s3", "s3", None, ""]), draw.choice(["en", "en", "fr", None])) for _ in range(n)]
    return rows + [(None, "s9", "en"), ("", "s1", "xx"), ("1 2 _", "s2", "xx"), ("lone lone", "only", "yy"), ("x" * 5_000 + " the", "s2", "en"), ("the " * 40_000, "s1", "en")]


def build(make, rows, extra=False):
    return make([(k, t, s, g) for k, (t, s, g) in enumerate(rows)], extra)


@pytest.mark.parametrize("settings", [{}, {"broadcast_groups": 0}, {"top": 3}, {"least_docs": 1}])
def test_against_the_contract(make, settings):
    rows = draw_rows(250)
    got = D.source_divergence(build(make, rows + rows[:4], extra=True), **settings)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain_version(rows + rows[:4], settings.get("least_docs", 3), settings.get("top", 200))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    assert {w[2] for w in want} == {"pair", "term"}


def test_small_memory_gives_the_same(make, monkeypatch):
    """Stripes handed on after a few entries, pairs a few at a time, texts cut at every gap."""
    rows = draw_rows(60, seed=8)
    docs = build(make, rows)
    for name, value in (("FOLDED", 5), ("STRIPES", 3), ("PART", 7), ("PAIRS", 4)):
        monkeypatch.setattr(D, name, value)
    assert {tuple(r) for r in D.source_divergence(docs).collect()} == plain_version(rows)


def test_candidates_of_a_mapper_are_the_best(monkeypatch):
    draw = random.Random(1)
    rows = [("l", draw.choice("ab"), -draw.randrange(5), str(draw.randrange(50)).encode()) for _ in range(400)]
    rows = list(dict.fromkeys(rows))
    best = D._Best(7)
    for k in range(0, len(rows), 30):
        best.add(rows[k : k + 30])
        best.cut()
    assert best.rows == [r for s in "ab" for r in sorted(x for x in rows if x[1] == s)[:7]]


def test_large_totals_are_exact():
    import numpy as np

    draw = random.Random(4)
    for _ in range(500):
        total = draw.randrange(8 * 10**13)
        n, terms = draw.randrange(total + 1), draw.randrange(1, 10**9)
        assert int(D._p(np.array([n]), np.array([total]), np.array([terms]))[0]) == 1 + 10**9 * (n + 1) // (total + terms)


def test_shares_in_sql_are_the_same(spark):
    draw = random.Random(6)
    rows = [(draw.randrange(10**k), 10**k, draw.randrange(1, 10**6)) for k in range(1, 14)] + [(0, 0, 0)]
    df = spark.createDataFrame(rows, "n long, total long, terms long")
    got = [r[0] for r in df.selectExpr(D._p_sql("n", "total", "terms")).collect()]
    assert got == [1 + 10**9 * (n + 1) // max(total + terms, 1) for n, total, terms in rows]


def test_empty_tables(make):
    assert D.source_divergence(make([])).collect() == []
    assert D.source_divergence(make([(1, None, None, None)])).collect() == []
    assert [tuple(r) for r in D.source_divergence(make([(1, "", "a"), (2, "one", "b")])).collect()] in (
        [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)], [("en", "b", "pair", "a", 0, 1), ("en", "a", "pair", "b", 0, 1)],
    )
