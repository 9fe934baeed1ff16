from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from semtab.llm import decontaminate
from semtab.llm.decontaminate import HammingIndex, distinct_prints, drop_leaks, find_leaks, shingle_hashes, window_prints, word_hashes
from tests.conftest import rows


def plain_similarity(window, item, k):
    a = Counter(tuple(window[i : i + k]) for i in range(len(window) - k + 1))
    b = Counter(tuple(item[i : i + k]) for i in range(len(item) - k + 1))
    return sum(min(a[x], b[x]) for x in a) / sum(max(a[x], b[x]) for x in {*a, *b})


def plain(docs, items, least=0.8):
    """Every window of every document against every item; a shorter document is one window."""
    out = []
    texts = [(i, (t or "").lower().encode().split()) for i, t in items]
    for d, text in docs:
        words = (text or "").lower().encode().split()
        own = {k: {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} for k in range(1, 6)}
        for i, item in texts:
            m, k = len(item), min(5, len(item))
            if m and own[k].isdisjoint(tuple(item[j : j + k]) for j in range(m - k + 1)):
                continue
            best = max(((plain_similarity(words[j : j + m], item, k), -j) for j in range(max(1, len(words) - m + 1))), default=(0, 0)) if m else (0, 0)
            if best[0] >= least:
                out.append((d, i, best[0], -best[1]))
    return sorted(out)


def test_sample_against_brute_force(spark, sample):
    """All documents of the table, whatever their length, and items planted whole, with a changed end, and cut."""
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    docs = [(r["doc_id"], r["text"]) for r in sample.collect()]
    planted = [(10_000 + i, f"Words before. {t.rsplit(' ', 1)[0]} changed and more words behind it") for i, t in items[:12]]
    planted += [(20_000 + i, " ".join(t.split()[: -(len(t.split()) // 12) or None])) for i, t in items]
    df = spark.createDataFrame(docs + planted, "doc_id long, text string")
    got = rows(find_leaks(df, bench), "_id", "_item", "similarity", "start_word")
    want = plain(docs + planted, items)
    assert len([w for w in want if w[0] >= 20_000]) > 10 and got == sorted(want, key=repr)


def changed(kind, words, c, name):
    """Some words with ``c`` of them changed or gone."""
    if kind == "repeated tail":
        return words[:-c] + [f"x{name}"] * c
    if kind == "short document":
        return words[:-c]
    if kind == "scattered":
        at = {*random.Random(name).sample(range(len(words)), c)}
        return [f"y{j}" if j in at else w for j, w in enumerate(words)]
    return words[:-c] + [f"y{name}_{j}" for j in range(c)]


@pytest.mark.parametrize("kind", ["distinct tail", "repeated tail", "repeating item", "scattered", "short document"])
@pytest.mark.parametrize("m", [20, 60, 200, 500])
def test_recall_right_at_the_threshold(kind, m):
    """The last change that leaves a similarity of 0.8: fingerprints must keep 98 of 100 such pairs, and 99 of 100 in all."""
    items, docs = [], []
    for name in range(100):
        words = [f"r{name}"] * (m // 2 if kind == "repeating item" else 0)
        words += [f"w{name}_{j}" for j in range(m - len(words))]
        last = None
        for c in range(1, m):
            text = changed(kind, words, c, name)
            if plain_similarity(text, words, 5) < 0.8:
                break
            last = text
        if last:
            items.append(" ".join(words))
            docs.append(" ".join(last))
    known = decontaminate.Items(items, 5, 19, 0.8).build()
    found = dict(known.scan(docs))
    assert len(docs) > 5 and sum(n in found.get(n, {}) for n in range(len(docs))) >= 0.98 * len(docs)


@pytest.mark.parametrize("left", [99, 95, 92, 90])
def test_document_shorter_than_an_item(make, spark, left):
    words = [f"w{k}" for k in range(100)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = make([(1, " ".join(words[:left])), (2, " ".join(words[-left:])), (3, " ".join(words[:left]) + " and ten more words stand behind it here now ok"), (4, " ".join(words[:50])), (5, "w1 w2 w3")])
    got = rows(find_leaks(docs, items), "_id", "similarity", "start_word")
    assert [(d, at) for d, _, at in got] == [(1, 0), (2, 0), (3, 0)]
    assert got[0][1] == pytest.approx((left - 4) / 96)
    assert rows(drop_leaks(docs, items), "doc_id") == [(4,), (5,)]


def test_whole_table_gives_every_item_that_is_contained(spark, sample):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    norm = lambda t: f" {' '.join(t.lower().split())} "
    items = [(r["item_id"], norm(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in sample.collect() for i, t in items if t in norm(r["text"])}
    got = {(r["_id"], r["_item"]) for r in find_leaks(sample, bench).collect()}
    assert want <= got and want
    assert {r["doc_id"] for r in drop_leaks(sample, bench).collect()} == {r["doc_id"] for r in sample.collect()} - {g[0] for g in got}


@pytest.mark.parametrize("radius", [3, 9, 15, 19])
def test_index_loses_nothing_within_the_radius(radius):
    draw = random.Random(radius)
    entries = np.array([draw.getrandbits(64) for _ in range(50)], np.uint64)
    queries = np.array([int(e) ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(25))) for e in entries for _ in range(40)], np.uint64)
    q, e = HammingIndex(entries, radius).search(queries)
    want = {(i, j) for i in range(len(queries)) for j in range(len(entries)) if int(queries[i] ^ entries[j]).bit_count() <= radius}
    assert set(zip(q.tolist(), e.tolist())) == want and len(q) == len(want)


def test_window_prints_are_simhashes():
    words = word_hashes(np.frombuffer(b"a b c d e f a b c d e f g", np.uint8))[0]
    shingles = shingle_hashes(words, 5)
    assert len(words) == 13 and shingles[0] == shingles[6]
    got = window_prints(shingles, np.array([0, 2]), 4)
    for start, fp in zip((0, 2), got.tolist()):
        assert all((fp >> b & 1) == (2 * sum(int(h) >> b & 1 for h in shingles[start : start + 4]) > 4) for b in range(64))
    for start, fp in zip((0, 1), distinct_prints(shingles, np.array([0, 1]), 8).tolist()):
        own = {int(h) for h in shingles[start : start + 8]}
        assert len(own) < 8 and all((fp >> b & 1) == (2 * sum(h >> b & 1 for h in own) > len(own)) for b in range(64))


def test_odd_rows(spark, make, monkeypatch):
    item = " ".join(f"Item{k}" for k in range(20))
    long = " ".join(f"w{k}" for k in range(300_000)) + " " + item + " " + " ".join(f"v{k}" for k in range(50_000))
    docs = [(1, None), (2, ""), (3, item.upper()), (3, item.upper()), (4, f"x\t{item.replace(' ', chr(10))}"), (None, item), (5, long), (6, "short one"), (7, "z" * 3_000_000 + " " + item)]
    items = spark.createDataFrame([(7, item, 1), (8, item, 1), (9, None, 1), (10, " ", 1), (11, "short one", 1), (None, "Item3 Item4", 1)], "item_id long, text string, doc_id int")
    got = rows(find_leaks(make(docs, extra=True), items), "_id", "_item", "start_word")
    want = [(d, i, s) for d, s in ((3, 0), (3, 0), (4, 1), (None, 0), (5, 300_000), (7, 1)) for i in (7, 8)]
    want += [(d, None, s + 3) for d, s in ((3, 0), (3, 0), (4, 1), (None, 0), (5, 300_000), (7, 1))] + [(6, 11, 0)]
    assert got == sorted(want, key=repr)
    several = rows(find_leaks(make(docs), items, items_per_pass=2), "_id", "_item", "start_word")
    assert several == got
    assert rows(drop_leaks(make(docs, extra=True), items, items_per_pass=4), "doc_id", "_id") == [(1, 1), (2, 1)]
    assert find_leaks(make([]), items).collect() == [] and find_leaks(make(docs), items.limit(0)).collect() == []


def test_parts_cover_every_window(monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 40)
    draw = random.Random(5)
    data = " ".join("w" * draw.randrange(1, 60) for _ in range(60)).encode()
    seen = set()
    for part, words, before in decontaminate._parts(data, 4):
        own = part.split()
        assert len(own) == len(words)
        seen |= {(before + i, tuple(own[i : i + 4])) for i in range(len(own) - 3)}
    every = data.split()
    assert seen == {(i, tuple(every[i : i + 4])) for i in range(len(every) - 3)}
