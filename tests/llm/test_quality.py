from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from semtab.llm.language import held_out
from semtab.llm.quality import Chain, keep_good, learn_quality, score_quality, text_values, with_neighbours
from tests.conftest import rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chain(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return learn_quality(docs, labels, ~held_out("doc_id", 2, 4))


def test_held_out_accuracy(spark, chain):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, chain).join(labels, "doc_id").collect()
    out = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(out) > 50 and sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    good = {r["doc_id"] for r in got if r["predicted"] == 1}
    assert good <= {r["doc_id"] for r in keep_good(docs, chain).collect()}


def test_marginals_against_all_labellings():
    draw = np.random.default_rng(3)
    counts = np.array([3, 0, 1, 4])
    x, chain = draw.normal(size=(8, 5)), Chain(draw.normal(size=5), draw.normal(size=(2, 2)))
    good, joint = chain.marginals(x, counts, True)
    want, pairs, begin = np.zeros(8), np.zeros((2, 2)), 0
    for n in counts:
        total, mine, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(x[begin + i] @ chain.weights for i in range(n) if labels[i]) + sum(chain.pairs[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            mine += w * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                both[a, b] += w
        want[begin : begin + n] = mine / total
        pairs += both / total
        begin += n
    assert np.allclose(good, want) and np.allclose(joint, pairs)


def test_neighbours_stay_inside_documents():
    values = np.arange(1, 6, dtype=float)[:, None].repeat(2, axis=1)
    x = with_neighbours(values, np.array([2, 0, 3]))
    assert x[:, 2].tolist() == [0, 1, 0, 3, 4] and x[:, 4].tolist() == [2, 0, 4, 5, 0]
    assert x[:, -2].tolist() == [1, 0, 1, 0, 0] and x[:, -1].tolist() == [0, 1, 0, 0, 1]


def test_odd_rows(spark, make, chain):
    long = "\n".join(f"Line {k} of a long text, which goes on." for k in range(20_000))
    df = make([(1, None), (2, ""), (3, " \n\t\n \n"), (4, long), (4, long), (None, "Some words of a text."), (5, "\x1c\n.\n" * 3)], extra=True)
    got = score_quality(df, chain)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == 7
    assert {(r[0], r[1], r[2]) for r in got.where("doc_id < 4").collect()} == {(1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0)}
    assert keep_good(df, chain).columns == df.columns and keep_good(df, chain, limit=0.0).count() == 7
    assert score_quality(make([]), chain).collect() == []
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 1), (4, 1, 1), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, text int")
    assert learn_quality(df, labels, held_out("doc_id", 9, 10) | True) is None
    assert rows(score_quality(df, None), "predicted") == [(0,)] * 3 + [(1,)] * 4
    assert text_values("a b\n\n \nc")[0].shape == (2, 15)


def test_lines_of_the_sample_are_bounded(make, spark, monkeypatch):
    """An id with very many rows makes the sample no larger, and a small sample is the same with or without the bound."""
    from semtab.llm import quality as Q

    seen = []
    monkeypatch.setattr(Q, "fit_chain", lambda values, labels: seen.append(sum(map(len, values))) or Q.Chain(np.zeros(1), np.zeros((2, 2))))
    docs = make([(k, "a good line\n" * 5) for k in range(40)] + [(7, f"one of many rows {k}\nand more") for k in range(500)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    every = held_out("doc_id", 9, 10) | True
    for total, most in ((10_000, 10_000), (60, 60), (1, 0)):
        seen.clear()
        Q.learn_quality(docs, labels, every, train_docs=1_000, train_lines_total=total)
        assert (sum(seen) <= most) and (total < 10_000 or sum(seen) == 40 * 5 + 500 * 2)
    seen.clear()
    Q.learn_quality(docs, labels, every, train_docs=50)
    assert sum(seen) <= 100 * 5
