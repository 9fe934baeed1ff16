from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from semtab.llm.pii import KINDS, Trees, _best_apart, _bounds, _meets_any, below, boost, candidates, find_personal_data, learn_trees, redacted, running, span_text
from semtab.llm.queries import QUERIES
from tests.conftest import SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, name in enumerate(KINDS):
        for m in re.finditer(PLAIN[name], text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if name == "ip" and max(map(int, m.group().split("."))) > 255 or name == "card" and not (14 <= len(d) <= 19 and luhn(d)) or name == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op6_personal_data"](spark, SF).collect()
    assert len(got) == len(texts) and any(r["n_email"] for r in got)
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[1] == n for s in want) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(written(want).encode()).hexdigest()
        assert set(filter(None, written(want).split(","))) <= set(filter(None, r["spans"].split(",")))


ODD = [
    None, "", "é@b.c x@y.z._q@r.s a@b", "a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.0255 01.002.3.4", "12 3.4.5.6", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "4111  1111 1111 1111", "+1 (706) 555-3138 +12 +1234567890123456 +1 ((((", "𝒳𝒳 mail: a.b@c.de, 𝒳 call 706 555 3138 now", "me [at] home [dot] org", "9" * 30_000, "a." * 20_000 + "@" + "b." * 20_000 + "c",
    "+" + "1-" * 20_000 + "1", "0" * 16, "x1.2.3.4y", "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 " * 50,
]


def test_odd_rows(make):
    df = make([(None if k == 4 else k, t) for k, t in enumerate(ODD)] + [(2, ODD[2])], extra=True)
    out = find_personal_data(df, Trees())
    got = {r["_text"]: r for r in out.select("_text", span_text(F.col("base")).alias("b"), span_text(F.col("spans")).alias("s"), redacted(F.col("_text"), F.col("spans")).alias("r")).collect()}
    assert out.count() == len(ODD) + 1
    for t in ODD:
        assert got[t or ""]["b"] == got[t or ""]["s"] == written(plain(t))
    assert got[ODD[6]]["r"] == "[card]" and got[ODD[3]]["r"] == "[email]@d.e" and got[""]["r"] == ""
    assert find_personal_data(make([]), Trees()).collect() == []
    assert learn_trees(make([])).limits == {}


def test_trees_add_spans_beside_the_base(make):
    good = [(k, f"call +1 706 555 {3000 + k} today and phone +1 (706) 555-{4000 + k}") for k in range(150)]
    bad = [(1000 + k, f"sum +{k % 9 + 1}0.5{k % 7} of +12345 and 10{k}-20{k}") for k in range(150)]
    trees = learn_trees(make(good + bad), support=5)
    assert trees.trees and KINDS.index("phone") in trees.limits
    trees.limits[3] = min(trees.limits[3], 0.0)  # every candidate: what is added never touches the base
    found = find_personal_data(make([(1, "call 706 555 3138 or +1 706 555 3139")]), trees).select("base", "spans").first()
    assert [tuple(s) for s in found["base"]] == [(21, 3, 36)] and [tuple(s) for s in found["spans"]] == [(5, 3, 17), (21, 3, 36)]


def test_columns_score_as_the_driver_does(spark):
    draw = np.random.default_rng(1)
    x = draw.integers(0, 6, (300, 9))
    y = ((x[:, 1] > 2) & (x[:, 4] < 3)).astype(float)
    model = boost(x, y, np.ones(300))
    assert (((model.predict(x) > 0.5) == y).mean()) > 0.97
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "k int, f array<int>")
    assert np.allclose([r[1] for r in df.select("k", model.score(F.col("f"))).orderBy("k").collect()], model.predict(x))


def test_what_gives_way_keeps_nothing_out(make):
    """Three candidates in a chain: the best keeps the second out, which then does not keep the third out."""
    trees = Trees(0.0, [(1, 10, 1.0, (1, 12, 3.0, 2.0))], {3: 0.1, 2: 0.1})
    df = make([(1, "call 706 555 3138 555 3139 555 3140 5 now")])
    found = find_personal_data(df, trees).select("base", "spans").first()
    spans = [tuple(s) for s in found["spans"]]
    assert all(a[2] <= b[0] for a, b in zip(spans, spans[1:])) and spans
    every = [(s["start"], s["end"]) for s in candidates(df).select(F.explode("_spans").alias("s")).select("s.*").collect()]
    free = [e for e in every if all(e[1] <= s[0] or s[2] <= e[0] for s in spans)]
    assert not free, "a candidate that touches no kept span was left out"


def test_running_values_and_counts_below(spark):
    draw = random.Random(5)
    lists = [[], [4], [3, 3]] + [[draw.randrange(50) for _ in range(n)] for n in (2, 7, 8, 9, 33, 100)]
    df = spark.createDataFrame([(k, x, draw.randrange(50)) for k, x in enumerate(lists)], "k int, x array<int>, y int")
    total = running(F.col("x"), lambda v, earlier: v + F.coalesce(earlier, F.lit(0)))
    most = running(F.col("x"), lambda v, earlier: F.greatest(v, earlier))
    for r in df.select("x", "y", total.alias("t"), most.alias("m"), below(F.sort_array("x"), F.col("y")).alias("b")).collect():
        assert r["t"] == list(itertools.accumulate(r["x"])) and r["m"] == list(itertools.accumulate(r["x"], max)) and r["b"] == sum(v < r["y"] for v in r["x"])


def test_best_spans_against_brute_force(spark):
    draw = random.Random(6)
    meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
    rows = []
    for k in range(60):
        spans = [(at, at + draw.randrange(1, 9), draw.randrange(4), float(draw.randrange(5))) for at in (draw.randrange(60) for _ in range(k % 14))]
        others = [(at, at + draw.randrange(1, 6)) for at in (draw.randrange(60) for _ in range(k % 5))]
        rows.append((k, spans + spans[:2], others))
    df = spark.createDataFrame(rows, "k int, s array<struct<start:int,end:int,kind:int,rank:double>>, o array<struct<start:int,end:int>>")
    met = F.transform("s", lambda s: _meets_any(_bounds(F.col("o")), s))
    for r in df.select("s", "o", _best_apart(F.col("s")).alias("kept"), met.alias("met")).collect():
        kept = []
        for s in sorted(r["s"], key=lambda s: (s["rank"], s["start"], s["kind"], s["end"])):
            if not any(meets(s, o) for o in kept):
                kept.append(s)
        assert sorted((s["start"], s["kind"], s["end"], s["rank"]) for s in r["kept"]) == sorted((s["start"], s["kind"], s["end"], s["rank"]) for s in kept)
        assert r["met"] == [any(meets(s, o) for o in r["o"]) for s in r["s"]]


def test_a_text_of_very_many_spans(make):
    text = " ".join(f"u{k}@h.org call 706 555 {1000 + k % 9000} at 10.0.{k % 256}.1" for k in range(20_000))
    trees = Trees(9.0, [], {3: 0.5})
    got = find_personal_data(make([(1, text)]), trees).select("base", "spans").first()
    assert [tuple(s) for s in got["base"]] == plain(text)
    own = [(m.start(), 3, m.end()) for m in re.finditer("706 555 [0-9]{4}", text)]
    assert [tuple(s) for s in got["spans"]] == sorted(plain(text) + own)


def test_wider_matches_learn_from_those_of_the_base(make):
    """A wider pattern's matches inside valid numbers are good, those inside cards are bad; each generator has its own threshold."""
    rows = [(k, f"call +1 706 555 {3000 + k} or card 4111 1111 1111 1111 with sum +{k % 9 + 1}0.5{k % 7}") for k in range(300)]
    trees = learn_trees(make(rows), support=5)
    wide = len(KINDS) + KINDS.index("phone")
    assert 0.5 <= trees.limits[wide] < 1
    phones = F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index("phone")))
    found = find_personal_data(make([(1, "call 1 706 555 3138"), (2, "card 4111 1111 1111 5")]), trees).select("_id", phones).collect()
    assert {r[0]: r[1] for r in found} == {1: 1, 2: 0}


def test_learning_reads_all_documents(spark, monkeypatch):
    import semtab.llm.pii as pii

    seen = []
    monkeypatch.setattr(pii, "boost", lambda x, y, weight: seen.append(weight.sum()) or Trees())
    docs = spark.range(50_000).selectExpr("id AS doc_id", "concat('+12 ', 1000000 + id, CASE WHEN id % 2 = 0 THEN '0' ELSE '00000000' END) AS text")
    learn_trees(docs)
    learn_trees(docs, sample_docs=20_000)
    # each text is a candidate phone and, from its first digit on, a candidate card
    half = docs.where("pmod(xxhash64(1, text), 2) = 0").count()
    assert seen[0] == 2 * half > 2 * seen[1]
