from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from semtab.llm import language as L
from semtab.llm.queries import QUERIES
from tests.conftest import rows

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    s = " " + " ".join(words) + " "
    found = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)) if words else Counter()
    del found[" "]
    return found


def unpack(gram):
    out = ""
    while gram:
        out, gram = chr(gram & ((1 << L.BITS) - 1)) + out, int(gram) >> L.BITS
    return out


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 19])
def test_grams_against_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    for text in ("Der Hund, der bellt.", "a", "ab", "  x9y  ", "été ÉTÉ", "日本語のテキスト", "", "12 !", "I", "İstanbul 'q'", "\x00a\x1cb"):
        got = {unpack(g): int(n) for g, n in zip(*L.gram_counts(text))}
        assert got == dict(brute_grams(text)), text


def test_out_of_place_distance_against_brute_force():
    draw = np.random.default_rng(1)
    ranks = {name: draw.permutation(60)[:k].tolist() for name, k in (("aa", 40), ("bb", 40), ("cc", 7))}
    profiles = L.Profiles(ranks, 40)
    for _ in range(20):
        doc = draw.permutation(90)[: draw.integers(1, 40)].astype(np.int64)
        want = [sum(min(abs(i - ranks[n].index(g)), 40) if g in ranks[n] else 40 for i, g in enumerate(doc.tolist())) for n in profiles.languages]
        assert profiles.distances(doc).tolist() == want


def test_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r in out) and sum(r["held_out"] for r in got) == len(out) > 50
    told = [r for r in out if r["lang"] is not None and r["lang_pred"] != L.UNKNOWN]
    assert sum(r["lang_pred"] == r["lang"] for r in told) / len(told) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark, make):
    long = "the quick brown fox and the lazy dog " * 30_000
    data = [(1, None), (2, ""), (3, "12 34 !?"), (4, long), (4, long), (None, "the dog and the fox"), (5, "le chien et le renard"), (6, "\x00")]
    df = make([(i, t, "s", "fr" if t and "chien" in t else "en") for i, t in data], extra=True)
    profiles = L.learn_profiles(df, F.lit(True))
    got = L.identify_languages(df, profiles)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    want = [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "fr"), (6, "und"), (None, "en")]
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert L.identify_languages(make([]), profiles).collect() == []
    # nothing to learn from; equal profiles tie and the first code wins
    none = L.learn_profiles(df.where("false"), F.lit(True))
    assert rows(L.identify_languages(df, none).select("lang_pred").distinct()) == [("und",)]
    assert L.Profiles({"b": [97], "a": [97]}, 5).predict("a")[0] == "a"
    with pytest.raises(ValueError, match="more than 1 languages"):
        L.learn_profiles(df, F.lit(True), max_languages=1)
