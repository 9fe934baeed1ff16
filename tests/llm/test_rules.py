from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from semtab.llm.rules import Rule, default_rules, judge, order_rules, with_features
from semtab.runtime import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


ODD = [
    None, "", " \t\n\x0b", "one", "a b", "a b c", "a a a a a", "a b c a b c", "x\ny\nx\n\nx ", "# * $ % &|<>", "é è ü\x1c\x1d",
    "w " * 9, "a b a b a b c d a b", "same line\n" * 40, "word" * 50_000, "one two three four five six seven " * 5_000, "\x00 \x00 \x00 \x00",
]


def test_counts_against_brute_force(make, sample):
    odd = [(i, t) for i, t in enumerate(ODD)]
    for df in (make(odd + odd[:6] + [(None, "a b c")], extra=True), sample):
        texts = Counter((r["doc_id"], brute(r["text"])) for r in df.collect())
        got = judge(df)
        assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
        found = got.collect()
        assert Counter((r[0], tuple(r[1:6])) for r in found) == texts
        assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in found)
        assert not any(r["kept"] for r in found if r["base_failed"])
    assert judge(make([])).collect() == []


def test_verdict_does_not_depend_on_the_order(sample):
    rules = default_rules()
    want = {tuple(r) for r in judge(sample, rules).select("doc_id", "kept").collect()}
    assert {tuple(r) for r in judge(sample, rules[::-1], sample_docs=3).select("doc_id", "kept").collect()} == want
    assert len({k for _, k in want}) == 2


def test_rules_that_reject_most_per_cost_come_first(sample):
    features = stage(with_features(sample), "features")
    rules = [Rule("never", F.lit(False)), Rule("some", F.col("n_words") % 50 == 0), Rule("all", F.col("n_words") >= 0)]
    order = order_rules(features, rules)
    assert order[-1][0].name == "never" and all(cost > 0 for _, cost, _ in order)
    assert [share / cost for _, cost, share in order] == sorted((share / cost for _, cost, share in order), reverse=True)
    assert next(s for r, _, s in order if r.name == "all") == pytest.approx(1.0)


def test_missing_condition_rejects_nothing(make):
    df = make([(1, " ".join(f"word{i}" for i in range(80)))])
    assert [r["kept"] for r in judge(df, [Rule("unknown", F.lit(None).cast("boolean"))]).collect()] == [True]
    assert [r["kept"] for r in judge(df, []).collect()] == [True]


def test_no_python_on_the_main_path(sample):
    plan = judge(sample)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Arrow|InPandas|CartesianProduct|BroadcastNestedLoop", plan)
