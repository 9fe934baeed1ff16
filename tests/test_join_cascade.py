from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from semtab.models.base import HashEmbedder, RuleModel
from semtab.operators import cascade as C
from semtab.operators.clustering import cluster_summary, sem_cluster_by
from semtab.operators.matching import JoinCascade, sem_join, sides
from semtab.operators.semantic import sem_filter
from semtab.suite import rules as R
from tests.conftest import rows

MATCH = R.judge(lambda c: R.value(c)[-1] == R.value(c, 1)[-1])


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(i, f"a{i % 6}" if i % 7 else None, "l") for i in range(60)], "id long, v string, tag string")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(i, f"b{i % 4}" if i else None, "r") for i in range(20)], "rid long, w string, tag string")


def brute(left, right):
    a, b = left.dropna().toPandas(), right.dropna().toPandas()
    both = a.merge(b, how="cross")
    return sorted((r.id, r.rid) for r in both.itertuples() if r.v[-1] == r.w[-1])


@pytest.mark.parametrize("size", [{}, {"broadcast_bytes": 0, "block_values": 2}])
def test_join_is_filter_over_all_pairs(left, right, size):
    out, stats = sem_join(left, right, "{v:left} fits {w:right}", MATCH, stats=True, **size)
    assert out.columns == ["id", "v", "tag:left", "rid", "w", "tag:right"]
    assert sorted(tuple(r) for r in out.select("id", "rid").collect()) == brute(left, right)
    assert stats["total_LM_calls"] == 24
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


def test_join_finds_sides_by_name(left, right):
    assert sides("{v} fits {w}", left, right) == ("v", "v", "w", "w")
    assert sem_join(left, right, "{v} fits {w}", MATCH).count() == len(brute(left, right))
    for bad in ("{tag} fits {w}", "{v} fits", "{v:left} fits {nope:right}"):
        with pytest.raises(ValueError):
            sem_join(left, right, bad, MATCH)
    with pytest.raises(ValueError, match="numeric"):
        sem_join(left, right, "{id:left} fits {w:right}", MATCH)
    with pytest.raises(NotImplementedError):
        sem_join(left, right, "{v} fits {w}", MATCH, how="left")
    with pytest.raises(ValueError, match="24 calls"):
        sem_join(left, right, "{v} fits {w}", MATCH, max_calls=23)


def test_join_explains_and_uses_examples(left, right):
    out = sem_join(left, right, "{v:left} fits {w:right}", MATCH, strategy="zs-cot", explain=True)
    assert {r[0] for r in out.select("explanation_join").distinct().collect()} == {"read from the text"}
    seen = RuleModel(lambda s, c: str(s.shots[0].context == "[V:left]: «a1»\n[W:right]: «b1»\n"))
    examples = pd.DataFrame({"v": ["a1"], "w": ["b1"], "Answer": [True]})
    assert sem_join(left, right, "{v:left} fits {w:right}", seen, examples=examples).count() > 0


def test_join_candidates(left, right, spark):
    some = spark.createDataFrame([("a1", "b1"), ("a2", "b2"), ("a2", "b1"), ("zz", "b1")], "l string, r string")
    out = sem_join(left, right, "{v:left} fits {w:right}", MATCH, candidates=some)
    assert {(r["v"], r["w"]) for r in out.collect()} == {("a1", "b1"), ("a2", "b2")}


@pytest.mark.parametrize("targets", [dict(recall_target=1.0), dict(recall_target=0.9, precision_target=0.9)])
def test_join_cascade_equals_plain_where_similarity_is_right(spark, targets):
    names = [f"thing {i}" for i in range(30)]
    left = spark.createDataFrame([(i, names[i % 30]) for i in range(90)], "id long, v string")
    right = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "rid long, w string")
    model = RuleModel(lambda s, c: R.value(c) if s.task == "map" else str(R.value(c) == R.value(c, 1)))
    out, stats = sem_join(left, right, "{v:left} is {w:right}", model, cascade=JoinCascade(HashEmbedder(4096), **targets), stats=True)
    assert sorted(tuple(r) for r in out.select("id", "rid").collect()) == sorted((i, i % 30) for i in range(90))
    assert stats["join_resolved_by_helper_model"] + stats["join_resolved_by_large_model"] == 900
    small = sem_join(left.limit(2), right.limit(2), "{v:left} is {w:right}", model,
                     cascade=JoinCascade(HashEmbedder(4096), min_pairs=100, **targets), stats=True)[1]
    assert list(small) == ["total_LM_calls"]  # below the size from which a cascade pays


# --- filter cascade --------------------------------------------------------


def test_filter_cascade(spark):
    df = spark.createDataFrame([(i, f"item {i:04d}") for i in range(400)], "id long, name string")
    number = lambda c: int(R.value(c)[-4:])
    truth = R.judge(lambda c: number(c) >= 150)
    helper = R.judge(lambda c: number(c) >= 200, chance=lambda s, c: 0.5 + abs(number(c) - 200) / 1000)
    out, stats = C.sem_filter_cascade(df, "{name} is large", truth, helper, sample=0.6, recall_target=0.95,
                                      precision_target=0.9, failure_probability=0.2, stats=True, raw=True)
    got = {r["id"] for r in out.collect()}
    want = {r["id"] for r in sem_filter(df, "{name} is large", truth).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.85 * len(got)
    assert stats["filters_resolved_by_helper_model"] + stats["filters_resolved_by_large_model"] == 400
    assert stats["neg_cascade_threshold"] <= stats["pos_cascade_threshold"]
    assert "raw_output_filter" in out.columns
    with pytest.raises(ValueError):
        C.sem_filter_cascade(df, "{name} is large", truth, helper, sample=0.5, recall_target=1.0, precision_target=1.0,
                             failure_probability=0.2, helper_strategy="cot")


def test_true_prob(spark):
    def reply(*tokens):
        return ([(t, -0.1, top) for t, top in tokens],)

    shape = "logprobs array<struct<token:string,logprob:double,top:array<struct<token:string,logprob:double>>>>"
    data = [
        reply(("x", []), ("True", [("True", -0.1), ("False", -2.0)])),
        reply(("False", [("False", -0.1)])),
        reply(("True", [("True", -0.1)])),
    ]
    df = spark.createDataFrame(data, shape).select(F.struct("logprobs").alias("r"))
    got = [r[0] for r in df.select(C.true_prob(F.col("r"))).collect()]
    assert got[0] == pytest.approx(np.exp(-0.1) / (np.exp(-0.1) + np.exp(-2.0))) and got[1:] == [0.0, 1.0]


@pytest.mark.parametrize("in_memory", [10_000, 0])
def test_calibrate_matches_numpy(spark, in_memory):
    values = np.round(np.random.default_rng(3).beta(0.5, 0.5, 777), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "p double")
    shares = [i / 50 for i in range(51)]
    q = C.quantiles(df, "p", shares, in_memory)
    assert np.allclose(q, np.percentile(values, np.linspace(0, 100, 51)))
    want = np.clip((np.digitize(values, np.array(q)) - 1) / 50, 0, 1)
    got = {r["p"]: r["calibrated"] for r in C.calibrate(df, "p").collect()}
    assert all(abs(got[v] - w) < 1e-12 for v, w in zip(values, want))


def test_sample_is_drawn_from_all_rows(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 100 / 100).alias("s"))
    root = df.agg(F.sum(F.sqrt("s"))).first()[0]
    drawn = C.draw_sample(df, "s", ["id"], 20_000, root, 2_000, 1)
    got = drawn.toPandas()
    assert abs(len(got) - 2_000) < 200 and rows(drawn, "id") == rows(C.draw_sample(df, "s", ["id"], 20_000, root, 2_000, 1), "id")
    assert (got.id < 10_000).mean() == pytest.approx(0.5, abs=0.05) and got._chance.max() > 1.5 * got._chance.min()
    assert (1 / got._chance).sum() == pytest.approx(20_000, rel=0.1)
    assert C.draw_sample(df, "s", ["id"], 20_000, root, 1e9, 1).count() == 20_000


def test_thresholds_with_a_perfect_score():
    scores = np.linspace(0, 1, 401)
    truth = scores > 0.5
    t = C.learn_thresholds(scores, truth, np.ones(401), 0.9, 0.9, 0.1)
    assert 0.3 < t.negative <= 0.56 and 0.45 < t.positive < 1.0
    assert C.learn_thresholds(scores, truth, np.full(401, 7.0), 0.9, 0.9, 0.1) == t
    again = np.random.default_rng(2).permutation(401)
    assert C.learn_thresholds(scores[again], truth[again], np.ones(401), 0.9, 0.9, 0.1) == t
    # all true rows are kept for full recall, and nothing is certain with full precision
    full = C.learn_thresholds(scores, truth, np.ones(401), 1.0, 1.0, 0.1)
    assert full.positive == 1.0 and full.negative == pytest.approx(0.5)


def test_thresholds_without_evidence():
    assert C.learn_thresholds([], [], [], 0.9, 0.9, 0.1) == (1.0, -1.0)
    assert C.learn_thresholds([0.2, 0.9], [False, False], [1, 1], 0.9, 0.9, 0.1) == (1.0, -1.0)
    # a single true row proves no precision; true rows at zero forbid to reject it
    assert C.learn_thresholds([0.9], [True], [1], 0.9, 0.9, 0.1).positive == 1.0
    assert C.learn_thresholds([0.0, 0.9], [True, True], [1, 1], 1.0, 0.9, 0.1).negative == -1.0


@pytest.mark.parametrize("seed", range(5))
def test_thresholds_keep_their_promise(seed):
    draw = np.random.default_rng(seed)
    scores = draw.beta(0.5, 1.5, 20_000)
    truth = draw.random(20_000) < scores
    chance = np.minimum(C.draw_chance(np.sqrt(scores), 20_000, np.sqrt(scores).sum(), 500), 1)
    some = draw.random(20_000) < chance
    t = C.learn_thresholds(scores[some], truth[some], 1 / chance[some], 0.9, 0.8, 0.1)
    assert truth[scores > t.negative].sum() / truth.sum() >= 0.9
    assert t.positive == 1.0 or truth[scores >= t.positive].mean() >= 0.8


def test_join_cascade_samples_many_left_values(spark):
    """True pairs of late left values look unlike those of early ones; both must be met."""
    left = spark.createDataFrame([(i, f"a{i:02d} plain" if i < 20 else f"z{i:02d}") for i in range(40)], "id long, v string")
    right = spark.createDataFrame([(i, f"a{i:02d} plain" if i < 20 else f"other {i}") for i in range(60)], "rid long, w string")

    def rule(spec, c):
        if spec.task == "map":
            return R.value(c)
        a, b = R.value(c), R.value(c, 1)
        return str(a == b or (a[0] == "z" and int(b[-2:]) % 20 == int(a[1:]) % 20 if b[0] == "o" else False))

    model = RuleModel(rule)
    out, stats = sem_join(left, right, "{v:left} fits {w:right}", model, stats=True,
                          cascade=JoinCascade(HashEmbedder(512), recall_target=0.95, precision_target=0.9, sample=1.0, max_labelled=600))
    got = {(r["id"], r["rid"]) for r in out.collect()}
    want = {(i, i) for i in range(20)} | {(i, j) for i in range(20, 40) for j in range(20, 60) if j % 20 == i % 20}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.9 * len(got)


def test_join_cascade_reports_unreadable_samples(spark):
    df = spark.createDataFrame([(i, f"thing {i}") for i in range(20)], "id long, v string")
    other = df.select(F.col("id").alias("rid"), F.col("v").alias("w"))
    bad = RuleModel(lambda s, c: R.value(c) if s.task == "map" else "who knows")
    with pytest.raises(Exception, match="cannot read"):
        sem_join(df, other, "{v:left} is {w:right}", bad, cascade=JoinCascade(HashEmbedder(64), recall_target=0.9, sample=1.0))


def test_join_of_dates_and_booleans(spark):
    days = spark.sql("SELECT id, date_add(DATE'2020-01-01', CAST(id AS INT)) AS day, id % 2 = 0 AS even FROM range(6)")
    words = spark.createDataFrame([(1, "2020-01-02"), (2, "true"), (3, None)], "rid long, w string")
    same = R.judge(lambda c: R.value(c) == R.value(c, 1))
    assert [(r["id"], r["rid"]) for r in sem_join(days, words, "{day:left} is {w:right}", same).collect()] == [(1, 1)]
    assert {(r["id"], r["rid"]) for r in sem_join(words, days, "{w:left} is {even:right}", same).collect()} == {(0, 2), (2, 2), (4, 2)}
    known = days.select("day", F.lit("2020-01-02"))
    assert sem_join(days, words, "{day:left} is {w:right}", same, candidates=known).count() == 1


# --- clusters --------------------------------------------------------------


def test_clusters_and_summary(spark):
    data = [(i, f"{'near' if i % 2 else 'far'} {i % 6}", [float(i % 2) * 10 + i % 3 * 0.01, 1.0]) for i in range(60)]
    df = spark.createDataFrame(data, "id long, name string, vec array<float>")
    out = sem_cluster_by(df, "vec", 2)
    assert out.columns == ["id", "name", "vec", "cluster_id"]
    assert out.groupBy("cluster_id").agg(F.count_distinct(F.split("name", " ")[0]).alias("n")).where("n > 1").count() == 0
    model = RuleModel(lambda s, c: "In short. Answer: " + ("near" if "near" in c else "far"))
    told = cluster_summary(df, "name", "vec", 2, "id", "count", model)
    assert told.columns == ["summary", "id_count"] and rows(told) == [("far", 30), ("near", 30)]
    with pytest.raises(ValueError):
        sem_cluster_by(df.limit(3), "vec", 4)


def test_clusters_are_the_same_in_every_partitioning(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    m = np.repeat(rng.normal(size=(5, 6)) * 5, 40, axis=0) + rng.normal(size=(200, 6)) * 0.1
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(500, None)], "id long, vec array<float>")
    for key in ("id", None):
        found = [{r["id"]: r["cluster_id"] for r in sem_cluster_by(df.repartition(n), "vec", 5, key=key).collect()} for n in (1, 7)]
        assert found[0] == found[1] and len(found[0]) == 200
        assert sorted(len({found[0][i] for i in range(40 * g, 40 * g + 40)}) for g in range(5)) == [1] * 5 and len(set(found[0].values())) == 5


def test_clusters_of_mostly_copies(spark):
    """A hot vector neither fills the sample of starting centres nor hides the others; a cluster may stay empty."""
    hot = [(i, [1.0, 0.0]) for i in range(300)]
    df = spark.createDataFrame([*hot, (300, [0.0, 1.0]), (301, [-1.0, 0.0])], "id long, vec array<float>")
    got = {r["id"]: r["cluster_id"] for r in sem_cluster_by(df, "vec", 3).collect()}
    assert len({got[0], got[300], got[301]}) == 3
    assert {r["cluster_id"] for r in sem_cluster_by(df.where("id < 300"), "vec", 3).collect()} == {0}
