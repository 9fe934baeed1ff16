from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from semtab.models.base import HashEmbedder, RuleModel, parts_of
from semtab.operators.folding import sem_agg, sem_partition_by
from semtab.operators.ranking import sem_topk
from semtab.suite import rules as R
from tests.conftest import rows


@pytest.fixture(scope="module")
def words(spark):
    """Four hundred words, a third of all rows being copies of one of them."""
    df = spark.range(600).select(
        "id", F.when(F.col("id") % 3 == 0, "w050").otherwise(F.format_string("w%03d", F.col("id") * 7 % 401)).alias("word"),
        (F.col("id") % 5).cast("string").alias("g"))
    return df


def expected(words, k):
    return [r["id"] for r in words.orderBy("word", "id").limit(k).collect()]


@pytest.mark.parametrize("method, local_rows", [("quick", 512), ("quick", 40), ("heap", 512), ("heap", 30), ("naive", 150), ("quick-sem", 60)])
@pytest.mark.parametrize("k", [3, 120])
def test_topk_methods_agree(words, method, local_rows, k):
    if method == "naive" and k == 120:
        pytest.skip("one size is enough for all pairs")
    out, stats = sem_topk(words, "first {word}?", k, R.ALPHABET, key="id", method=method, local_rows=local_rows,
                          embedder=HashEmbedder(8), rank="place", stats=True)
    got = out.collect()
    assert [r["id"] for r in got] == expected(words, k)
    assert [r["place"] for r in got] == list(range(1, k + 1))
    assert stats["total_llm_calls"] > 0 and stats["total_tokens"] > stats["total_llm_calls"]


def test_naive_asks_every_pair_once(words):
    n = words.select("word").distinct().count()
    for local_rows in (1000, 70):
        _, stats = sem_topk(words, "first {word}?", 1, R.ALPHABET, key="id", method="naive", local_rows=local_rows, stats=True)
        assert stats["total_llm_calls"] == n * (n - 1) // 2


def test_quick_needs_few_calls(words):
    n = words.select("word").distinct().count()
    _, stats = sem_topk(words, "first {word}?", 3, R.ALPHABET, key="id", local_rows=40, stats=True)
    assert stats["total_llm_calls"] < 4 * n


@pytest.mark.parametrize("method, local_rows", [("quick", 512), ("quick", 20), ("heap", 20), ("naive", 40)])
def test_topk_per_group(words, method, local_rows):
    out = sem_topk(words, "first {word}?", 4, R.ALPHABET, key="id", method=method, local_rows=local_rows, group_by="g", rank="n")
    pdf = words.toPandas().sort_values(["g", "word", "id"])
    want = [(g, i + 1, r.id) for g, part in pdf.groupby("g") for i, r in enumerate(part.head(4).itertuples())]
    assert sorted(tuple(r) for r in out.select("g", "n", "id").collect()) == want


def test_topk_refusals(words):
    for bad in (dict(question="best {id}?"), dict(question="best {no}?"), dict(question="first {word}?", method="bubble"),
                dict(question="first {word}?", method="quick-sem")):
        q = bad.pop("question")
        with pytest.raises(ValueError):
            sem_topk(words, q, 2, R.ALPHABET, key="id", **bad)
    with pytest.raises(Exception, match="document number"):
        sem_topk(words, "first {word}?", 2, RuleModel(lambda s, c: "neither"), key="id").collect()


def test_topk_cascade(words):
    wrong = RuleModel(lambda s, c: "Document 2", chance=lambda s, c: 0.3)
    out = sem_topk(words, "first {word}?", 5, R.ALPHABET, key="id", cascade=(wrong, 0.5))
    assert [r["id"] for r in out.collect()] == expected(words, 5)


# --- folding ---------------------------------------------------------------


def joiner(context_tokens):
    """Puts the values of all parts behind one another: shows order, and that nothing is lost."""
    def rule(spec, c):
        return ",".join(R.whole(p) if spec.task == "fold" else p for p in parts_of(c))

    return RuleModel(rule, context_tokens=context_tokens, reply_tokens=0, batch_size=3)


@pytest.mark.parametrize("tokens, rows_per_task", [(100_000, 4096), (2_500, 50), (1_200, 20)])
def test_fold_keeps_every_row_in_order(spark, tokens, rows_per_task):
    df = spark.range(300).select("id", F.format_string("%d", F.col("id")).alias("v")).repartition(4)
    out, stats = sem_agg(df, "list {v}", joiner(tokens), order_by="id", rows_per_task=rows_per_task, stats=True)
    assert [r["_output"] for r in out.collect()] == [",".join(map(str, range(300)))]
    assert stats["total_llm_calls"] >= 1
    if tokens == 1_200:
        assert stats["total_llm_calls"] > 5


def test_fold_groups_of_unequal_size(spark):
    df = spark.range(400).select("id", F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 20)).alias("g"),
                                 F.col("id").cast("string").alias("v"))
    out = sem_agg(df, "list {v}", joiner(1_800), group_by="g", order_by="id", rows_per_task=16)
    want = df.toPandas().sort_values("id").groupby("g")["v"].agg(",".join).to_dict()
    assert {r["g"]: r["_output"] for r in out.collect()} == want


def test_fold_partitions_share_no_first_prompt(spark):
    df = spark.range(40).select("id", F.concat(F.lit("p"), F.col("id") % 4).alias("p"))
    mixed = RuleModel(lambda s, c: "mixed" if s.task == "fold" and len({R.whole(p) for p in parts_of(c)}) > 1
                      else (R.whole(parts_of(c)[0]) if s.task == "fold" else "|".join(parts_of(c))))
    marked = sem_partition_by(df, lambda t: F.substring("p", 2, 1))
    out = sem_agg(marked, "name {p}", mixed, partition_by="_partition_id")
    assert out.first()["_output"] == "p0|p1|p2|p3"
    assert sem_agg(df, "name {p}", mixed).first()["_output"] == "mixed"


def test_fold_edges(spark):
    one = spark.createDataFrame([("only", 1)], "v string, n long")
    asked = RuleModel(lambda s, c: f"{len(parts_of(c))}:{'[N]' in c}")
    assert sem_agg(one, "sum up", asked).first()["_output"] == "1:True"
    assert sem_agg(one.where("n > 1"), "sum up {v}", asked).count() == 0
    grown = RuleModel(lambda s, c: "x" * 9000, context_tokens=2000, reply_tokens=0)
    df = spark.range(10).select(F.col("id").cast("string").alias("v"))
    assert sem_agg(df, "{v}", grown).count() == 1
    with pytest.raises(ValueError, match="too long to fold"):
        sem_agg(spark.range(3000).select(F.format_string("%0200d", "id").alias("v")), "{v}", grown)
    assert rows(sem_agg(df.withColumn("k", F.when(F.col("v") > "4", "a")), "{v}", joiner(9999), group_by="k", order_by="v")) == [("a", "5,6,7,8,9")]


def test_finished_groups_leave_and_large_ones_are_sliced(spark):
    """A group of most rows among small ones: levels go on with the open group alone, and prompts don't depend on the partitions."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 20)).alias("g"), F.format_string("%05d", "id").alias("v"))
    largest = RuleModel(lambda spec, c: max(p.partition("«")[2].rpartition("»")[0] if spec.task == "fold" else p for p in parts_of(c)), context_tokens=700, reply_tokens=100)
    out, stats = sem_agg(df.repartition(3), "the last {v}", largest, group_by="g", stats=True)
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.max("v").alias("m")).collect()}
    assert {r["g"]: r["_output"] for r in out.collect()} == want
    levels = stats["levels"]
    assert len(levels) >= 2 and levels[0]["open_groups"] >= 1 and levels[-1]["open_groups"] == 0
    assert levels[1]["rows"] < levels[0]["rows"] and levels[0]["tasks"] >= levels[-1]["tasks"]
    _, again = sem_agg(df.repartition(7), "the last {v}", largest, group_by="g", stats=True)
    assert again["total_llm_calls"] == stats["total_llm_calls"]
