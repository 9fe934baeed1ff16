from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from semtab.functions.sql import register_sql_functions
from semtab.functions.tables import blocking_index
from semtab.models.base import RuleModel, parts_of
from tests.conftest import rows


def ask(spark, rule, **options):
    register_sql_functions(spark, RuleModel(rule, **options))


def test_map_asks_each_distinct_value_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def rule(spec, c):
        with open(log, "a") as f:
            f.write(c)
        return c.partition("«")[2][:1]

    ask(spark, rule)
    df = spark.createDataFrame([("ab",), ("ab",), ("cd",), (None,), ("",)] * 20, "s string")
    got = spark.sql("SELECT s, answer FROM {d} LEFT JOIN llm_map(TABLE(SELECT DISTINCT s FROM {d}), 'first?', 's') USING (s)", d=df)
    assert rows(got.distinct()) == sorted([("ab", "a"), ("cd", "c"), (None, None), ("", "»")], key=repr) and got.count() == 100
    spark.sql("SELECT s, answer FROM llm_map(TABLE(SELECT DISTINCT s FROM {d}), 'first?', 's')", d=df).collect()
    assert open(log).read().count("Value") % 3 == 0  # "ab", "cd" and "" in every run
    with pytest.raises(Exception, match="needs column"):
        spark.sql("SELECT * FROM llm_map(TABLE(SELECT s FROM {d}), 'q', 'nope')", d=df).collect()


def sides(spark):
    left = spark.createDataFrame([(k % 7, f"l{k % 40}") for k in range(200)] + [(None, "l1"), (1, None), (99, "alone")], "b int, v string")
    right = spark.createDataFrame([(k % 5, f"r{k % 30}") for k in range(150)] + [(None, "r1"), (2, None)], "b int, w string")
    return left, right


@pytest.mark.parametrize("cell_values", [3, 1000])
def test_join_judges_pairs_of_a_block_once(spark, cell_values):
    ask(spark, lambda spec, c: "True", batch_size=7)
    left, right = sides(spark)
    index = blocking_index(left, right, "v", "w", "b", "b", cell_values=cell_values)
    got = [tuple(r) for r in spark.sql("SELECT * FROM llm_join(TABLE(SELECT * FROM {i}), 'any')", i=index).collect()]
    want = {(a, b) for x, a in left.collect() for y, b in right.collect() if None not in (a, b, x, y) and x == y}
    assert len(got) == len(want) and set(got) == want


def test_join_keeps_what_holds(spark):
    ask(spark, lambda spec, c: str(c.split("«")[1][1] == c.split("«")[2][1]))
    left, right = sides(spark)
    got = {tuple(r) for r in spark.sql("SELECT * FROM llm_join(TABLE(SELECT * FROM {i}), 'same digit')", i=blocking_index(left, right, "v", "w", F.col("b") % 2, F.col("b") % 2)).collect()}
    want = {(a, b) for x, a in left.collect() for y, b in right.collect() if None not in (a, b, x, y) and x % 2 == y % 2 and a[1] == b[1]}
    assert got == want and want


def test_join_refuses_products(spark):
    ask(spark, lambda spec, c: "True")
    left, right = sides(spark)
    with pytest.raises(ValueError, match="max_calls"):
        blocking_index(left, right, "v", "w", F.lit(1), F.lit(1), max_calls=100)
    assert blocking_index(left, right, "v", "w", F.lit(1), F.lit(1), max_calls=None).count() > 0
    own = "SELECT 'left' AS side, {b} AS block, v AS value FROM {{l}} UNION ALL SELECT 'right', {b}, w FROM {{r}}"
    for block, message in (("CAST(NULL AS INT)", "without a block"), ("1", "more than 10 pairs")):
        with pytest.raises(Exception, match=message):
            spark.sql(f"SELECT * FROM llm_join(TABLE({own.format(b=block)}), 'any', 10)", l=left, r=right).collect()
    plain = spark.sql(f"SELECT * FROM llm_join(TABLE({own.format(b='b')}), 'any')", l=left.where("b IS NOT NULL"), r=right.where("b IS NOT NULL"))
    assert plain.distinct().count() == spark.sql("SELECT DISTINCT v, w FROM {l} a JOIN {r} c USING (b) WHERE v IS NOT NULL AND w IS NOT NULL", l=left, r=right).count()
    empty = blocking_index(left.limit(0), right, "v", "w", "b", "b")
    assert spark.sql("SELECT * FROM llm_join(TABLE(SELECT * FROM {i}), 'any')", i=empty).collect() == []


def test_join_takes_more_than_a_million_pairs(spark):
    """One block of 1,100 by 1,100 values; hashes make its cells unequal."""
    ask(spark, lambda spec, c: str(c.split("«")[1][1:].split("»")[0] == c.split("«")[2][1:].split("»")[0]), batch_size=10_000)
    left, right = (spark.range(1_100).select(F.lit(1).alias("b"), F.concat(F.lit(x), "id").alias("v")) for x in "lr")
    index = blocking_index(left, right, "v", "v", "b", "b")
    got = spark.sql("SELECT * FROM llm_join(TABLE(SELECT * FROM {i}), 'same number')", i=index)
    assert got.where("substr(left, 2) = substr(right, 2)").count() == got.count() == 1_100


def test_join_cells_have_no_more_pairs_than_are_taken(spark):
    side = spark.range(20_000).select(F.lit(1).alias("b"), F.col("id").cast("string").alias("v"))
    index = blocking_index(side, side, "v", "v", "b", "b")
    sizes = index.groupBy("cell").agg(F.count(F.when(F.col("side") == "left", 1)).alias("l"), F.count(F.when(F.col("side") == "right", 1)).alias("r"))
    most, pairs = sizes.agg(F.max(F.col("l") * F.col("r")), F.sum(F.col("l") * F.col("r"))).first()
    assert pairs == 20_000**2 and most <= 1 << 20


@pytest.mark.parametrize("budget", [300, 100_000])
def test_qa_folds_in_order(spark, budget):
    """The rule joins first and last, so order and completeness show."""

    def rule(spec, c):
        parts = parts_of(c)
        return f"{parts[0].split('-')[0]}-{parts[-1].split('-')[-1]}"

    ask(spark, rule, context_tokens=budget, reply_tokens=10)
    df = spark.createDataFrame([("a" if k % 3 else "b", k, str(k)) for k in range(600)] + [("c", 1, None), ("a", 1000, None), ("d", 5, "5")], "g string, t int, s string")
    got = spark.sql("SELECT g, answer, calls FROM llm_qa(TABLE(SELECT * FROM {d}) PARTITION BY g ORDER BY (t), 'span?', 's', 'g')", d=df)
    found = {r["g"]: (r["answer"], r["calls"]) for r in got.collect()}
    assert {g: a for g, (a, _) in found.items()} == {"a": "1-599", "b": "0-597", "c": None, "d": "5-5"}
    assert found["c"][1] == 0 and found["d"][1] == 1 and (found["a"][1] > 3) == (budget == 300)
    sliced = spark.sql(
        """SELECT g, answer FROM llm_qa(TABLE(
               SELECT * FROM llm_qa(TABLE(SELECT g, t, s, t DIV 50 AS slice FROM {d}) PARTITION BY (g, slice) ORDER BY (t), 'span?', 's', 'g,slice')
           ) PARTITION BY g ORDER BY (slice), 'span?', 'answer', 'g', true)""",
        d=df,
    )
    assert rows(sliced) == sorted(((g, a) for g, (a, _) in found.items()), key=repr)


def test_qa_says_when_answers_do_not_fit(spark):
    ask(spark, lambda spec, c: "x" * 2_000, context_tokens=500, reply_tokens=10)
    df = spark.range(400).selectExpr("'g' AS g", "repeat('y', 300) AS s")
    with pytest.raises(Exception, match="too long to fold"):
        spark.sql("SELECT * FROM llm_qa(TABLE(SELECT * FROM {d}) PARTITION BY (g), 'q', 's', 'g')", d=df).collect()
