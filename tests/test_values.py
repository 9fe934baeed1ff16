from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from semtab.operators import values as V
from tests.conftest import rows

NAN = float("nan")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "Ann", 30.0, "x"), (2, "bob", None, "x"), (3, None, NAN, None), (4, "Ann%", 10.0, "y"), (5, "annex", -5.0, "y")],
        "id long, name string, age double, team string",
    )


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filter_numbers(people):
    assert ids(V.filter_rows(people, "age", [("ge", "10"), ("lt", 30)])) == [4]
    assert ids(V.filter_rows(people, "age", [("ne", 10)])) == [1, 2, 3, 5]
    assert ids(V.filter_rows(people, "id", [("gt", 2.5)])) == [3, 4, 5]
    assert ids(V.filter_rows(people, "id", [("eq", "2")])) == [2]


def test_filter_text(people):
    assert ids(V.filter_rows(people, "name", [("eq", "Ann")])) == [1]
    assert ids(V.filter_rows(people, "name", [("ne", "Ann")])) == [2, 3, 4, 5]
    assert ids(V.filter_rows(people, "name", [("like", "ANN")])) == [1, 4, 5]
    assert ids(V.filter_rows(people, "name", [("like", "%n%x")])) == [5]
    assert ids(V.filter_rows(people, "name", [("like", "A.n")])) == []


def test_filter_missing(people):
    assert ids(V.filter_rows(people, "age", [("eq", "nan")])) == [2, 3]
    assert ids(V.filter_rows(people, "age", [("ne", None)])) == [1, 4, 5]
    assert ids(V.filter_rows(people, "team", [("eq", NAN)])) == [3]


@pytest.mark.parametrize(
    "column, cond",
    [("age", ("eq", "old")), ("name", ("gt", "A")), ("name", ("is", "A")), ("age", ("like", "1")), ("age", ("gt", "nan")), ("no", ("eq", 1))],
)
def test_filter_refusals(people, column, cond):
    with pytest.raises(ValueError):
        V.filter_rows(people, column, [cond])


def test_filter_dates(spark):
    df = spark.sql("SELECT 1 AS id, DATE'2024-01-05' AS d UNION ALL SELECT 2, DATE'2024-03-01'")
    assert ids(V.filter_rows(df, "d", [("gt", "2024-02-01")])) == [2]


def test_project(people):
    assert V.project(people, ["team", "id", "id"]).columns == ["team", "id", "id"]
    assert V.project(people, "id").columns == ["id"]
    with pytest.raises(ValueError):
        V.project(people, ["nope"])


def test_orderby_missing_last_both_ways(people):
    up = [r["id"] for r in V.orderby(people, "age", "asc", tie_break="id").collect()]
    down = [r["id"] for r in V.orderby(people, ["age"], "desc", tie_break="id").collect()]
    assert up == [5, 4, 1, 2, 3]
    assert down == [1, 4, 5, 2, 3]


def test_head(people):
    assert [r["id"] for r in V.head(people, 2, order_by="id", ascending="desc").collect()] == [5, 4]
    assert V.head(people, 0).count() == 0
    for bad in (-1, "3", 2.0, True):
        with pytest.raises(ValueError):
            V.head(people, bad)


def test_head_plans_as_top_n(people):
    plan = V.head(people, 2, order_by="id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_join_naming_and_null_keys(spark):
    a = spark.createDataFrame([(1, "p", 1), (None, "q", 2)], "k long, name string, v int")
    b = spark.createDataFrame([(1.0, "P"), (None, "Q"), (9.0, "R")], "k2 double, name string")
    out = V.join(a, b, "k", "k2")
    assert out.columns == ["k", "name_x", "v", "k2", "name_y"]
    assert rows(out) == [(1, "p", 1, 1.0, "P"), (None, "q", 2, None, "Q")]
    assert V.join(a, b, "k", "k2", null_safe=False).count() == 1
    same = V.join(a, a, "k", "k")
    assert same.columns == ["k", "name_x", "v_x", "name_y", "v_y"]
    assert same.count() == 2
    with pytest.raises(ValueError):
        V.join(a, b, "k", "name")


def test_join_spreads_the_rows_of_a_key(spark):
    a = spark.range(4_000).selectExpr("CASE WHEN id % 100 > 0 THEN id % 2 END AS k", "id AS v")
    b = spark.range(50).selectExpr("CASE WHEN id > 0 THEN id % 2 END AS k", "id AS v")
    for null_safe in (True, False):
        plain, dealt = (V.join(a, b, "k", "k", null_safe=null_safe, spread=n) for n in (1, 8))
        assert dealt.columns == plain.columns and rows(dealt) == rows(plain)
    made = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 8 and max(r["count"] for r in made) < dealt.count() / 4


def test_join_spread_writes_short_runs(spark):
    a = spark.range(100).selectExpr("0 AS k", "id AS v")
    b = spark.range(4_000).selectExpr("0 AS k", "id AS w").union(spark.range(600).selectExpr("0 AS k", "-1L AS w"))
    made = V.join(a, b, "k", "k", spread=2).select(F.spark_partition_id().alias("p"), "v", "w").toPandas()
    assert len(made) == 100 * 4_600 and (made["w"] == -1).sum() == 100 * 600 and made["v"].nunique() == 100
    for _, task in made.groupby("p"):
        # left rows take turns with the same few right rows
        assert task["v"][:8 * V.RUN_ROWS].nunique() >= 8 and task["w"][:8 * V.RUN_ROWS].nunique() <= V.RUN_ROWS


def test_join_spread_compares_keys_of_two_types(spark):
    a = spark.createDataFrame([(1, "p"), (None, "q"), (16_777_217, "r"), (0, "s")], "k long, name string")
    b = spark.createDataFrame([(1.0, "P"), (None, "Q"), (16_777_216.0, "R"), (16_777_217.0, "S"), (-0.0, "T"), (NAN, "U")], "k2 double, name string")
    got = rows(V.join(a, b, "k", "k2", spread=4))
    assert got == rows(V.join(a, b, "k", "k2")) and len(got) == 4
    assert rows(V.join(b, b, "k2", "k2", spread=4).select("name_x", "name_y")) == [(c, c) for c in "PQRSTU"]
    odd = spark.createDataFrame([(1, {"a": 1})], "k long, m map<string,int>")
    assert V.join(odd, a, "k", "k", spread=4).count() == 1


def test_join_odd_column_names(spark):
    a = spark.createDataFrame([(1, 2)], ["aCL IgG", "x.y:left"])
    b = spark.createDataFrame([(1, 3)], ["aCL IgG", "x.y:left"])
    assert V.join(a, b, "aCL IgG", "aCL IgG").columns == ["aCL IgG", "x.y:left_x", "x.y:left_y"]


def test_agg(people, spark):
    one = lambda f, c="age": V.agg(people, c, f).first()[0]
    assert (one("sum"), one("count"), one("min"), one("max")) == (35.0, 3, -5.0, 30.0)
    assert math.isclose(one("mean"), 35 / 3)
    assert V.agg(people, "*", "count").first().asDict() == {"id": 5, "name": 4, "age": 3, "team": 4}
    none = people.where("id < 0")
    assert V.agg(none, "age", "sum").first()[0] == 0.0
    assert V.agg(none, "age", "min").first()[0] is None
    for bad in (("age", "median"), ("name", "sum"), ("*", "sum")):
        with pytest.raises(ValueError):
            V.agg(people, *bad).collect()


def test_groupby(people):
    out = V.groupby(people, "team", "age", "sum", sort=True)
    assert out.columns == ["team", "age_sum"]
    assert rows(out) == [("x", 30.0), ("y", 5.0)]
    assert rows(V.groupby(people, ["team"], "team", "count")) == [("x", 2), ("y", 2)]
    assert rows(V.groupby(people, "team", "name", "first", order_by="id")) == [("x", "Ann"), ("y", "Ann%")]
    with pytest.raises(ValueError):
        V.groupby(people, "team", "team", "max")
    with pytest.raises(ValueError):
        V.groupby(people, "team", "name", "first")


@pytest.mark.parametrize("in_memory", [1_000_000, 0])
def test_median_of_hot_and_small_groups(spark, in_memory):
    from semtab.operators.running import exact_median

    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("k"),
        (F.col("id") * 37 % 1009).cast("double").alias("v"),
    )
    got = {r["k"]: r["m"] for r in exact_median(df, ["k"], "v", "m", in_memory).collect()}
    want = df.toPandas().groupby("k")["v"].median().to_dict()
    assert got == want
    empty = V.groupby(df.withColumn("v", F.when(F.col("k") != "hot", F.col("v"))), "k", "v", "median")
    assert {r["k"]: r["v_median"] for r in empty.collect()}["hot"] is None


@pytest.mark.parametrize("bins", [4, 4096])
def test_median_by_rounds_of_counting(spark, bins):
    """Ties, infinities, wide and narrow ranges, two middle values far apart; whole tables and groups."""
    import statistics

    from semtab.operators.running import exact_median

    inf = float("inf")
    data = {"ties": [1.0] * 30 + [2.0] * 31, "even": [1.0] * 10 + [5.0] * 10, "wide": [10.0**k for k in range(-40, 41)], "narrow": [1 + k * 1e-15 for k in range(64)],
            "ends": [-inf] * 9 + [inf] * 8 + [3.0, -1e308, 1e308, 2.0], "one": [7.0], "two": [1.0, 4.0], "zero": [0.0, -0.0, 0.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("none", None), ("ties", None)], "k string, v double").repartition(3)
    got = {r["k"]: r["m"] for r in exact_median(df, ["k"], "v", "m", 2, bins).collect()}
    assert got == {**{k: statistics.median(v) for k, v in data.items()}, "none": None}
    every = sorted(v for vs in data.values() for v in vs)
    assert exact_median(df, [], "v", "m", 2, bins).first()["m"] == statistics.median(every)


def test_column_calculate(spark):
    df = spark.createDataFrame([(1, 2, "a", "b"), (1, 0, "c", None), (0, 0, "e", "f"), (-1, 0, "g", "h")], "a int, b int, s string, t string")
    div = [r["result"] for r in V.column_calculate(df, "a", "b", "div").collect()]
    assert div[:2] == [0.5, math.inf] and math.isnan(div[2]) and div[3] == -math.inf
    assert [r["result"] for r in V.column_calculate(df, "a", "b", "div", zero="null").collect()] == [0.5, None, None, None]
    assert [r["r"] for r in V.column_calculate(df, "a", "b", "sub", out="r").collect()] == [-1, 1, 0, -1]
    assert [r["result"] for r in V.column_calculate(df, "s", "t", "add").collect()] == ["ab", None, "ef", "gh"]
    for bad in (("a", "s", "add"), ("s", "t", "mul"), ("a", "b", "pow")):
        with pytest.raises(ValueError):
            V.column_calculate(df, *bad)


def test_value_calculate(people):
    mean = V.agg(people, "age", "mean")
    assert V.value_calculate("sub", mean, 1).first()[0] == pytest.approx(35 / 3 - 1)
    assert V.value_calculate("div", 7, 2).first()[0] == 3.5
    assert [V.value_calculate("round", x).first()[0] for x in (0.5, 1.5, 2.4)] == [0.0, 2.0, 2.0]
    for bad in (("add", 1), ("round", 1, 2), ("pow", 1, 2)):
        with pytest.raises(ValueError):
            V.value_calculate(*bad)
    with pytest.raises(ZeroDivisionError):
        V.value_calculate("div", 1, 0)


def test_filters_and_columns_reach_the_scan(tables):
    out = V.project(V.filter_rows(tables.lineitem, "l_quantity", [("ge", 24)]), ["l_orderkey"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,24.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
