from __future__ import annotations

from pyspark.sql import functions as F

from semtab.runtime import key_hash, nan_to_null, stage, staging_root, tasks_for

from tests.conftest import rows


def test_key_hash_tells_missing_values_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), ("aa", ""), ("a", "a")], "x string, y string")
    assert df.select(*key_hash(df, ["x", "y"])).distinct().count() == 4
    zero = spark.sql("SELECT 0.0D AS v UNION ALL SELECT -0.0D")
    assert zero.select(*key_hash(zero, ["v"])).distinct().count() == 1


def test_stage_keeps_names_types_and_emptiness(spark):
    df = spark.createDataFrame([(1, [1.0], "x")], "`a b` long, `c.d:left` array<float>, e string")
    back = stage(df)
    assert back.dtypes == df.dtypes and rows(back) == rows(df)
    assert stage(df.where("e = 'y'")).count() == 0
    assert staging_root(spark) in back.inputFiles()[0]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, None)], "x double, y int")
    assert rows(nan_to_null(df)) == [(2.0, None), (None, 1)]


def test_small_things():
    assert [tasks_for(n, 10) for n in (0, 1, 10, 11)] == [1, 1, 1, 2]


def test_workers_find_the_package(spark):
    def name(batches):
        from semtab.models.base import count_tokens

        for pdf in batches:
            yield pdf.assign(id=count_tokens("12345"))

    assert {r["id"] for r in spark.range(3).mapInPandas(name, "id long").select(F.col("id")).collect()} == {2}
