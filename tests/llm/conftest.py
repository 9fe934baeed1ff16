from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from ``(id, text)``, ``(id, text, source)`` or ``(id, text, source, lang)`` rows."""

    def build(rows, extra: bool = False):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:  # names that operators use inside, or return
            df = df.selectExpr("*", "1 AS _id", "'x' AS _text", "2 AS _mark", "'q' AS size", "'t' AS target", "0 AS score", "'y' AS host")
        return df

    return build


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
