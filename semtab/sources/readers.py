"""Reading tables, column descriptions, stored processes and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.runtime import col, pick
from semtab.sources.csv_records import MISSING_WORDS, as_kind, kinds_of, read_records

_COST = T.StructType(
    [
        T.StructField("total_cost", T.DoubleType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("cache_hits", T.LongType()),
    ]
)
_TEXT = T.StringType()

#: A query with its stored steps. Free-form members are kept as JSON text.
PROCESS = T.StructType(
    [
        T.StructField("database", _TEXT),
        T.StructField("type", _TEXT),
        T.StructField("query", _TEXT),
        T.StructField(
            "process",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("initial_table", T.ArrayType(T.MapType(_TEXT, _TEXT))),
                        T.StructField("operator", _TEXT),
                        T.StructField("params", _TEXT),
                        T.StructField("result", _TEXT),
                        T.StructField("current_table", T.ArrayType(_TEXT)),
                        T.StructField("execution_time", T.DoubleType()),
                        T.StructField("Thought", _TEXT),
                        T.StructField("Final Answer", _TEXT),
                    ]
                )
            ),
        ),
    ]
)

#: The recorded steps of a model that worked on a query.
RESPONSE = T.StructType(
    [
        T.StructField("file_path", _TEXT),
        T.StructField("query", _TEXT),
        T.StructField(
            "history",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("thought", _TEXT),
                        T.StructField("action", _TEXT),
                        T.StructField("action_input", _TEXT),
                        T.StructField("observation", _TEXT),
                        T.StructField("current_tables", T.ArrayType(_TEXT)),
                        T.StructField("cost", _COST),
                        T.StructField("has_failed", T.BooleanType()),
                        T.StructField("final answer", _TEXT),
                    ]
                )
            ),
        ),
        T.StructField("result", _TEXT),
        T.StructField("link", _TEXT),
        T.StructField("decomposition", T.ArrayType(_TEXT)),
    ]
)


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = True,
    encoding: str = "utf-8",
) -> DataFrame:
    """A table from CSV with a header; empty cells and words such as ``NA``, ``null`` or ``nan`` become NULL.

    Quoted fields may hold line breaks: UTF-8 files are split over tasks all the same (:mod:`semtab.sources.csv_records`), files in
    another encoding are read one per task. ``multiline=False`` promises that no field holds a line break, which
    saves a pass. Give a ``schema`` for large files: inference reads the data once more.
    """
    if multiline and encoding.lower().replace("-", "") in ("utf8", "usascii", "ascii"):
        return read_records(spark, path, schema)
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", multiline).option("encoding", encoding)
    texts = reader.csv(path)
    if schema is None:
        # types are read off the cells that are left when missing words are gone
        marked = texts.select(*[F.when(~col(c).isin(*MISSING_WORDS), col(c)).alias(c) for c in texts.columns])
        kinds = kinds_of(marked)
        return marked.select(*[as_kind(col(c), k).alias(c) for c, k in zip(texts.columns, kinds)])
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = [F.when(~col(c).isin(*MISSING_WORDS), col(c)) for c in texts.columns]
    return texts.select(*[as_kind(c, f.dataType).alias(f.name) for c, f in zip(marked, given.fields)])


def detect_encoding(spark: SparkSession, path: str) -> str:
    """utf-8 (with or without mark) where all files decode so from end to end, else iso-8859-1."""
    whole = spark.read.format("binaryFile").load(path).select(F.is_valid_utf8(F.col("content").cast("string")).alias("ok"))
    return "iso-8859-1" if whole.where(~F.col("ok")).take(1) else "utf-8"


def scan_description_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Column descriptions as ``(name, description)``.

    The file holds ``original_column_name``, ``column_description`` and
    ``value_description``; line breaks become spaces and missing texts ``NULL``.
    """
    encoding = encoding or detect_encoding(spark, path)
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = raw.option("encoding", encoding).csv(path)
    df = df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])

    def clean(name: str):
        return F.coalesce(F.regexp_replace(col(name), r"\r?\n", " "), F.lit("NULL"))

    return df.select(
        F.trim(col("original_column_name")).alias("name"),
        F.concat(
            F.lit("column_description="), clean("column_description"),
            F.lit("; value_description="), clean("value_description"),
        ).alias("description"),
    )


def scan_process_json(
    spark: SparkSession, path: str, schema: T.StructType = PROCESS, multiline: bool = True
) -> DataFrame:
    """Stored JSON documents from a folder tree, with their ``file``: one per file, or one per line."""
    reader = spark.read.schema(schema).option("multiLine", multiline).option("recursiveFileLookup", True)
    return reader.json(path).withColumn("file", F.input_file_name())


def scan_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A stored embedding table ``(key, vec)``."""
    return spark.read.parquet(path)


def steps_of(documents: DataFrame, steps: str = "process") -> DataFrame:
    """One row per stored step: the document's columns, ``pos`` and the step's fields."""
    kept = [c for c in documents.columns if c != steps]
    return documents.select(*[col(c) for c in kept], F.posexplode(col(steps)).alias("pos", "_s")).select(
        *[col(c) for c in kept], "pos", "_s.*")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose result does not exist yet."""
    side = done.select(pick(done, key).alias("_done")).distinct()
    return todo.join(side, pick(todo, key) == F.col("_done"), "left_anti")
