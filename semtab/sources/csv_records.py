"""CSV with quoted line breaks, read by many tasks per file.

A file is read line by line, each split by itself. Whether a split begins inside a quoted field depends on all
text before it, so a first pass works out per split what it does to either state: one row per split, from
which the driver tells every split the state it begins in. The second pass joins lines to records; what
crosses the end of a split, two pieces per split at most, is put together by a small aggregate.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.runtime import col, stage

# The words that a data frame library reads as missing by default.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_WHOLE, _HEAD, _THROUGH, _TAIL = 0, 1, 2, 3


def after_line(line: str, inside: bool) -> bool:
    """Whether the text behind a line is inside a quoted field; a quote opens a field only where the field begins."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            inside, at = False, at + 1
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if at == 0:
            return False


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Runs of lines of one split: ``((file, start of the split), lines)``, in reading order."""
    for batch in batches:
        files, starts, lines = (batch.column(i).to_pylist() for i in range(3))
        begin = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or (files[k], starts[k]) != (files[begin], starts[begin]):
                yield (files[begin], starts[begin]), lines[begin:k]
                begin = k


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split the state behind it for both states before it."""
    done: dict[tuple[str, int], tuple[bool, bool]] = {}
    for key, lines in _segments(batches):
        out, inside = done.get(key, (False, True))
        for line in lines:
            if '"' in line:
                out, inside = after_line(line, out), after_line(line, inside)
            # a line without a quote leaves both states as they are
        done[key] = (out, inside)
    if done:
        keys = list(done)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [done[k][0] for k in keys], [done[k][1] for k in keys]]
        yield pa.RecordBatch.from_pydict(dict(zip(("file", "start", "outside", "inside"), columns)), pa.schema([("file", pa.string()), ("start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())]))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file start kind nth record``: the records of CSV files, in which quoted fields may hold line breaks.

    ``nth`` counts the records of a split from 0; records that cross a split have NULL. Blank lines are no records.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    begins: dict[tuple[str, int], bool] = {}
    state, last = False, None
    for r in sorted(lines.mapInArrow(_effects, "file string, start long, outside boolean, inside boolean").collect()):
        if r["file"] != last:
            state, last = False, r["file"]
        begins[r["file"], r["start"]] = state
        state = r["inside"] if state else r["outside"]
    inside_at = {k for k, v in begins.items() if v}

    def pieces(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, inside, first, held, nth = None, False, False, [], 0
            rows: list[tuple] = []

            def leave() -> None:
                if held:
                    rows.append((*here, _THROUGH if first else _TAIL, None, "\n".join(held)))
                    held.clear()

            def out() -> pa.RecordBatch:
                some = [r for r in rows if (r[2] == _WHOLE) == wanted]
                rows.clear()
                columns = list(zip(*some)) if some else [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "start", "kind", "nth", "record"])

            for key, some in _segments(batches):
                if key != here:
                    leave()
                    here, inside, first, nth = key, key in inside_at, key in inside_at, 0
                for line in some:
                    held.append(line)
                    if '"' in line:
                        inside = after_line(line, inside)
                    if not inside:
                        text = "\n".join(held).removesuffix("\r")
                        held.clear()
                        if first:
                            rows.append((*here, _HEAD, None, text))
                        elif text:
                            rows.append((*here, _WHOLE, nth, text))
                            nth += 1
                        first = False
                yield out()
            leave()
            yield out()

        return lines.mapInArrow(run, "file string, start long, kind int, nth long, record string")

    crossing = stage(pieces(False), "crossing")
    # a record that crosses splits is one tail, whole splits, one head; a file may end inside a field
    order = Window.partitionBy("file").orderBy("start", "kind")
    numbered = crossing.withColumn("_of", F.sum(F.when(F.col("kind") == _TAIL, 1).otherwise(0)).over(order))
    joined = numbered.groupBy("file", "_of").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["record"]), "\n")
    stitched = joined.select("file", F.col("_p")[0]["start"].alias("start"), F.lit(_TAIL).alias("kind"), F.lit(None).cast("long").alias("nth"), text.alias("record"))
    return pieces(True).unionByName(stitched)


def as_kind(c: Column, kind: T.DataType) -> Column:
    return c if isinstance(kind, T.StringType) else c.try_cast(kind)


def kinds_of(cells: DataFrame) -> list[T.DataType]:
    """Whole numbers, numbers, truth values or text, by all cells of a column; a column of missing cells alone is text."""
    number = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|Infinity)$"
    tests = {"n": lambda c: c.isNotNull(), "i": lambda c: c.rlike(r"^[+-]?\d+$") & c.try_cast("long").isNotNull(), "d": lambda c: c.rlike(number), "b": lambda c: c.isin("True", "False", "true", "false", "TRUE", "FALSE")}
    row = cells.agg(*[F.count_if(t(col(c))).alias(f"{k}{at}") for at, c in enumerate(cells.columns) for k, t in tests.items()]).first()
    out: list[T.DataType] = []
    for at in range(len(cells.columns)):
        n = row[f"n{at}"]
        out.append(T.LongType() if n and row[f"i{at}"] == n else T.DoubleType() if n and row[f"d{at}"] == n else T.BooleanType() if n and row[f"b{at}"] == n else T.StringType())
    return out


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, missing: Sequence[str] = MISSING_WORDS) -> DataFrame:
    """A table from UTF-8 CSV files with headers, whatever line breaks their quoted fields hold; ``missing`` words become NULL.

    Without a ``schema`` types are read off all cells: whole numbers, numbers, truth values, else text (dates stay text).
    """
    rows = records(spark, path)
    first = (F.col("start") == 0) & F.coalesce(F.col("nth") == 0, F.lit(False))
    heads = rows.where(first).orderBy("file").limit(1).collect()
    if not heads:
        raise ValueError(f"{path} has no header")
    names = [n.lstrip("﻿") for n in next(csv.reader([heads[0]["record"]]))]
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if given is not None and len(given) != len(names):
        raise ValueError(f"the header has {len(names)} columns, the schema {len(given)}")
    texts = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(len(names))])
    parsed = rows.where(~first).select(F.from_csv("record", texts.simpleString()[7:-1].replace(":", " "), {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(max(20_480, len(names)))}).alias("_r")).select("_r.*")
    cells = parsed.select(*[F.when(~col(c).isin(*missing), col(c)).alias(c) for c in texts.names])
    kinds = [f.dataType for f in given] if given is not None else kinds_of(cells)
    return cells.select(*[as_kind(col(c), kind).alias(name) for c, kind, name in zip(texts.names, kinds, given.names if given is not None else names)])
