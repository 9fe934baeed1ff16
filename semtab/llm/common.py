"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtab.runtime import col, require_columns

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARACTERS = " \t\n\x0b\x0c\r"


def whole_text(name: str) -> Column:
    """The text of a row; a missing text is an empty one."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id _mark _text``: a row is known by its id and a hash of its text.

    Rows with the same id and the same text are one document to the operators; a
    missing id is an id of its own kind.
    """
    require_columns(docs, [id_col, text_col])
    return docs.select(
        col(id_col).alias("_id"), F.xxhash64(col(text_col).isNull(), col(text_col)).alias("_mark"), whole_text(text_col).alias("_text")
    )


def mark_of(docs: DataFrame, text_col: str) -> Column:
    """The ``_mark`` of :func:`keyed` for the rows of a table."""
    text = docs["`" + text_col.replace("`", "``") + "`"]
    return F.xxhash64(text.isNull(), text)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column has yet, whatever their case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def portions(batches: Iterator[pa.RecordBatch], column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of some batches in runs whose values in ``column`` hold about ``limit`` bytes; a longer value is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for row, n in enumerate(sizes):
            if size + n > limit and row > start:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)
