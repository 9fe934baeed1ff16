"""Token counts of a piece model, with a shortcut for words that are one token."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.llm.common import whole_text
from semtab.runtime import col, require_columns

#: The character that stands for a space inside pieces.
SPACE = "▁"
_RUN = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Pre-tokens a worker remembers the length of, at most.
REMEMBERED = 200_000

_loaded: dict[bytes, tuple] = {}


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def whole_words(model: bytes) -> list[str]:
    """Words ``w`` for which the model encodes a space and ``w`` as exactly one token.

    Every vocabulary string is tried with the library itself, since a string may be in
    the vocabulary and still not be reached by merges. The proof also makes sure that
    no vocabulary string has a space behind another character: then merges never cross
    from a word into the next space, and pre-tokens can be counted apart.
    """
    library = _processor(model)
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size()) if not library.is_control(i) and not library.is_unknown(i) and not library.is_byte(i)]
    crossing = [p for p in pieces if SPACE in p.lstrip(SPACE)]
    if crossing:
        raise ValueError(f"vocabulary strings hold a space behind a character: {crossing[:3]}")
    if library.encode("a") and not library.id_to_piece(library.encode("a")[0]).startswith(SPACE):
        raise ValueError("the model does not put a space before the text; pre-tokens can't be told apart")
    words = [p[1:] for p in pieces if p.startswith(SPACE) and p != SPACE]
    proved = [w for w, ids in zip(words, library.encode(words, num_threads=1)) if len(ids) == 1]
    # a last space that stands alone can't be given to the library apart: the prefix it adds is that space
    lone = library.encode("a ")
    return [*proved, *([""] if library.id_to_piece(lone[-1]) == SPACE and len(lone) == len(library.encode("a")) + 1 else [])]


def _pre_tokens(text: str) -> list[str]:
    """Runs of spaces with what follows up to the next space, each without its first space."""
    if not text:
        return []
    text = text.replace(" ", SPACE)
    if SPACE * 2 in text or text[0] == SPACE or text[-1] == SPACE:
        return [p[1:] for p in _RUN.findall(SPACE + text)]
    return text.split(SPACE)


def _known(model: bytes, words: list[str]) -> tuple:
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = (_processor(model), frozenset(words), {})
    return _loaded[model]


def count_tokens(
    docs: DataFrame,
    model_path: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Bytes and tokens of every whole text: ``id n_bytes n_tokens n_whole over_limit``.

    Each text is cut into pre-tokens, a run of spaces with the characters up to the next
    space. Pre-tokens that :func:`whole_words` proved to be one token are counted without
    merging (``n_whole``); each other distinct pre-token of a batch is merged once by the
    library and remembered. The model file is read by the driver and travels with the tasks.

    A missing or empty text has 0 bytes and 0 tokens. Every row of ``docs`` gives one row,
    repeated ones and those without an id included; other columns are left out.
    """
    require_columns(docs, [id_col, text_col])
    with open(model_path, "rb") as f:
        model = f.read()
    words = whole_words(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, whole, lengths = _known(model, words)
        for batch in batches:
            tokens, shortcut = [], []
            for text in batch.column(1):
                parts = _pre_tokens(text.as_py())
                new = [p for p in set(parts) if p not in whole and p not in lengths]
                if len(lengths) + len(new) > REMEMBERED:
                    lengths.clear()
                    new = [p for p in set(parts) if p not in whole]
                lengths.update((p, len(ids)) for p, ids in zip(new, library.encode(new, num_threads=1)))
                rest = [lengths[p] for p in parts if p not in whole]
                shortcut.append(len(parts) - len(rest))
                tokens.append(sum(rest) + shortcut[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(shortcut, pa.int64())], names=["_id", "_bytes", "_tokens", "_whole"]
            )

    text = whole_text(text_col)
    plain = docs.select(col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("_bytes"))
    schema = T.StructType(
        [T.StructField("_id", plain.schema["_id"].dataType), T.StructField("_bytes", T.LongType()), T.StructField("_tokens", T.LongType()), T.StructField("_whole", T.LongType())]
    )
    return plain.mapInArrow(run, schema).select(
        F.col("_id").alias(id_col),
        F.col("_bytes").alias("n_bytes"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_whole").alias("n_whole"),
        (F.col("_tokens") > limit).alias("over_limit"),
    )
