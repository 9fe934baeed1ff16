"""Byte-level BPE by a piece model that is written straight from a table of ranks."""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.llm.common import fresh, portions, whole_text
from semtab.runtime import col, require_columns

#: Byte ``b`` is written as the character ``chr(FIRST + b)``: letters, of which none is a space or the mark of one.
FIRST = 0x100
_TO_CHARACTERS = {b: chr(FIRST + b) for b in range(256)}
#: A pre-token of more bytes is cut where no token can reach across.
LONG = 1 << 16
#: Pre-tokens a worker remembers the ids of, and the length up to which it does.
REMEMBERED, SHORT = 200_000, 64
#: Matches of the pattern that are looked up at once.
AT_ONCE = 100_000

_loaded: dict[tuple, tuple] = {}


def read_ranks(path: str) -> bytes:
    """The file of ranks, a line of base64 and rank per token, as the driver reads it."""
    with open(path, "rb") as f:
        return f.read()


def tokens_by_rank(table: bytes) -> list[bytes]:
    """The byte strings of a table of ranks; the ranks must be 0, 1, 2, … so that an id is a place in the list."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, table.splitlines()) if token}
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must count up from 0 without a gap")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes {missing[:5]} have no token of their own; such a table can't encode every text")
    return order


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a serialised message: whole numbers, 32-bit floats and bytes differ in their wire type."""
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    return _number(number << 3) + _number(value)


def piece_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model with the given tokens as pieces ``0, 1, 2, …``.

    Each byte of a token is one character of its piece; the score is the negative rank, so
    that the pair with the lowest rank merges first, the leftmost of equal ones before the
    others. Text is not normalised, no space is added, removed or marked. One more piece
    behind the last rank is the unknown one the format asks for; no text reaches it.
    """
    normal, unknown, bpe = 1, 2, 2
    pieces = [(t.decode("latin-1").translate(_TO_CHARACTERS), -float(rank), normal) for rank, t in enumerate(tokens)]
    body = [_field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind)) for text, score, kind in [*pieces, ("<unk>", 0.0, unknown)]]
    trainer = _field(3, bpe)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, no trimming, no marked spaces
    return b"".join(body) + _field(2, trainer) + _field(3, normalizer)


def _load(table: bytes, pattern: str) -> tuple:
    """Library, pattern, whole tokens, remembered ids, joined bytes; one vocabulary is kept per worker."""
    key = (table, pattern)
    if key not in _loaded:
        import regex
        import sentencepiece

        tokens = tokens_by_rank(table)
        library = sentencepiece.SentencePieceProcessor(model_proto=piece_model(tokens))
        inside = {t[i : i + 2] for t in tokens for i in range(len(t) - 1)}
        _loaded.clear()
        _loaded[key] = (library, regex.compile(pattern), {t: _packed([rank]) for rank, t in enumerate(tokens)}, {}, inside)
    return _loaded[key]


def _cuts(data: bytes, inside: set[bytes]) -> Iterator[bytes]:
    """A long pre-token in parts of about ``LONG`` bytes, cut between two bytes that stand side by side in no token.

    Merges never cross such a place, so the parts have the ids of the whole. Where there is no such place the part goes on.
    """
    start = 0
    for place in range(1, len(data)):
        if place - start >= LONG and data[place - 1 : place + 1] not in inside:
            yield data[start:place]
            start = place
    yield data[start:]


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def _lookup(parts: set[str], loaded: tuple) -> dict[str, bytes]:
    """The ids of distinct pre-tokens as 32-bit numbers; new ones are merged in one call of the library."""
    library, _, whole, known, inside = loaded
    extra: dict[str, bytes] = {}  # what is not remembered beyond these parts
    new, spelt = [], []
    for part in parts.difference(known):
        data = part.encode()
        if data in whole:  # a whole token is one id, whether or not merges reach it
            extra[part] = whole[data]
        elif len(data) > LONG:
            pieces = [p.decode("latin-1").translate(_TO_CHARACTERS) for p in _cuts(data, inside)]
            extra[part] = b"".join(map(_packed, library.encode(pieces, num_threads=1)))
        else:
            new.append(part)
            spelt.append(data.decode("latin-1").translate(_TO_CHARACTERS))
    if spelt:
        extra.update(zip(new, map(_packed, library.encode(spelt, num_threads=1))))
    if len(known) + len(extra) > REMEMBERED:
        extra.update((p, known[p]) for p in parts.intersection(known))
        known.clear()
    known.update((p, ids) for p, ids in extra.items() if len(p) <= SHORT)
    return {**known, **extra} if any(len(p) > SHORT for p in extra) else known


def encode(texts: list[str], loaded: tuple) -> list[bytes]:
    """The ids of each text as 32-bit numbers. Short texts are looked up together, a long one is cut match by match."""
    pattern, out = loaded[1], []
    waiting: list[list[str]] = []

    def flush() -> None:
        ids = _lookup(set().union(*waiting), loaded)
        out.extend(b"".join(map(ids.__getitem__, parts)) for parts in waiting)
        waiting.clear()

    size = 0
    for text in texts:
        if len(text) < AT_ONCE:
            waiting.append(pattern.findall(text))
            size += len(text)
            if size > 10 * AT_ONCE:
                flush()
                size = 0
        else:
            flush()
            found, parts_of = (m.group() for m in pattern.finditer(text)), []
            while parts := list(islice(found, AT_ONCE)):
                parts_of.append(b"".join(map(_lookup({*parts}, loaded).__getitem__, parts)))
            out.append(b"".join(parts_of))
    flush()
    return out


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Token ids of every whole text: ``id ids``, as the rank table's own library gives them without special tokens.

    A text is cut into the matches of ``pattern``. A match that is a token is that token; each
    other distinct match is merged by a sentencepiece model serialised from the ranks
    (:func:`piece_model`), once as long as a worker remembers it. The file of ranks is read by
    the driver and travels with the tasks.

    A missing or empty text has no ids (an empty list). Every row of ``docs`` gives one row,
    repeated rows and those without an id included; other columns are left out, whatever
    their names. Very long texts are cut match by match, very long matches between bytes that no
    token joins; a worker holds one text and its ids beside about 8 MB of shorter ones.
    """
    require_columns(docs, [id_col, text_col])
    table = read_ranks(ranks_path)
    tokens_by_rank(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _load(table, pattern)
        for batch in portions(batches, 1):
            ids = encode(batch.column(1).to_pylist(), loaded)
            ends = np.cumsum([0, *map(len, ids)]) // 4
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["_id", "_ids"])

    plain = docs.select(col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = T.StructType([T.StructField("_id", plain.schema["_id"].dataType), T.StructField("_ids", T.ArrayType(T.IntegerType()))])
    return plain.mapInArrow(run, schema).select(F.col("_id").alias(id_col), F.col("_ids").alias(ids_col))


def decode_ids(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The bytes that lists of ids stand for, as a further column ``out`` (binary) behind all others.

    Each id's piece is asked of the serialised model and its characters are mapped back to
    bytes. The bytes need not be a whole text: lists may be cut anywhere. A missing list gives
    a missing value, an empty one no bytes, an unknown or missing id is an error. A column that bears
    the name ``out`` already is replaced.
    """
    require_columns(encoded, [ids_col])
    table = read_ranks(ranks_path)
    rest = [c for c in encoded.columns if c != out or c == ids_col]
    name = fresh(out, []) if out not in rest else fresh(f"_{out}", rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _load(table, "")[0]
        back = np.array([bytes(ord(c) - FIRST for c in library.id_to_piece(i)) for i in range(library.get_piece_size() - 1)], object)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                data = [b"".join(back[x.values.to_numpy()]) if x.is_valid else None for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(data, pa.binary())], names=[*part.schema.names[:-1], name])

    given = encoded.select(*[col(c) for c in rest], col(ids_col).alias(fresh("_ids", rest)))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(name, T.BinaryType())])
    return given.mapInArrow(run, schema).withColumnRenamed(name, out) if name != out else given.mapInArrow(run, schema)
