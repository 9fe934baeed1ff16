"""Fill-in-middle: cuts of a text at chosen units, found by content-defined chunks whose counts are remembered."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.llm.common import portions, whole_text
from semtab.runtime import col, require_columns

#: Marks of the three parts. A text that holds one is left plain, so the marks of an output are its own.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that the rolling hash looks at, chunk bounds, and the bits that must be zero behind a chunk.
WINDOW, LEAST, MOST, ZERO_BITS = 32, 256, 16_384, 10
#: Bytes of chunks that a worker remembers, in each of two generations.
REMEMBERED = 16 << 20
#: Bytes hashed at once.
PART = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x80:0xC0] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []
_memo: list = []


def _powers() -> list[np.ndarray]:
    if not _tables:
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _tables[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(PART + WINDOW, b, np.uint64)])) for b in (_BASE, back)]
    return _tables


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of some bytes: where the hash of the last ``WINDOW`` bytes ends a chunk, between ``LEAST`` and ``MOST`` bytes.

    The hash of a window depends on its bytes alone, so equal passages are cut alike wherever they stand.
    """
    power, back = _powers()
    ends, last = [], 0
    for start in range(0, len(data), PART):
        first = max(0, start - WINDOW + 1)
        part = data[first : start + PART].astype(np.uint64) + np.uint64(1)
        if len(part) < WINDOW:
            break
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * power[: len(part)])])
        window = (sums[WINDOW:] - sums[:-WINDOW]) * back[: len(part) - WINDOW + 1]
        for end in (np.flatnonzero(window >> np.uint64(64 - ZERO_BITS) == 0) + first + WINDOW).tolist():
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST:
                last = end
                ends.append(end)
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, len(data)] if len(data) > last else ends


def unit_starts(chunk: bytes) -> np.ndarray:
    """Places where a unit begins: the first letter of a run of ASCII letters, or any other character.

    A chunk that begins with a letter counts it as a first one; bytes inside a character begin nothing.
    """
    data = np.frombuffer(chunk, np.uint8)
    letter = _LETTER[data]
    before = np.concatenate([[False], letter[:-1]])
    return np.flatnonzero(np.where(letter, ~before, ~_FOLLOWS[data]))


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Units begun, characters begun, and whether the first and the last byte are letters: all that its neighbours need to know."""
    data = np.frombuffer(chunk, np.uint8)
    return len(unit_starts(chunk)), int(len(data) - np.count_nonzero(_FOLLOWS[data])), bool(_LETTER[data[0]]), bool(_LETTER[data[-1]])


def remembered(chunk: bytes) -> tuple[int, int, bool, bool]:
    """The summary of a chunk, worked out once while its content is remembered; a hit compares whole contents, not hashes alone."""
    if not _memo:
        _memo[:] = [{}, {}, 0]
    found = _memo[0].get(chunk)
    if found is None:
        found = _memo[1].get(chunk) or summary(chunk)
        if _memo[2] > REMEMBERED:
            _memo[:] = [{}, _memo[0], 0]
        _memo[0][chunk] = found
        _memo[2] += len(chunk) + 200
    return found


class Cutter:
    """Units of one text, and the places of cuts between them."""

    def __init__(self, data: bytes):
        ends = chunk_ends(np.frombuffer(data, np.uint8))
        self.data, self.starts = data, [0, *ends[:-1]]
        self.chunks = [data[a:b] for a, b in zip(self.starts, ends)]
        counted = [remembered(c) for c in self.chunks]
        #: True where a run of letters goes on from the chunk before
        self.joined = [False, *(a[3] and b[2] for a, b in zip(counted, counted[1:]))]
        self.units = [0, *accumulate(c[0] - j for c, j in zip(counted, self.joined))]
        self.points = [0, *accumulate(c[1] for c in counted)]

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and characters before unit number ``units``, counted from 0; the whole text if there is no such unit."""
        if units >= self.units[-1]:
            return len(self.data), self.points[-1]
        k = bisect_right(self.units, units) - 1
        inside = int(unit_starts(self.chunks[k])[units - self.units[k] + self.joined[k]])
        head = np.frombuffer(self.chunks[k], np.uint8)[:inside]
        return self.starts[k] + inside, self.points[k] + int(inside - np.count_nonzero(_FOLLOWS[head]))


def transform(data: bytes, h: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, characters of prefix and middle, and the output of one text by four random numbers."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    cutter = Cutter(data)
    n = cutter.units[-1]
    if not data or any(m in data for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, data
    (a, a_points), (b, b_points) = (cutter.cut(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h[3] % 100 < spm:
        form, parts = "spm", [marks[1], suffix, marks[0], prefix, marks[2], middle]
    else:
        form, parts = "psm", [marks[0], prefix, marks[1], suffix, marks[2], middle]
    return n, form, a_points, b_points - a_points, b"".join(parts)


def random_numbers(id_col: str, seed: int) -> Column:
    """Four numbers below 2**32 from the SHA-256 of ``seed:id``; a missing id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(
    docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, id_col: str = "doc_id", text_col: str = "text", out: str = "output"
) -> DataFrame:
    """Every whole text with its middle moved behind the rest: ``id n form prefix_chars middle_chars`` and the text in ``out``.

    A text is a row of ``n`` units, runs of ASCII letters or single other characters; two cuts
    drawn from 0 to ``n`` by the id part it into prefix, middle and suffix. ``rate`` percent of the ids
    are changed, ``spm`` percent of them into the form that begins with the suffix. Units are counted by
    chunks whose bounds the content sets: a chunk that occurs again (copies, shared passages) is looked up
    by its whole content, neighbouring counts are combined by first and last byte, and only the chunks that
    hold a cut are looked at again.

    A missing text is an empty one. Empty texts, and those that hold a mark already, stay plain: the output is the
    text, ``prefix_chars`` and ``middle_chars`` are NULL. A missing id draws its cuts as an empty one. Every row gives
    one row, repeated rows too; other columns are left out, whatever their names. Very long texts are hashed
    megabyte by megabyte; a worker holds one of them, or about 8 MB of shorter ones, at a time.
    """
    require_columns(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            rows = [transform(t.as_buffer().to_pybytes(), h.as_py(), rate, spm) for t, h in zip(batch.column(1), batch.column(2))]
            n, form, prefix, middle, output = zip(*rows)
            text = pa.array(output, pa.binary()).cast(pa.string())
            arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["_id", "_n", "_form", "_prefix", "_middle", "_output"])

    plain = docs.select(col(id_col).alias("_id"), whole_text(text_col).alias("_text"), random_numbers(id_col, seed).alias("_h"))
    fields = [("_n", T.LongType()), ("_form", T.StringType()), ("_prefix", T.LongType()), ("_middle", T.LongType()), ("_output", T.StringType())]
    schema = T.StructType([T.StructField("_id", plain.schema["_id"].dataType), *(T.StructField(name, kind) for name, kind in fields)])
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", out]
    return plain.mapInArrow(run, schema).select(*[F.col(a).alias(b) for a, b in zip(schema.names, names)])


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of; a row without output has none.

    No mark can begin inside a part and end inside a mark, or the other way round, so the three marks
    of an output are the only ones in it and it falls into four parts, the first of them empty.
    """
    parts = F.split(col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(col(form) == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(col(form) == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(col(output))
    )
