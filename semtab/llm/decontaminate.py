"""Benchmark items inside documents: SimHash of item-sized windows, Hamming index, exact check."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from semtab.llm.common import keyed, whole_text
from semtab.runtime import col, require_columns

#: Bytes of text that are hashed at once, and what a longer text is cut into.
PART = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _PLACES[0]
    x = (x ^ (x >> np.uint64(27))) * _PLACES[1]
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, PART), b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word in some bytes; words end at ASCII white space."""
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = _mix(out * _BASE + words[i : i + n] * _PLACES[i % len(_PLACES)])
    return out


def window_prints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the windows of ``n`` shingles at the given starts: each occurrence of a shingle weighs one."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:], dtype=np.int32)
    return np.packbits(2 * (sums[starts + n] - sums[starts]) > n, axis=1, bitorder="little").view("<u8").ravel()


def distinct_prints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the same windows with each distinct shingle weighing one, however often it occurs."""
    order = np.argsort(shingles, kind="stable")
    before = np.full(len(shingles), -1)
    same = shingles[order[1:]] == shingles[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    out = np.empty(len(starts), np.uint64)
    for k, start in enumerate(starts.tolist()):
        own = shingles[start : start + n][before[start : start + n] < start]
        out[k] = window_prints(own, np.array([0]), len(own))[0]
    return out


class HammingIndex:
    """All of some fingerprints within a radius: four blocks of 16 bits, one of which differs in a quarter of it at most.

    A fingerprint is entered once per block. A look-up reads the lists of all block values within that share
    of the radius, so the index stays a few bytes per fingerprint at any radius.
    """

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        self.near = np.array([sum(1 << b for b in flips) for n in range(radius // 4 + 1) for flips in combinations(range(16), n)], np.int64)
        self.lists, self.offsets = [], []
        for block in range(4):
            value = (prints >> np.uint64(16 * block)).astype(np.int64) & 0xFFFF
            order = np.argsort(value, kind="stable")
            self.lists.append(order.astype(np.int32))
            self.offsets.append(np.searchsorted(value[order], np.arange(0x10001)).astype(np.int32))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and entry within the radius, each once."""
        pairs = [np.empty(0, np.int64)]
        step = max(1, 2_000_000 // len(self.near))
        for begin in range(0, len(queries), step):
            some = queries[begin : begin + step]
            for block in range(4):
                value = (((some >> np.uint64(16 * block)).astype(np.int64) & 0xFFFF)[:, None] ^ self.near[None, :]).ravel()
                first = self.offsets[block][value]
                n = self.offsets[block][value + 1] - first
                full = np.flatnonzero(n)
                first, n = first[full].astype(np.int64), n[full].astype(np.int64)
                q = np.repeat(full // len(self.near), n)
                e = self.lists[block][np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)].astype(np.int64)
                close = np.bitwise_count(some[q] ^ self.prints[e]) <= self.radius
                pairs.append((q[close] + begin) * len(self.prints) + e[close])
        found = np.unique(np.concatenate(pairs))
        return found // max(1, len(self.prints)), found % max(1, len(self.prints))


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Shared over all shingles, each as often as it occurs."""
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


@dataclass
class Items:
    """What tasks need to know of some benchmark items."""

    texts: list[str]
    shingle_words: int
    radius: int
    least: float
    #: distinct numbers of words of the items, ascending; a size is a place in this list
    sizes: list[int] = field(default_factory=list)
    #: items with words, and the size of each, in the order of both indexes
    entries: list[int] = field(default_factory=list)
    size_of: np.ndarray | None = None
    indexes: list[HammingIndex] = field(default_factory=list)
    known: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]] = field(default_factory=dict)
    counts: dict[int, Counter] = field(default_factory=dict)
    longest: int = 0

    def build(self) -> Items:
        lengths = {i: len(w) for i, w in enumerate(map(_words, self.texts)) if w}
        self.sizes = sorted({*lengths.values()})
        self.entries = list(lengths)
        place = {m: at for at, m in enumerate(self.sizes)}
        self.size_of = np.array([place[m] for m in lengths.values()], np.int64)
        prints: tuple[list, list] = ([], [])
        owners: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for i, m in lengths.items():
            k = min(self.shingle_words, m)
            hashes = shingle_hashes(word_hashes(np.frombuffer(b" ".join(_words(self.texts[i])), np.uint8))[0], k)
            for out, make in zip(prints, (window_prints, distinct_prints)):
                out.append(make(hashes, np.array([0]), len(hashes))[0])
            for h in np.unique(hashes).tolist():
                owners[k][h].add(place[m])
        self.indexes = [HammingIndex(np.array(out, np.uint64), self.radius) for out in prints]
        for k, sizes in owners.items():
            keys = np.array(sorted(sizes), np.uint64)
            table = np.zeros(1 << 22, bool)
            table[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.known[k] = (keys, table, [tuple(sorted(sizes[int(h)])) for h in keys])
        self.longest = max(self.sizes, default=0)
        return self

    def count(self, item: int) -> Counter:
        """Shingles of an item and how often it has them; made when a window comes near it."""
        if item not in self.counts:
            words = _words(self.texts[item])
            k = min(self.shingle_words, len(words))
            self.counts[item] = Counter(tuple(words[j : j + k]) for j in range(len(words) - k + 1))
        return self.counts[item]

    def hits(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of some words; places of those that items have, and which."""
        keys, table, _ = self.known[k]
        shingles = shingle_hashes(words, k)
        at = np.flatnonzero(table[(shingles & np.uint64((1 << 22) - 1)).astype(np.int64)])
        which = np.searchsorted(keys, shingles[at])
        real = keys[np.minimum(which, len(keys) - 1)] == shingles[at]
        return shingles, at[real], which[real]

    def leaks(self, words: np.ndarray, raw: list[bytes], found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], offset: int, best: dict) -> None:
        """Enter the best window of every item in ``best``: ``item -> (similarity, -start)``."""
        for k, (shingles, at, which) in found.items():
            hits: dict[int, list[int]] = defaultdict(list)
            for place, key in zip(at.tolist(), which.tolist()):
                for size in self.known[k][2][key]:
                    hits[size].append(place)
            for size, places in hits.items():
                whole = self.sizes[size] - k + 1  # shingles of the item
                n = min(whole, len(shingles))  # and of a window: a text shorter than the item is one window
                # a window with fewer shingles of items of this size can't be similar enough to any of them
                least = max(1, ceil(self.least * (whole + n) / (1 + self.least) - 1e-9))
                if len(places) < least:
                    continue
                hit = np.array(places)
                low, high = hit[: len(hit) - least + 1], hit[least - 1 :]
                near = high - low < n
                ranges = [np.arange(max(0, h - n + 1), min(a, len(shingles) - n) + 1) for a, h in zip(low[near].tolist(), high[near].tolist())]
                if not ranges:
                    continue
                begin = np.unique(np.concatenate(ranges))
                pairs = set()
                for index, make in zip(self.indexes, (window_prints, distinct_prints)):
                    query, entry = index.search(make(shingles, begin, n))
                    own = self.size_of[entry] == size
                    pairs.update(zip(query[own].tolist(), entry[own].tolist()))
                for q, e in sorted(pairs):
                    item, j = self.entries[e], int(begin[q])
                    if best.get(item, (0.0, 0))[0] == 1.0:
                        continue  # an earlier window is the item itself
                    window = Counter(tuple(raw[i : i + k]) for i in range(j, j + n))
                    similarity = weighted_similarity(window, self.count(item))
                    if similarity >= self.least:
                        best[item] = max(best.get(item, (0.0, 0)), (similarity, -(j + offset)))

    def scan(self, texts: list[str]) -> Iterator[tuple[int, dict]]:
        """The texts that hold items, with the best window of each."""
        group, size = [], 0
        for n, text in enumerate(texts if self.sizes else ()):
            if size + len(text) > PART and group:
                yield from self._scan_group(texts, group)
                group, size = [], 0
            if len(text) > PART:
                best: dict = {}
                for part, words, offset in _parts(text.lower().encode("utf-8", "surrogatepass"), self.longest):
                    found = {k: h for k in self.known if len((h := self.hits(words, k))[1])}
                    if found:
                        self.leaks(words, part.split(), found, offset, best)
                if best:
                    yield n, best
            else:
                group.append(n)
                size += len(text)
        if group:
            yield from self._scan_group(texts, group)

    def _scan_group(self, texts: list[str], group: list[int]) -> Iterator[tuple[int, dict]]:
        lowered = [texts[n].lower().encode("utf-8", "surrogatepass") for n in group]
        words, starts, _ = word_hashes(np.frombuffer(b"\n".join(lowered), np.uint8))
        limits = np.cumsum([0, *[len(t) + 1 for t in lowered]])
        # words of each text; shingles over the border of two texts only cost a second look
        first = np.searchsorted(starts, limits)
        suspects = set()
        for k in self.known:
            at = self.hits(words, k)[1]
            suspects.update((np.searchsorted(first, at, side="right") - 1).tolist())
        for t in sorted(suspects):
            own = words[first[t] : first[t + 1]]
            found = {k: h for k in self.known if len((h := self.hits(own, k))[1])}
            best: dict = {}
            if found:
                self.leaks(own, lowered[t].split(), found, 0, best)
            if best:
                yield group[t], best


def _parts(data: bytes, overlap: int) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """A long text in parts that share ``overlap`` words: bytes, word hashes, number of words before."""
    begin, end, before = 0, PART, 0
    while True:
        while end < len(data) and not _GAP[data[end]]:
            end += 1
        words, starts, _ = word_hashes(np.frombuffer(data[begin:end], np.uint8))
        if end >= len(data):
            yield data[begin:end], words, before
            return
        if len(words) > overlap:
            yield data[begin:end], words, before
            before += len(words) - overlap
            begin += int(starts[len(words) - overlap])
            end = max(end, begin + PART)
        else:
            end += PART


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle_words: int = 5,
    similarity: float = 0.8,
    radius: int = 19,
    items_per_pass: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``_id _mark _item similarity start_word``: which documents hold which benchmark items.

    For every item of m words, all windows of m words of a document are its candidates; a document with fewer words is
    one window. A window and the item are compared if their SimHash fingerprints differ in ``radius`` bits or fewer, which a
    multi-index of blocks answers without loss; the pair counts if the exact weighted similarity of their
    shingles (each as often as it occurs) is ``similarity`` or more. Two fingerprints are made of a window, one with each occurrence of a
    shingle of ``shingle_words`` words weighing one and one with each distinct shingle weighing one, and either may be
    near: the first is far off where a window repeats what the item has not, the second where
    an item repeats itself. At 0.8 the nearer one differs in about 10 of 64 bits on average, so a radius of
    19 keeps about 999 of 1,000 pairs right at the threshold. A window can be similar only if enough of its shingles
    are shingles of items of that size; others, nearly all of a clean text, get no fingerprint. One row is
    returned per document and item, with the best window, the first of equal ones.

    Items travel with the tasks, ``items_per_pass`` of them at a time; more items mean more passes.
    Letters are lower-cased, words end at ASCII white space. An item of fewer words than a shingle is one
    shingle. Items without words match nothing; equal items are each reported. A missing
    or empty text has no windows. Rows with the same id and text may give a row each. Texts of more than a megabyte are
    read in parts that overlap by the longest item. Other columns are left out, whatever their names.
    """
    plain = keyed(docs, id_col, text_col)
    items, passes = _passes(benchmark, items_per_pass, item_id_col, item_text_col)
    schema = T.StructType([*plain.schema.fields[:2], items.schema["_item"], T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType())])
    item_type = to_arrow_type(items.schema["_item"].dataType)
    found = None
    for rows in passes:
        texts, ids = [r["_text"] for r in rows], [r["_item"] for r in rows]

        def run(batches: Iterator[pa.RecordBatch], texts=texts, ids=ids) -> Iterator[pa.RecordBatch]:
            known, names = Items(texts, shingle_words, radius, similarity).build(), pa.array(ids, item_type)
            for batch in batches:
                doc, item, close, start = [], [], [], []
                for n, best in known.scan(batch.column(2).to_pylist()):
                    for i, (s, at) in sorted(best.items()):
                        doc.append(n)
                        item.append(i)
                        close.append(s)
                        start.append(-at)
                if doc:
                    at = pa.array(doc, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), names.take(pa.array(item, pa.int64())), pa.array(close), pa.array(start, pa.int64())],
                        names=["_id", "_mark", "_item", "similarity", "start_word"],
                    )

        one = plain.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found


def _passes(benchmark: DataFrame, items_per_pass: int, id_col: str, text_col: str) -> tuple[DataFrame, Iterator[list]]:
    """The items as ``_item _text``, and their rows in groups of about ``items_per_pass``."""
    require_columns(benchmark, [id_col, text_col])
    items = benchmark.select(col(id_col).alias("_item"), whole_text(text_col).alias("_text"))
    n = max(1, -(-items.count() // items_per_pass))
    parts = (items if n == 1 else items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(n)) == k) for k in range(n))
    return items, (sorted(p.collect(), key=lambda r: (r["_item"] is None, r["_item"])) for p in parts)


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle_words: int = 5,
    similarity: float = 0.8,
    radius: int = 19,
    items_per_pass: int = 20_000,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which :func:`find_leaks` finds no item, all columns kept; the filter runs where the rows are."""
    require_columns(docs, [text_col])
    at, schema = docs.columns.index(text_col), docs.schema
    for rows in _passes(benchmark, items_per_pass, item_id_col, item_text_col)[1]:
        texts = [r["_text"] for r in rows]

        def run(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            known = Items(texts, shingle_words, radius, similarity).build()
            for batch in batches:
                clean = [True] * len(batch)
                for n, _ in known.scan([t.as_py() or "" for t in batch.column(at)]):
                    clean[n] = False
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
