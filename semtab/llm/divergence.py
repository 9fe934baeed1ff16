"""How far the sources of a language lie apart: stripes of term counts folded inside the mappers, divergences from merged stripes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semtab.llm.common import portions, whole_text
from semtab.runtime import require_columns, stage

#: Stripe entries that a mapper folds before it hands them on, and stripes in one batch it hands on.
FOLDED, STRIPES = 400_000, 20_000
#: Bytes of one text that are cut into terms at once.
PART = 4 << 20
#: Source pairs that are worked out at once.
PAIRS = 1_000_000
#: Letters keep their place, A to Z in lower case, and all else parts terms.
_TERMS = bytes((c | 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: The entry that only says that a group occurs; no term is empty.
GROUP = ""


def count_terms(text: bytes) -> Counter:
    """Terms of a text and how often they occur: runs of characters that are ASCII letters, in lower case, or not ASCII."""
    counts: Counter = Counter()
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + PART)
        end = gap.end() if gap else len(text)
        counts.update(text[start:end].translate(_TERMS).split())
        start = end
    return counts


def _handed_on(stripes: dict) -> Iterator[pa.RecordBatch]:
    rows = [(lang, term, df, counts) for lang, terms in stripes.items() for term, (df, counts) in terms.items()]
    stripes.clear()
    for k in range(0, len(rows), STRIPES):
        langs, terms, dfs, counts = zip(*rows[k : k + STRIPES])
        ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
        source = pa.array([s for c in counts for s in c], pa.string())
        n = pa.array([x for c in counts for x in c.values()], pa.int64())
        entry = pa.StructArray.from_arrays([source, n], names=["source", "n"])
        terms = pa.array(terms, pa.binary()).cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array(ends), entry)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), terms, pa.array(dfs, pa.int64()), lists], names=["lang", "term", "df", "counts"])


def fold_stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang term df counts``: each partition's documents folded into stripes, a term's document frequency and its counts by source.

    A mapper hands its stripes on and begins anew when they hold ``FOLDED`` entries, so a term may have
    several stripes of one partition. The stripe of the empty term lists all sources that occur, with 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[str, dict[bytes, list]] = {}
        entries = 0
        for batch in portions(batches, 0):
            for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                terms = stripes.setdefault(lang, {})
                for term, n in [(GROUP.encode(), 0), *count_terms(text.as_buffer().to_pybytes()).items()]:
                    stripe = terms.get(term)
                    if stripe is None:
                        terms[term] = [1, {source: n}]
                        entries += 1
                    else:
                        stripe[0] += 1
                        counts = stripe[1]
                        if source in counts:
                            counts[source] += n
                        else:
                            counts[source] = n
                            entries += 1
                if entries >= FOLDED:
                    entries = 0
                    yield from _handed_on(stripes)
        yield from _handed_on(stripes)

    plain = docs.select(whole_text(text_col).alias("_text"), whole_text(lang_col).alias("_lang"), whole_text(source_col).alias("_source"))
    return plain.mapInArrow(run, "lang string, term string, df bigint, counts array<struct<source: string, n: bigint>>")


def merge_stripes(stripes: DataFrame, least_docs: int) -> DataFrame:
    """One stripe per language and term, for terms in ``least_docs`` documents of the language, and the one of the empty term.

    Stripes move once, by language and term. Their entries are added up by source before a list is
    made, so a list holds a source once, however many stripes a frequent term has.
    """
    dealt = stripes.repartition("lang", "term")
    entries = dealt.select("lang", "term", "df", F.posexplode("counts").alias("_k", "_entry")).select(
        "lang", "term", F.col("_entry.source").alias("source"), F.col("_entry.n").alias("n"), F.when(F.col("_k") == 0, F.col("df")).otherwise(0).alias("df")
    )
    by_source = entries.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    merged = by_source.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return merged.where((F.col("df") >= least_docs) | (F.col("term") == GROUP))


def _p(n, total, terms):
    """``1 + floor(10**9 * (n + 1) / (total + terms))`` for arrays, by a long division in two steps: exact for totals below 9 * 10**13."""
    below = total + terms
    high = (n + 1) * 100_000
    q = high // below
    return 1 + q * 10_000 + (high - q * below) * 10_000 // below


def _f(p, q):
    return (p - q) * (p - q) // q


def _p_sql(n: str, total: str, terms: str) -> str:
    """The same in SQL; a language without terms gives every group the same share."""
    below, high = f"greatest({total} + {terms}, 1L)", f"(({n} + 1L) * 100000L)"
    return f"(1L + ({high} div {below}) * 10000L + (({high} % {below}) * 10000L) div {below})"


def _f_sql(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


class _Best:
    """The ``top`` terms of each group among those seen: a term outside them here is outside them everywhere."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def add(self, rows: list[tuple]) -> None:
        self.rows += rows

    def cut(self) -> None:
        self.rows.sort()
        kept, group, n = [], None, 0
        for row in self.rows:
            group, n = (group, n + 1) if row[:2] == group else (row[:2], 1)
            if n <= self.top:
                kept.append(row)
        self.rows = kept

    def handed_on(self) -> pa.RecordBatch:
        self.cut()
        lang, source, value, item = zip(*self.rows) if self.rows else ((), (), (), ())
        self.rows = []
        return _divergences("term", pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.binary()).cast(pa.string()), -np.array(value, np.int64))


def _divergences(part: str, lang: pa.Array, source: pa.Array, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(value), pa.string()), lang, source, item, pa.array(value, pa.int64())], names=["part", "lang", "source", "item", "value"]
    )


def _of_stripes(batch: pa.RecordBatch, groups: dict | None, best: _Best) -> Iterator[pa.RecordBatch]:
    """What some merged stripes add to the divergence of each pair of sources in them, and their terms' own divergences.

    The pair ``(g, o)`` gets ``f(g, o)`` less what the term adds where only one of the two has it, for the sums
    over all terms start from those (see :func:`source_divergence`). So a stripe's work grows with its own sources only.
    """
    lang, term, counts = batch.column(0).dictionary_encode(), batch.column(1), batch.column(2)
    lens = pc.list_value_length(counts).to_numpy(zero_copy_only=False).astype(np.int64)
    entry = counts.flatten()
    source = entry.field("source").dictionary_encode()
    n = entry.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
    lang_of, source_of = lang.indices.to_numpy(), source.indices.to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(lens)), lens)
    group_of = lang_of[rows] * len(sources) + source_of
    if groups is None:
        total = entry.field("total").to_numpy(zero_copy_only=False)
        terms, lang_total = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
    else:
        codes, place = np.unique(group_of, return_inverse=True)
        total = np.array([groups[langs[c // len(sources)], sources[c % len(sources)]] for c in codes.tolist()], np.int64)[place]
        whole = np.array([groups[name] for name in langs], np.int64)
        terms, lang_total = whole[lang_of, 0], whole[lang_of, 1]
    starts = np.cumsum(lens) - lens
    p, p0 = _p(n, total, terms[rows]), _p(np.zeros_like(n), total, terms[rows])
    q = _p(np.add.reduceat(n, starts), lang_total, terms)[rows]

    over = np.flatnonzero(p > q)
    texts = pc.cast(term, pa.binary()).to_pylist()
    best.add([(langs[lang_of[r]], sources[s], v, texts[r]) for r, s, v in zip(rows[over].tolist(), source_of[over].tolist(), (-_f(p, q)[over]).tolist())])

    partners = lens[rows]
    done = np.cumsum(partners)
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + PAIRS, "right")))
        k = partners[first:last]
        i = np.repeat(np.arange(first, last), k)
        j = starts[rows[i]] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        i, j = i[i != j], j[i != j]
        first = last
        if not len(i):
            continue
        added = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])
        pair = group_of[i] * len(sources) + source_of[j]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        group, other = np.divmod(pair[heads], len(sources))
        at = np.divmod(group, len(sources))
        yield _divergences(
            "pair", lang.dictionary.take(pa.array(at[0])), source.dictionary.take(pa.array(at[1])), source.dictionary.take(pa.array(other)), np.add.reduceat(added[order], heads)
        )


def source_divergence(
    docs: DataFrame,
    least_docs: int = 3,
    top: int = 200,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    broadcast_groups: int = 100_000,
) -> DataFrame:
    """How the words of the sources of a language differ: ``lang source part item value rank``.

    A language keeps the terms (runs of ASCII letters in lower case, and of other characters beyond ASCII) in at least
    ``least_docs`` of its documents. With ``N`` occurrences of ``V`` kept terms, a group gives a term the share
    ``p = 1 + floor(10**9 * (count + 1) / (N + V))``, and ``f = floor((p - q)**2 / q)``. Part ``pair`` holds
    each group against each other source of its language, ``f`` summed over all kept terms; part ``term`` each group against its whole language,
    the ``top`` terms it uses more. Ranks count from 1 per group and part, by value descending and item.

    Mappers fold whole documents into stripes (:func:`fold_stripes`), which are merged by term. All sums are exact whole
    numbers. For a pair, terms that neither source has add the same ``f00`` each; a term of one source only
    depends on its count there, so a histogram of counts per source gives those sums; and merged stripes give what
    terms of both add beyond. So a term costs the square of its own sources, and no pair of sources is made
    for terms that don't have both. The table of groups goes to every task while it has ``broadcast_groups`` rows at most; beyond
    that totals are joined to the stripes by shuffle, with the same result.

    A missing text, language or source is an empty one; an empty one is a value like others. Groups without terms
    are compared too; a language without kept terms has values of 0, one with a single source has no pairs.
    Repeated rows and rows without id count as documents of their own. Very long texts are cut at gaps, 4 MB at a time. Other
    columns are not looked at, whatever their names.
    """
    require_columns(docs, [text_col, lang_col, source_col])
    stripes = stage(merge_stripes(fold_stripes(docs, text_col, lang_col, source_col), least_docs), "stripes")
    kept = stripes.where(F.col("term") != GROUP)
    entries = kept.select("lang", "term", F.explode("counts").alias("_e")).select("lang", "term", "_e.source", "_e.n")
    histogram = stage(entries.groupBy("lang", "source", "n").agg(F.count("*").alias("m")), "counts")
    occurring = stripes.where(F.col("term") == GROUP).select("lang", F.explode("counts.source").alias("source"))
    totals = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    whole = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    groups = occurring.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").join(whole, "lang", "left")
    groups = stage(groups.na.fill(0, ["total", "terms", "lang_total"]), "groups")
    small = groups.count() <= broadcast_groups
    sent = F.broadcast if small else (lambda df: df)

    known: dict | None = None
    if small:
        known = {}
        for r in groups.collect():
            known[r.lang, r.source] = r.total
            known[r.lang] = (r.terms, r.lang_total)
        given = kept.select("lang", "term", "counts")
    else:
        with_total = entries.join(groups, ["lang", "source"])
        given = with_total.groupBy("lang", "term").agg(
            F.collect_list(F.struct("source", "n", "total")).alias("counts"), F.first("terms").alias("terms"), F.first("lang_total").alias("lang_total")
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(top)
        for batch in batches:
            if batch.num_rows:
                yield from _of_stripes(batch, known, best)
            if len(best.rows) > 500_000:
                best.cut()
                if len(best.rows) > 250_000:
                    yield best.handed_on()
        yield best.handed_on()

    emitted = stage(given.mapInArrow(run, "part string, lang string, source string, item string, value bigint"), "divergences")

    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("other_total"))
    pairs = groups.join(sent(other), "lang").where(F.col("source") != F.col("item"))
    zero, other_zero = _p_sql("0L", "total", "terms"), _p_sql("0L", "other_total", "terms")
    base = pairs.select("lang", "source", "item", F.expr(f"terms * {_f_sql(zero, other_zero)}").alias("value"))
    alone = histogram.join(sent(groups), ["lang", "source"]).join(sent(other), "lang").where(F.col("source") != F.col("item"))
    alone = alone.select("*", F.expr(_p_sql("n", "total", "terms")).alias("p"), F.expr(zero).alias("p0"), F.expr(other_zero).alias("q0"))
    one_sided = F.array(
        F.struct("source", "item", F.expr(f"m * ({_f_sql('p', 'q0')} - {_f_sql('p0', 'q0')})").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"m * ({_f_sql('q0', 'p')} - {_f_sql('q0', 'p0')})").alias("value")),
    )
    alone = alone.select("lang", F.explode(one_sided).alias("_s")).select("lang", "_s.source", "_s.item", "_s.value")
    both = emitted.where(F.col("part") == "pair").select("lang", "source", "item", "value")
    summed = base.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    of_terms = emitted.where(F.col("part") == "term").select("lang", "source", "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).alias("rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked_pairs = summed.select("*", F.lit("pair").alias("part"), rank).select(columns)
    ranked_terms = of_terms.select("*", F.lit("term").alias("part"), rank).where(F.col("rank") <= top).select(columns)
    return ranked_pairs.unionByName(ranked_terms)
