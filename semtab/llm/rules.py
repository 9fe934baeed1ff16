"""Quality rules as a short-circuit cascade, cheapest rejection first."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtab.llm.common import GAP, WORD, whole_text
from semtab.runtime import col, require_columns, stage

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A named condition that rejects a document; it may use the columns of :func:`with_features`."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    """Rules on symbols, repeated lines, word lengths, shouting, variety and letters."""
    n, words = F.col("n_words"), F.col("_words")
    part = lambda test: F.size(F.filter(words, test))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("repeated_lines", F.col("n_dup_lines") * 100 > F.col("_n_lines") * 40),
        Rule("word_length", (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 15)),
        Rule("shouting", part(lambda w: (F.upper(w) == w) & (F.lower(w) != w)) * 3 > n),
        Rule("variety", F.size(F.array_distinct(words)) * 5 < n),
        Rule("letters", part(lambda w: w.rlike(r"\p{L}")) * 10 < n * 6),
    ]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` and its lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Number of words inside windows of ``width`` words that occur twice or more.

    Windows are compared by hashes of 64 bits. Texts without a repeated window, most of them, are told by a count of
    distinct hashes. In others one sort of hashes with their places brings equal windows together: n log n whatever
    repeats. Of four million windows, two unequal ones share a hash once in two million such texts.
    """

    def windows(w: Column) -> Column:
        n = F.greatest(F.size(w) - (width - 1), F.lit(0))
        out = F.slice(w, F.lit(1), n)
        for k in range(1, width):
            out = F.zip_with(out, F.slice(w, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))
        return out

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, at: F.struct(h.alias("h"), at.cast("long").alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(placed, spots), words_at))

    def spots(s: Column) -> Column:
        m = F.size(s) - 1
        met = F.zip_with(F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(met, lambda p: p.isNotNull()))))

    def words_at(at: Column) -> Column:
        # each window holds up to ``width`` words before the next begins
        ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.element_at(at, -1) + width))
        reach = F.zip_with(at, ends, lambda p, q: F.least(F.lit(width).cast("long"), q - p))
        return F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x))

    return let(let(words, windows), covered)


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` with counts of words, their characters, symbols, repeated lines and repeated words of every whole text."""
    text = whole_text(text_col)
    cut = docs.select(
        col(id_col).alias("_id"),
        text.alias("_text"),
        F.filter(F.split(text, GAP, -1), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("_lines"),
    )
    return cut.select(
        "_id",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("_words")).alias("n_repeat_words"),
    )


def base_fails(min_words: int = 50, most_repeated: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)


def order_rules(features: DataFrame, rules: list[Rule], runs: int = 2) -> list[tuple[Rule, float, float]]:
    """Rules with their cost in seconds and the share they reject, those first that reject most per second.

    ``features`` is a small stored sample. A rule's cost is what it adds to reading the sample,
    the best of some runs. Which documents pass does not depend on the order.
    """

    def timed(condition: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(runs):
            began = time.perf_counter()
            share = features.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("double"))).first()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, share

    floor = timed(F.size("_words") < 0)[0]
    found = [(r, *timed(r.rejects)) for r in rules]
    found = [(r, max(cost - floor, 1e-3), share) for r, cost, share in found]
    return sorted(found, key=lambda x: -x[2] / x[1])


def judge(
    docs: DataFrame,
    rules: list[Rule] | None = None,
    sample_docs: int = 1_000,
    min_words: int = 50,
    most_repeated: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id``, the counts of :func:`with_features`, ``base_failed`` and ``kept`` for every row.

    Documents that fail the base (too few words, too many repeated) are rejected; others pass a
    cascade of rules in which the first that rejects ends the work on a document. Costs and rejections of the rules are
    measured on about ``sample_docs`` documents that pass the base, chosen by a hash of id and
    text. A rule whose condition is missing for a document does not reject it.

    A missing text is an empty one: no words, hence failed. Repeated rows each give a row.
    """
    require_columns(docs, [id_col, text_col])
    rules = default_rules() if rules is None else rules
    grain = 1 << 30
    share = min(grain, grain * sample_docs // max(docs.count(), 1) + 1)
    some = docs.where(F.pmod(F.xxhash64(col(id_col), col(text_col)), F.lit(grain)) < share)
    failed = base_fails(min_words, most_repeated)
    sample = stage(with_features(some, id_col, text_col), "rule-sample").where(~failed)
    verdict = F.when(F.col("base_failed"), False)
    for rule, _, _ in order_rules(sample, rules):
        verdict = verdict.when(rule.rejects, False)
    out = with_features(docs, id_col, text_col).withColumn("base_failed", failed)
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.otherwise(True).alias("kept")
    )
