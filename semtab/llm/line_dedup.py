"""Removal of repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtab.llm.common import GAP_CHARACTERS, WORD, fresh, keyed, mark_of
from semtab.runtime import col, split_join, stage


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: two hashes, word count and place of each line that has a word."""
    base = keyed(docs, id_col, text_col)
    cut = F.transform(
        F.split("_text", "\n", -1),
        lambda line, at: F.struct(at.alias("at"), F.btrim(line, F.lit(GAP_CHARACTERS)).alias("line")),
    )
    base = base.select("_id", "_mark", F.filter(cut, lambda x: x["line"] != "").alias("_cut"))
    hashed = F.transform(
        "_cut",
        lambda x: F.struct(
            F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b"), F.regexp_count(x["line"], F.lit(WORD)).alias("words"), x["at"].alias("at")
        ),
    )
    made = base.select("_id", "_mark", hashed.alias("_x"))
    return made.select("_id", "_mark", *[F.col(f"_x.{k}").alias(f"_{k}") for k in ("a", "b", "words", "at")])


def _starts(i: Column, n: Column, width: int) -> Column:
    """First lines of the windows of ``width`` lines that hold line ``i`` of ``n``."""
    low, high = F.greatest(i - (width - 1), F.lit(0)), F.least(i, n - width)
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _is_least(start: Column, i: Column, width: int) -> Column:
    """True where line ``i`` has the least hash of the window, the last one of equal ones."""
    window = F.slice("_a", start + 1, width)
    least = F.element_at("_a", i + 1)
    return (F.array_min(window) == least) & (F.lit(width) - F.array_position(F.reverse(window), least).cast("int") == i - start)


def repeated_lines(
    docs: DataFrame,
    min_lines: int = 2,
    long_words: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``_id _mark _removed``: for each document that repeats earlier lines, their sorted places (from 0).

    A run of ``min_lines`` or more lines that occurs earlier, in a document with a smaller
    id or further up in the same one, is removed wherever it occurs again; so is a single line
    of ``long_words`` words. Lines are compared without white space around them; lines
    without a word are no lines of a run.

    Winnowing: in each window of ``min_lines`` line hashes the least one is an anchor, so two
    equal runs hold the same anchor at the same place. Anchors are joined by their hash; those
    that occur once end there, and with them most lines. Around each anchor that recurs the
    match is extended both ways by the runs of ``min_lines`` lines that contain it: each goes to the
    first place where that run occurs, and overlapping ones form the longest match. A line
    repeated in a third of all documents is one row per task in the aggregates, and its
    occurrences are joined without a move; no pairs of occurrences are made.

    Rows with the same id and text are one document. Documents without an id come last, ordered by
    a hash of their text. A missing or empty text has no lines.
    """
    lines = stage(_lines(docs, id_col, text_col), "lines").where(F.size("_a") > 0)
    n = F.size("_a")
    every = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            i.alias("i"),
            F.element_at("_a", i + 1).alias("hash"),
            (F.element_at("_words", i + 1) >= long_words).alias("long"),
            F.exists(_starts(i, n, min_lines), lambda s: _is_least(s, i, min_lines)).alias("least"),
        ),
    )
    anchors = lines.select("*", F.explode(F.filter(every, lambda x: x["long"] | x["least"])).alias("_anchor"))
    i = F.col("_anchor.i")
    run = lambda s: F.struct(
        s.alias("s"), F.lit(min_lines).alias("n"), F.xxhash64(F.slice("_a", s + 1, min_lines)).alias("k1"), F.xxhash64(F.slice("_b", s + 1, min_lines)).alias("k2")
    )
    alone = F.struct(i.alias("s"), F.lit(1).alias("n"), F.element_at("_a", i + 1).alias("k1"), F.element_at("_b", i + 1).alias("k2"))
    runs = F.when(F.col("_anchor.least"), F.transform(_starts(i, n, min_lines), run)).otherwise(F.array().cast("array<struct<s:int,n:int,k1:bigint,k2:bigint>>"))
    single = F.when(F.col("_anchor.long"), F.array(alone)).otherwise(F.array().cast("array<struct<s:int,n:int,k1:bigint,k2:bigint>>"))
    place = F.transform(F.concat(runs, single), lambda r: F.struct(F.element_at("_at", r["s"] + 1).alias("from"), F.slice("_at", r["s"] + 1, r["n"]).alias("lines"), r["n"].alias("n"), r["k1"].alias("k1"), r["k2"].alias("k2")))
    anchors = stage(anchors.select("_id", "_mark", F.col("_anchor.hash").alias("_hash"), place.alias("_runs")), "line-anchors")
    recurring = anchors.groupBy("_hash").agg(F.count("*").alias("_times")).where("_times > 1").select("_hash")
    live = split_join(anchors, stage(recurring, "line-recurring"), "_hash")
    found = live.select("_id", "_mark", F.explode("_runs").alias("_r")).select(
        "_id", "_mark", F.xxhash64("_r.n", "_r.k1", "_r.k2").alias("_run"), F.col("_r.k2").alias("_check"), F.col("_r.from").alias("_from"), F.col("_r.lines").alias("_places")
    )
    found = stage(found, "line-runs")
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_mark").alias("mark"), F.col("_from").alias("at"))
    firsts = found.groupBy("_run", "_check").agg(F.min(order).alias("_first"), F.count("*").alias("_times")).where("_times > 1").drop("_times")
    # one row per run; a second run with the same 64 bits keeps its own first place
    firsts = firsts.groupBy("_run").agg(F.collect_list(F.struct("_check", "_first")).alias("_firsts"))
    later = split_join(found, stage(firsts, "line-firsts"), "_run")
    first = F.get(F.filter("_firsts", lambda f: f["_check"] == F.col("_check")), F.lit(0))["_first"]
    later = later.where(first.isNotNull() & (order != first)).select("_id", "_mark", F.explode("_places").alias("_at"))
    return later.groupBy("_id", "_mark").agg(F.sort_array(F.collect_set("_at")).alias("_removed"))


def dedup_lines(
    docs: DataFrame,
    min_lines: int = 2,
    long_words: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    removed_col: str | None = None,
) -> DataFrame:
    """All rows and columns of ``docs``, the text without the lines that :func:`repeated_lines` names.

    Texts without such lines stay as they are, missing ones included; a text of which nothing is left
    is empty. ``removed_col`` adds the places of the removed lines. Columns of ``docs`` may have any names: those used
    inside give way. Very long texts are split and put together by column expressions, one row at a time.
    """
    gone = stage(repeated_lines(docs, min_lines, long_words, id_col, text_col), "lines-removed")
    gone_id, gone_mark, gone_lines = (fresh(n, docs.columns) for n in ("_gone_id", "_gone_mark", "_gone_lines"))
    gone = gone.withColumnsRenamed({"_id": gone_id, "_mark": gone_mark, "_removed": gone_lines})
    ident = docs["`" + id_col.replace("`", "``") + "`"]
    # never broadcast: the list grows with the documents
    joined = docs.join(gone.hint("shuffle_hash"), ident.eqNullSafe(F.col(gone_id)) & (mark_of(docs, text_col) == F.col(gone_mark)), "left")
    # the list is bound once per row: lambdas would split the text again for each line
    cut = F.split(col(text_col), "\n", -1)
    rest = F.transform(
        F.array(F.struct(cut.alias("lines"))),
        lambda x: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), F.col(gone_lines)), lambda k: F.get(x["lines"], k)), "\n"
        ),
    )
    text = F.when(F.col(gone_lines).isNull(), col(text_col)).otherwise(F.get(rest, F.lit(0)))
    out = [text.alias(c) if c == text_col else col(c) for c in docs.columns]
    if removed_col:
        out.append(F.coalesce(gone_lines, F.array().cast("array<int>")).alias(removed_col))
    return joined.select(*out)
