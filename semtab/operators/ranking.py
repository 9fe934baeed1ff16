"""Semantic top-k: the best rows by pairwise answers to a question.

Distinct documents are compared, copies share the outcome. Large segments are
split around a pivot in rounds, every round being one Spark job over all open
segments of all groups at once; segments below a bound are finished by one task
each. Segments that start beyond the k-th place are dropped as soon as they are
known.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.functions.claims import choice_of, distinct_holes, fill_claim, row_text
from semtab.models.answering import call_in_batches, first_wins, slots, with_replies
from semtab.models.base import AnswerModel, ConfidenceCascade, Embedder
from semtab.models.prompts import PromptSpec
from semtab.operators.retrieval import embed
from semtab.operators.vectors import dot_column
from semtab.runtime import col, dtype_of, is_numeric, missing, pick, require_columns, stage

METHODS = ("quick", "heap", "naive", "quick-sem")
LOCAL_ROWS = 512  # documents that one task may order by itself
SAMPLE = 24  # documents among which a pivot is chosen


def two_documents(first: str, second: str) -> str:
    return f"\nDocument 1:\n{first}\nDocument 2:\n{second}"


def refuse_numeric(df: DataFrame, names: Sequence[str]) -> None:
    for n in names:
        if is_numeric(dtype_of(df, n)):
            raise ValueError(f"column {n!r} is numeric; semantic operators need text")


class _Judge:
    """Comparisons inside a task, with the number of calls and tokens they took."""

    def __init__(self, model: AnswerModel, spec: PromptSpec) -> None:
        self.model, self.spec, self.calls, self.tokens = model, spec, 0, 0

    def better(self, pairs: list[tuple[str, str]]) -> list[bool]:
        replies = call_in_batches(self.model, self.spec, [two_documents(a, b) for a, b in pairs])
        self.calls += len(replies)
        self.tokens += sum(r.prompt_tokens for r in replies)
        return [first_wins(r.text) for r in replies]


def _select(docs: list[str], k: int, judge: _Judge) -> list[str]:
    """The best ``k`` of a bounded list in order, each split being one batch of calls."""
    if len(docs) <= 1 or k <= 0:
        return docs[:k]
    pivot = docs[len(docs) // 2]
    others = [d for d in docs if d is not pivot]
    wins = judge.better([(d, pivot) for d in others])
    ahead = [d for d, w in zip(others, wins) if w]
    top = _select(ahead, k, judge)
    if len(ahead) >= k:
        return top
    behind = [d for d, w in zip(others, wins) if not w]
    return [*top, pivot, *_select(behind, k - len(ahead) - 1, judge)]


def _heap_select(docs: list[str], k: int, judge: _Judge) -> list[str]:
    """The best ``k`` by a heap, one comparison at a time."""
    order = functools.cmp_to_key(lambda a, b: -1 if judge.better([(a, b)])[0] else 1)
    return heapq.nsmallest(k, docs, key=order)


def _finish(
    docs: DataFrame, by: list[str], k: int, model: AnswerModel, spec: PromptSpec, select: Callable
) -> DataFrame:
    """Order each bounded segment in one task; keeps its best rows and their place ``_rank``."""
    fields = {f.name: f for f in docs.schema.fields}
    extra = [T.StructField("_rank", T.LongType()), T.StructField("_calls", T.LongType()),
             T.StructField("_tokens", T.LongType())]
    schema = T.StructType([*[fields[b] for b in by], fields["_doc"], fields["_m"], *extra])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        judge = _Judge(model, spec)
        start = int(pdf["_seg"].iloc[0])
        texts = sorted(pdf["_doc"])
        best = select(texts, min(len(texts), k - start), judge)
        counts = dict(zip(pdf["_doc"], pdf["_m"]))
        out = pd.DataFrame({"_doc": best})
        for b in by:
            out[b] = pdf[b].iloc[0]
        out["_m"] = [counts[d] for d in best]
        out["_rank"] = start + out["_m"].cumsum() - out["_m"]
        out["_calls"], out["_tokens"] = 0, 0
        out.loc[out.index[:1], ["_calls", "_tokens"]] = [judge.calls, judge.tokens]
        return out[schema.fieldNames()]

    # an explicit width: merging small partitions would put all calls into one task
    return docs.repartition(slots(docs.sparkSession), *by).groupBy(*by).applyInPandas(run, schema)


def _choose_pivots(sized: DataFrame, by: list[str], k: int, turn: int, model: AnswerModel, spec: PromptSpec) -> DataFrame:
    """One pivot per open segment, taken from about ``SAMPLE`` of its documents ranked by one task.

    A pivot just behind the wanted share of the segment leaves few documents for the
    next round, so that the total stays near one call per document.
    """
    fields = {f.name: f for f in sized.schema.fields}
    more = [T.StructField("_pivot", T.StringType()), T.StructField("_pm", T.LongType()),
            T.StructField("_calls", T.LongType()), T.StructField("_tokens", T.LongType())]
    schema = T.StructType([*[fields[b] for b in by], *more])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        judge = _Judge(model, spec)
        wanted = (k - pdf["_seg"].iloc[0]) / pdf["_size"].iloc[0]
        texts = sorted(pdf["_doc"])
        at = min(len(texts), int(len(texts) * min(wanted, 0.5)) + 2)
        pivot = _select(texts, at, judge)[-1]
        out = pdf[pdf["_doc"] == pivot].iloc[:1]
        return out.assign(_pivot=pivot, _pm=out["_m"], _calls=judge.calls, _tokens=judge.tokens)[schema.fieldNames()]

    draw = F.xxhash64("_doc", F.lit(turn))
    drawn = sized.where(F.pmod(draw, F.ceil(F.col("_size") / SAMPLE)) == 0)
    ranked = drawn.repartition(slots(sized.sparkSession), *by).groupBy(*by).applyInPandas(run, schema)
    # a segment without any drawn document falls back to the one with the least hash
    spare = sized.groupBy(*by).agg(F.min_by(F.struct("_doc", "_m"), draw).alias("_s"))
    return spare.join(ranked, by, "left").select(
        *by, F.coalesce("_pivot", "_s._doc").alias("_pivot"), F.coalesce("_pm", "_s._m").alias("_pm"),
        F.coalesce("_calls", F.lit(0)).alias("_calls"), F.coalesce("_tokens", F.lit(0)).alias("_tokens"))


def _quick(
    docs: DataFrame, g: list[str], k: int, model: AnswerModel, spec: PromptSpec, local_rows: int,
    first_pivot: DataFrame | None,
) -> list[DataFrame]:
    by = [*g, "_seg"]
    state = stage(docs.withColumn("_seg", F.lit(0).cast("long")), "segments")
    finished: list[DataFrame] = []
    for turn in range(1000):
        sizes = state.groupBy(*by).agg(F.count("*").alias("_size"))
        counted = sizes.agg(F.count_if(F.col("_size") > local_rows), F.count_if(F.col("_size") <= local_rows)).first()
        if not counted[0]:
            return [*finished, _finish(state, by, k, model, spec, _select)]
        sized = state.join(sizes, by)
        if counted[1]:
            small = sized.where(F.col("_size") <= local_rows).drop("_size")
            finished.append(_finish(small, by, k, model, spec, _select))
        big = sized.where(F.col("_size") > local_rows)
        if turn == 0 and first_pivot is not None:
            known = docs.select(F.col("_doc").alias("_pivot"), F.col("_m").alias("_pm"))
            zero = F.lit(0).cast("long")
            pivots = first_pivot.join(known, "_pivot").withColumns({"_calls": zero, "_tokens": zero})
        else:
            pivots = _choose_pivots(big, by, k, turn, model, spec)
        # one row per open segment; the optimizer broadcasts them while they are few
        pivots = stage(pivots, "pivots")
        faced = big.join(pivots.drop("_calls", "_tokens"), by).where("_doc != _pivot")
        asked = with_replies(
            faced, F.concat(F.lit("\nDocument 1:\n"), "_doc", F.lit("\nDocument 2:\n"), "_pivot"), model, spec)
        judged = stage(
            asked.select(*by, "_doc", "_m", (choice_of(F.col("_reply.text")) == 1).alias("_ahead"),
                         F.col("_reply.prompt_tokens").alias("_t")),
            "judged",
        )
        wins = judged.groupBy(*by).agg(
            F.coalesce(F.sum(F.when(F.col("_ahead"), F.col("_m"))), F.lit(0)).alias("_wins"),
            F.count("*").alias("_c"), F.sum("_t").alias("_t"),
        )
        placed = pivots.join(wins, by)
        finished.append(placed.select(
            *by, F.col("_pivot").alias("_doc"), F.col("_pm").alias("_m"), (F.col("_seg") + F.col("_wins")).alias("_rank"),
            (F.col("_calls") + F.col("_c")).alias("_calls"), (F.col("_tokens") + F.col("_t")).alias("_tokens")))
        moved = judged.drop("_t").join(placed.select(*by, "_wins", "_pm"), by).withColumn(
            "_seg", F.when(F.col("_ahead"), F.col("_seg")).otherwise(F.col("_seg") + F.col("_wins") + F.col("_pm")))
        state = moved.where(F.col("_seg") < k).select(*g, "_doc", "_m", "_seg")
    raise RuntimeError("the comparisons do not settle")


def _with_size(docs: DataFrame, g: list[str]) -> DataFrame:
    """Add the number of documents in the row's group."""
    if not g:
        return docs.withColumn("_n", F.lit(docs.count()))
    return docs.join(docs.groupBy(*g).agg(F.count("*").alias("_n")), g)


def _heap(
    docs: DataFrame, g: list[str], k: int, model: AnswerModel, spec: PromptSpec, local_rows: int
) -> list[DataFrame]:
    """Rounds of small heaps: every bucket passes on its best ``k`` until one bucket per group is left."""
    bucket_rows = max(local_rows, 4 * k)
    rounds: list[DataFrame] = []
    state = docs
    while True:
        state = stage(state.withColumn("_seg", F.lit(0).cast("long")), "heap")
        sized = _with_size(state, g)
        largest = sized.agg(F.max("_n")).first()[0] or 0
        if largest <= bucket_rows:
            return [*rounds, _finish(state, [*g, "_seg"], k, model, spec, _heap_select)]
        bucket = F.pmod(F.xxhash64("_doc"), F.ceil(F.col("_n") / bucket_rows)).alias("_bucket")
        spread = sized.select(*g, "_doc", "_m", "_seg", bucket)
        part = stage(_finish(spread, [*g, "_bucket"], k, model, spec, _heap_select), "heap")
        rounds.append(part.select(*g, F.col("_rank").alias("_seg"), F.lit(None).cast("string").alias("_doc"), "_m",
                                  F.lit(None).cast("long").alias("_rank"), "_calls", "_tokens"))
        state = part.select(*g, "_doc", "_m")


def _naive(
    docs: DataFrame, g: list[str], k: int, model: AnswerModel, spec: PromptSpec, local_rows: int
) -> list[DataFrame]:
    """Every pair asked once, a vote for the winner; tiles of bounded size return votes, never pairs."""
    docs = stage(docs, "naive")
    sized = _with_size(docs, g)
    chunks = F.ceil(F.col("_n") / local_rows)
    cut = stage(sized.select(*g, "_doc", "_m", chunks.alias("_nc"),
                             F.pmod(F.xxhash64("_doc"), chunks).alias("_c")), "naive")
    steps = F.sequence(F.lit(0).cast("long"), F.col("_nc") - 1)
    left = cut.select(*g, "_doc", "_m", F.col("_c").alias("_a"), F.explode(steps).alias("_b")).where("_b >= _a")
    right = cut.select(*g, "_doc", "_m", F.col("_c").alias("_b"), F.explode(steps).alias("_a")).where("_b >= _a")
    by = [*g, "_a", "_b"]
    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*[fields[n] for n in g], fields["_doc"],
                           *[T.StructField(n, T.LongType()) for n in ("_votes", "_calls", "_tokens")]])

    def run(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return pd.DataFrame({n: [] for n in schema.fieldNames()})
        judge = _Judge(model, spec)
        same = lp["_a"].iloc[0] == lp["_b"].iloc[0]
        weight = {**dict(zip(lp["_doc"], lp["_m"])), **dict(zip(rp["_doc"], rp["_m"]))}
        votes = dict.fromkeys(weight, 0)
        for a in lp["_doc"]:
            pairs = [(min(a, b), max(a, b)) for b in rp["_doc"] if (a < b if same else True)]
            for (x, y), first in zip(pairs, judge.better(pairs)):
                winner, loser = (x, y) if first else (y, x)
                votes[winner] += weight[loser]
        out = pd.DataFrame({"_doc": list(votes), "_votes": list(votes.values())})
        for n in g:
            out[n] = lp[n].iloc[0]
        out["_calls"], out["_tokens"] = 0, 0
        out.loc[out.index[:1], ["_calls", "_tokens"]] = [judge.calls, judge.tokens]
        return out[schema.fieldNames()]

    n = slots(docs.sparkSession)
    left, right = left.repartition(n, *by), right.repartition(n, *by)
    votes = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, schema)
    total = votes.groupBy(*g, "_doc").agg(*[F.sum(c).alias(c) for c in ("_votes", "_calls", "_tokens")])
    total = stage(total, "votes")
    w = Window.partitionBy(*g).orderBy(F.desc("_votes"), "_doc")
    ranked = total.withColumn("_rank", F.row_number().over(w).cast("long")).where(F.col("_rank") <= k)
    seg, one = F.lit(0).cast("long").alias("_seg"), F.lit(1).cast("long").alias("_m")
    calls = total.agg(F.sum("_calls").alias("_calls"), F.sum("_tokens").alias("_tokens"))
    empty = [F.lit(None).cast(fields[n].dataType).alias(n) for n in g]
    return [
        ranked.select(*g, seg, "_doc", one, "_rank", F.lit(0).cast("long").alias("_calls"),
                      F.lit(0).cast("long").alias("_tokens")),
        calls.select(*empty, seg, F.lit(None).cast("string").alias("_doc"), one,
                     F.lit(None).cast("long").alias("_rank"), "_calls", "_tokens"),
    ]


def sem_topk(
    df: DataFrame,
    question: str,
    k: int,
    model: AnswerModel,
    *,
    key: str | Sequence[str] = (),
    method: str = "quick",
    group_by: str | Sequence[str] | None = None,
    strategy: str | None = None,
    cascade: tuple[AnswerModel, float] | None = None,
    embedder: Embedder | None = None,
    rank: str | None = None,
    stats: bool = False,
    local_rows: int = LOCAL_ROWS,
):
    """The ``k`` rows that answer the question best, best first; per group with ``group_by``.

    Copies of a document are ordered by ``key``. ``cascade=(small, threshold)`` asks
    the small model first and ``model`` where it is less sure. ``rank`` names a
    column for the place, from 1. ``stats`` returns ``(rows, {calls, tokens})``.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    names = distinct_holes(question)
    require_columns(df, names)
    refuse_numeric(df, names)
    groups = [group_by] if isinstance(group_by, str) else list(group_by or [])
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(df, [*groups, *keys])
    if cascade is not None:
        model = ConfidenceCascade(cascade[0], model, cascade[1])
    spec = PromptSpec("compare", fill_claim(question), strategy)

    kept = df
    for c in groups:
        kept = kept.where(~missing(df, c))
    g = [f"_g{i}" for i in range(len(groups))]
    doc = row_text(df, names)
    docs = (
        kept.select(*[col(c).alias(a) for c, a in zip(groups, g)], doc.alias("_doc"))
        .groupBy(*g, "_doc").agg(F.count("*").alias("_m"))
    )
    if method == "naive":
        outcome = _naive(docs, g, k, model, spec, local_rows)
    elif method == "heap":
        outcome = _heap(docs, g, k, model, spec, local_rows)
    else:
        first = None
        if method == "quick-sem":
            first = _similar_pivot(docs, kept, names, groups, question, k, embedder)
        outcome = _quick(docs, g, k, model, spec, local_rows, first)
    ranked = functools.reduce(DataFrame.unionByName, outcome)
    if stats or len(outcome) > 1:
        ranked = stage(ranked, "ranked")

    places = ranked.where(F.col("_rank").isNotNull()).select(*g, "_doc", "_rank")
    # every document has at least one row: k documents per group are enough
    if g:
        w = Window.partitionBy(*g).orderBy("_rank", "_doc")
        places = places.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    else:
        places = places.orderBy("_rank", "_doc").limit(k)
    side = places.select(*[F.col(a).alias(f"_p{a}") for a in g], F.col("_doc").alias("_pdoc"), "_rank")
    on = doc == F.col("_pdoc")
    for c, a in zip(groups, g):
        on = on & (pick(df, c) == F.col(f"_p{a}"))
    rows = kept.join(side, on)
    tie = [col(c).asc_nulls_last() for c in keys]
    name = rank or "_place"
    columns = [pick(df, c) for c in df.columns]
    if groups:
        w = Window.partitionBy(*[pick(df, c) for c in groups]).orderBy("_rank", "_pdoc", *tie)
        out = rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    else:
        top = rows.orderBy("_rank", "_pdoc", *tie).limit(k)
        out = top.withColumn(name, F.row_number().over(Window.orderBy("_rank", "_pdoc", *tie)))
    out = out.select(*columns, name) if rank else out.select(*columns)
    if not stats:
        return out
    row = ranked.agg(F.sum("_calls"), F.sum("_tokens")).first()
    return out, {"total_llm_calls": row[0] or 0, "total_tokens": row[1] or 0}


def _similar_pivot(docs, kept, names, groups, question, k, embedder) -> DataFrame:
    """The k-th document by similarity to the question, as the pivot of the first round."""
    if len(names) != 1 or groups or embedder is None:
        raise ValueError("quick-sem takes one text column, an embedder and no group_by")
    texts = kept.select(col(names[0]).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    q = embedder.embed([question])[0]
    scored = embed(texts, "_text", embedder, "_vec").withColumn("_s", dot_column(F.col("_vec"), q))
    label = f"[{names[0].capitalize()}]: «"
    top = scored.orderBy(F.desc("_s"), "_text").limit(k)
    return top.agg(F.max_by("_text", F.struct(-F.col("_s"), "_text")).alias("_t")).select(
        F.lit(0).cast("long").alias("_seg"), F.concat(F.lit(label), "_t", F.lit("»\n")).alias("_pivot"))
