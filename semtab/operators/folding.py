"""Semantic aggregation: many rows folded into one text per group.

With a wanted order rows are range-partitioned by group and order; without one, groups
of many prompts are dealt into slices by a hash of their rows, as many as their tokens need, so a group of
any size is spread over tasks and its prompts are the same in every run. Each task packs neighbours
into prompts up to the token budget and asks the model while it reads. Further levels
fold the answers, which are written out between levels. Groups with one answer leave after each level.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.functions.claims import distinct_holes, fill_claim, row_text
from semtab.models.answering import call_in_batches, slots
from semtab.models.base import AnswerModel, count_tokens
from semtab.models.prompts import PromptSpec
from semtab.runtime import col, missing, require_columns, stage, tasks_for

MAX_TASKS = 50_000
#: Prompts that a slice of a large group fills, about.
SLICE_PROMPTS = 8


def _same_keys(df: DataFrame, keys: list[str]):
    """Join condition with a table that holds the keys as ``_j0 _j1 …``; missing keys are keys too."""
    on = [df[k].eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)]
    return functools.reduce(lambda a, b: a & b, on)


def _sliced(docs: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Rows with their ``_slice``: 0, but for groups of more tokens than a slice, which are dealt by hash."""
    width = SLICE_PROMPTS * budget
    tokens = docs.groupBy(*keys).agg(F.sum(F.ceil(F.length("_doc") / 4) + 5).alias("_t"))
    large = tokens.where(F.col("_t") > width).select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], F.ceil(F.col("_t") / width).alias("_n"))
    large = stage(large, "large")
    n = large.count()
    if n == 0:
        return docs.withColumn("_slice", F.lit(0).cast("long"))
    joined = docs.join(F.broadcast(large) if n <= 100_000 else large, _same_keys(docs, keys), "left")
    return joined.withColumn("_slice", F.pmod("_first", F.coalesce("_n", F.lit(1)).cast("long"))).select(*docs.columns, "_slice")


def _level(docs: DataFrame, keys: list[str], order: list[str], model: AnswerModel, spec: PromptSpec,
           tasks: int, budget: int, ordered: bool) -> DataFrame:
    """One level: neighbours of a group packed up to ``budget`` tokens, one answer per pack."""
    if keys and not ordered:
        docs, keys = _sliced(docs.drop("_slice"), keys, budget), [*keys, "_slice"]
    leaf = spec.task == "fold"
    tag = "Document" if leaf else "Source"
    measure = getattr(model, "count_tokens", count_tokens)
    names = [f.name for f in docs.schema.fields if f.name not in ("_doc", "_asked")]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != "_asked"],
                           T.StructField("_asked", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packs: list[tuple[tuple, list[str]]] = []
        head: tuple | None = None
        group: tuple | None = None
        held: list[str] = []
        used = 0

        def close():
            nonlocal held, used
            if held:
                packs.append((head, held))
            held, used = [], 0

        def answered() -> pd.DataFrame:
            # one source alone is already its own summary; a leaf is always asked
            ask = [i for i, (_, d) in enumerate(packs) if leaf or len(d) > 1]
            texts = ["".join(f"\n\t{tag} {n}: {d}" for n, d in enumerate(packs[i][1], 1)) for i in ask]
            replies = dict(zip(ask, call_in_batches(model, spec, texts)))
            rows = [
                (*h, replies[i].text if i in replies else d[0], int(i in replies))
                for i, (h, d) in enumerate(packs)
            ]
            packs.clear()
            return pd.DataFrame(rows, columns=[*names, "_doc", "_asked"])[schema.fieldNames()]

        for pdf in batches:
            ids = list(pdf[keys].itertuples(index=False, name=None)) if keys else [()] * len(pdf)
            rest = pdf[names].itertuples(index=False, name=None) if names else [()] * len(pdf)
            for here, whole, doc in zip(ids, rest, pdf["_doc"]):
                size = measure(f"\n\t{tag} {len(held) + 1}: {doc}")
                if held and (here != group or used + size > budget):
                    close()
                    if len(packs) >= model.batch_size:
                        yield answered()
                if not held:
                    head, group = whole, here
                held.append(doc)
                used += size
        close()
        if packs:
            yield answered()

    by = [*keys, *order]
    if not by:
        ranged = docs.coalesce(tasks)  # rows are read where and as they lie
    elif not ordered and keys:
        ranged = docs.repartition(tasks, *keys).sortWithinPartitions(*by)
    elif tasks > 1:
        ranged = docs.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    else:
        ranged = docs.coalesce(1).sortWithinPartitions(*by)
    return stage(ranged.mapInPandas(run, schema), "fold")


def _fold(docs: DataFrame, keys: list[str], order: list[str], model: AnswerModel, instruction: str,
          tasks: int, rows_per_task: int, budget: int, first: str, asked: list[DataFrame], levels: list[dict], ordered: bool) -> DataFrame:
    """Levels until every group has one row; those that have leave the table at once."""
    task, before = first, None
    finished: list[DataFrame] = []
    while True:
        spec = PromptSpec(task, instruction)
        room = budget - sum(count_tokens(m["content"]) for m in spec.messages(""))
        docs = _level(docs, keys, order, model, spec, tasks, max(room, 1), ordered)
        asked.append(docs.select("_asked"))
        rows = docs.count()
        open_groups = 0
        if keys:
            several = docs.groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)])
            several = stage(several, "open")
            open_groups = several.count()
        levels.append({"task": task, "tasks": tasks, "rows": rows, "open_groups": open_groups if keys else int(rows > 1)})
        if open_groups == 0 if keys else rows <= 1:
            break
        if keys:
            few = F.broadcast(several) if open_groups <= 100_000 else several
            finished.append(docs.join(few, _same_keys(docs, keys), "left_anti"))
            docs = docs.join(few, _same_keys(docs, keys), "left_semi")
            rows = docs.count()
        if before is not None and rows >= before and tasks == 1:
            raise ValueError("answers are too long to fold: no two fit into one prompt; raise the budget")
        # tasks by what is left to read; halved at least, so that a fold comes to an end
        tasks = min(tasks_for(rows, min(rows_per_task, SLICE_PROMPTS * model.batch_size)), max(1, tasks // 2))
        before, task, order = rows, "fold_again", order or ["_first"]
    for part in finished:
        docs = docs.unionByName(part)
    return docs


def sem_agg(
    df: DataFrame,
    instruction: str,
    model: AnswerModel,
    *,
    out: str = "_output",
    all_cols: bool = False,
    group_by: str | Sequence[str] | None = None,
    partition_by: str | None = None,
    order_by: str | Sequence[str] | None = None,
    budget: int | None = None,
    rows_per_task: int = 4096,
    stats: bool = False,
):
    """Answer an instruction over all rows as one text, or as one per group.

    The named columns make up a row's text, all columns when the instruction names
    none. Rows of one ``partition_by`` value share no first-level prompt with
    others; once each partition has its summary, these are folded. Rows are read
    in ``order_by`` order, otherwise as they lie or, in groups, by a hash. ``stats`` returns ``(rows, {"total_llm_calls", "levels"})``,
    a level with its tasks, its answers and the groups still open.
    """
    names = distinct_holes(instruction)
    if all_cols or not names:
        names = list(df.columns)
    groups = [group_by] if isinstance(group_by, str) else list(group_by or [])
    ordering = [order_by] if isinstance(order_by, str) else list(order_by or [])
    require_columns(df, [*names, *groups, *ordering, *([partition_by] if partition_by else [])])
    kept = df
    for c in groups:
        kept = kept.where(~missing(df, c))
    g = [f"_g{i}" for i in range(len(groups))]
    o = [f"_o{i}" for i in range(len(ordering))]
    part = [col(partition_by).alias("_p")] if partition_by else []
    text = row_text(df, names)
    docs = kept.select(
        *[col(c).alias(a) for c, a in zip(groups, g)], *part,
        *[col(c).alias(a) for c, a in zip(ordering, o)], F.xxhash64(text).alias("_first"), text.alias("_doc"),
    )
    budget = budget or model.context_tokens - model.reply_tokens
    size = docs.agg(F.count("*").alias("n"), F.sum(F.length("_doc")).alias("c")).first()
    prompts = tasks_for((size["c"] or 0) // 4, budget)
    # all cores while each has some prompts, then one batch of prompts per task
    by_prompts = max(min(slots(df.sparkSession), tasks_for(prompts, 4)), tasks_for(prompts, model.batch_size))
    tasks = min(max(tasks_for(size["n"], rows_per_task), by_prompts), MAX_TASKS)
    asked: list[DataFrame] = []
    claim = fill_claim(instruction)
    # without a wanted order a fixed hash spreads the rows of a group; one single group needs no move at all
    order = o or (["_first"] if g or part else [])
    levels: list[dict] = []
    folded = _fold(docs, [*g, "_p"] if part else g, order, model, claim, tasks, rows_per_task, budget, "fold", asked, levels, bool(o))
    if part:
        rows = folded.count()
        groups_left = folded.select(*g).distinct().count() if g else min(rows, 1)
        if rows > groups_left:
            folded = _fold(folded, g, ["_p"], model, claim, tasks_for(rows, rows_per_task), rows_per_task, budget,
                           "fold_again", asked, levels, True)
    result = folded.select(*[F.col(a).alias(c) for c, a in zip(groups, g)], F.col("_doc").alias(out))
    if not stats:
        return result
    return result, {"total_llm_calls": sum(a.agg(F.sum("_asked")).first()[0] or 0 for a in asked), "levels": levels}


def sem_partition_by(df: DataFrame, partition, out: str = "_partition_id") -> DataFrame:
    """Mark rows with a partition id: any Column, or a function from the table to one."""
    return df.withColumn(out, (partition(df) if callable(partition) else partition).cast("int"))

