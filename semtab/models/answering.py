"""The stage where model calls happen: one Arrow-fed column of replies.

Only the row text travels to Python; all other columns stay in the JVM. The
column is marked non-deterministic so that Spark neither repeats nor moves the
calls. Use :func:`semtab.runtime.stage` before reading replies twice.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from semtab.models.base import AnswerModel, Embedder, PairScorer, Reply
from semtab.models.prompts import PromptSpec
from semtab.runtime import col

_CHANCE = T.StructType([T.StructField("token", T.StringType()), T.StructField("logprob", T.DoubleType())])

REPLY = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("cached", T.BooleanType()),
        T.StructField(
            "logprobs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("token", T.StringType()),
                        T.StructField("logprob", T.DoubleType()),
                        T.StructField("top", T.ArrayType(_CHANCE)),
                    ]
                )
            ),
        ),
    ]
)


def _plain(reply: Reply) -> tuple:
    chances = None
    if reply.logprobs is not None:
        chances = [
            {"token": t.token, "logprob": t.logprob, "top": [{"token": a, "logprob": b} for a, b in t.top]}
            for t in reply.logprobs
        ]
    return (reply.text, reply.prompt_tokens, reply.completion_tokens, reply.cost, False, chances)


def call_in_batches(model: AnswerModel, spec: PromptSpec, contexts: list[str], logprobs: bool = False) -> list[Reply]:
    """Answer a list of row texts, ``model.batch_size`` at a time; used inside tasks."""
    replies: list[Reply] = []
    for at in range(0, len(contexts), model.batch_size):
        part = contexts[at : at + model.batch_size]
        got = model.answer(spec, part, logprobs)
        if len(got) != len(part):
            raise ValueError(f"model {model.name} gave {len(got)} replies to {len(part)} prompts")
        replies += got
    return replies


def says_true(spec: PromptSpec, text: str, on_error: str = "raise", default: bool = True) -> bool:
    """The verdict in a reply; for tasks that judge pairs they do not hand on."""
    answer = text.partition("Answer:")[2] if spec.reasons and "Answer:" in text else text
    if "True" in answer:
        return True
    if "False" in answer:
        return False
    if on_error == "raise":
        raise ValueError(f"cannot read True or False in reply: {text}")
    return default


def why(spec: PromptSpec, text: str) -> str | None:
    """The reasoning in a reply, when the prompt asked for it."""
    if not spec.reasons or "Answer:" not in text:
        return None
    head = text.partition("Answer:")[0]
    return head.partition("Reasoning:\n")[2].strip("\n") if "Reasoning:\n" in head else head.strip("\n")


# Fixed value: how a comparison reply names the document it picks.
_NAMED = re.compile(r"Document[\s*](\d+)", re.I)


def first_wins(text: str) -> bool:
    """Whether a comparison reply picks document 1."""
    found = _NAMED.findall(text) or re.findall(r"\d+", text)
    if not found or int(found[-1]) not in (1, 2):
        raise ValueError(f"cannot read a document number in reply: {text}")
    return int(found[-1]) == 1


def slots(spark: SparkSession) -> int:
    """Tasks to spread model calls over: all cores, or the shuffle width where it was raised for large data.

    Where executors come and go with the work (dynamic allocation) the cores of the moment say little, so the shuffle width counts.
    """
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cores = spark.sparkContext.defaultParallelism
    elastic = spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true"
    return max(cores, width) if width > 200 or elastic else cores


def spread(df: DataFrame, parallel: int | None = None) -> DataFrame:
    """Rows dealt out over ``parallel`` tasks, all cores by default; 0 leaves them where they are."""
    return df if parallel == 0 else df.repartition(parallel or slots(df.sparkSession))


def reply_column(context: Column, model: AnswerModel, spec: PromptSpec, logprobs: bool = False) -> Column:
    """A reply struct for every row text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            replies = call_in_batches(model, spec, texts.tolist(), logprobs)
            yield pd.DataFrame([_plain(r) for r in replies], columns=REPLY.fieldNames())

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, REPLY).asNondeterministic()(context)


def with_replies(
    df: DataFrame,
    context: Column,
    model: AnswerModel,
    spec: PromptSpec,
    *,
    out: str = "_reply",
    logprobs: bool = False,
    parallel: int | None = None,
    memo: str | None = None,
) -> DataFrame:
    """Add a reply struct column.

    Rows are spread over all task slots, since calls cost far more than the move and
    a short list of distinct inputs would otherwise end up in one task; ``parallel``
    bounds how many tasks call the model at a time. ``parallel=0`` saves that move where
    the inputs are large enough to fill all tasks anyway. ``memo`` names a
    Parquet folder of earlier replies: known prompts are looked up, new ones are
    answered once, appended, and found again after a lost executor.
    """
    if memo is not None:
        return _with_memo(df, context, model, spec, out, logprobs, parallel, memo)
    df = spread(df, parallel)
    return df.withColumn(out, reply_column(context, model, spec, logprobs))


_MEMO = T.StructType(
    [T.StructField("_prompt", T.StringType()), T.StructField("_known", REPLY), T.StructField("_run", T.StringType())]
)


def _read_memo(df: DataFrame, memo: str) -> DataFrame:
    try:
        return df.sparkSession.read.schema(_MEMO).parquet(memo)
    except AnalysisException as e:  # the folder appears with the first append
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return df.sparkSession.createDataFrame([], _MEMO)


def _with_memo(df, context, model, spec, out, logprobs, parallel, memo) -> DataFrame:
    run = uuid.uuid4().hex
    settings = f"{model.name}|{spec.fingerprint()}|{logprobs}"
    keyed = df.withColumn("_context", context).withColumn(
        "_prompt", F.sha2(F.concat(F.lit(settings), F.col("_context")), 256)
    )
    wanted = keyed.select("_prompt", "_context").dropDuplicates(["_prompt"])
    fresh = wanted.join(_read_memo(df, memo).select("_prompt"), "_prompt", "left_anti")
    fresh = spread(fresh, parallel)
    answered = fresh.withColumn("_known", reply_column(F.col("_context"), model, spec, logprobs))
    answered.select("_prompt", "_known", F.lit(run).alias("_run")).write.mode("append").parquet(memo)
    # two jobs may have answered the same prompt: keep the reply of one of them
    known = (
        _read_memo(df, memo)
        .join(wanted.select("_prompt"), "_prompt", "left_semi")
        .groupBy("_prompt")
        .agg(F.min_by(F.struct("_known", "_run"), "_run").alias("_m"))
        .select("_prompt", F.col("_m._known").withField("cached", F.col("_m._run") != run).alias(out))
    )
    return keyed.join(known, "_prompt").drop("_prompt", "_context")


def usage(replies: DataFrame, reply: str = "_reply", by: list[str] | None = None) -> DataFrame:
    """Calls, tokens and cost of staged replies, summed (per step when ``by`` is given).

    Sums come from columns rather than accumulators, so a repeated task is not
    counted twice. Replies found in a memo count as hits and cost nothing.
    """
    paid = ~F.col(f"{reply}.cached")

    def total(field: str):
        return F.coalesce(F.sum(F.when(paid, F.col(f"{reply}.{field}"))), F.lit(0))

    return replies.groupBy(*[col(c) for c in by or []]).agg(
        F.count_if(paid).alias("calls"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        (total("prompt_tokens") + total("completion_tokens")).alias("total_tokens"),
        total("cost").cast("double").alias("total_cost"),
        F.count_if(F.col(f"{reply}.cached")).alias("cache_hits"),
    )


def vector_column(text: Column, embedder: Embedder) -> Column:
    """A float vector for every text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.tolist()
            rows: list = []
            for at in range(0, len(values), embedder.batch_size):
                rows += list(embedder.embed(values[at : at + embedder.batch_size]))
            yield pd.Series(rows, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.FloatType())).asNondeterministic()(text)


def pair_score_column(text: Column, query: str, scorer: PairScorer) -> Column:
    """How well each text answers ``query`` by a pair scorer."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([float(v) for v in scorer.score(query, texts.tolist())], dtype=float)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.DoubleType()).asNondeterministic()(text)
