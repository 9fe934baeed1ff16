"""Per-row semantic steps: filter, map, extract, and their evaluation of distinct inputs.

Every step asks the model once per distinct input: the referenced columns are
projected, rows with a missing value dropped, repeats removed by an aggregate that
combines before the shuffle, and the answers joined back by a hash of the inputs.

Answers are written out when the operator is called: however often its result is
read, or recomputed after a lost executor, nothing is asked again, and the true size
of the answers decides how they are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.functions.claims import (
    answer_of, bool_of, distinct_holes, explanation_of, fill_claim, list_of_bools, row_text,
)
from semtab.models.answering import call_in_batches, spread, usage, with_replies
from semtab.models.base import AnswerModel
from semtab.models.prompts import PromptSpec, shots_from
from semtab.runtime import col, key_hash, missing, pick, require_columns, same_key, stage


KEY = ["_h1", "_h2"]


def distinct_inputs(df: DataFrame, names: Sequence[str], keep_missing: bool = False) -> DataFrame:
    """Distinct values of the named columns: their hashes ``_h1 _h2`` and their row text ``_context``."""
    if not names:
        raise ValueError("the instruction names no {column}")
    names = list(names)
    require_columns(df, names)
    keys = df.select(*[col(n) for n in names])
    if not keep_missing:
        for n in names:
            keys = keys.where(~missing(df, n))
    keys = keys.distinct()
    return keys.select(*key_hash(keys, names), row_text(keys, names).alias("_context"))


def _read_answer(spec: PromptSpec, reply: Column) -> tuple[Column, Column]:
    """Answer text and explanation of a reply, following the prompt's strategy."""
    text = reply.getField("text")
    if spec.reasons:
        return answer_of(text), explanation_of(text)
    return text, F.lit(None).cast("string")


def judge_inputs(
    df: DataFrame,
    claim: str,
    model: AnswerModel,
    *,
    examples=None,
    strategy: str | None = None,
    on_error: str = "raise",
    default: bool = True,
    parallel: int | None = None,
    memo: str | None = None,
) -> tuple[DataFrame, list[str], PromptSpec]:
    """Distinct inputs of a claim with ``_reply``, ``_verdict`` and ``_why``."""
    names = distinct_holes(claim)
    spec = PromptSpec("judge", fill_claim(claim), strategy, shots_from(examples, names, strategy))
    asked = with_replies(
        distinct_inputs(df, names), F.col("_context"), model, spec, parallel=parallel, memo=memo
    )
    answer, why = _read_answer(spec, F.col("_reply"))
    return asked.withColumn("_verdict", bool_of(answer, on_error, default)).withColumn("_why", why), names, spec


def sem_filter(
    df: DataFrame,
    claim: str,
    model: AnswerModel,
    *,
    examples=None,
    strategy: str | None = None,
    on_error: str = "raise",
    default: bool = True,
    explain: bool = False,
    raw: bool = False,
    suffix: str = "_filter",
    stats: bool = False,
    parallel: int | None = None,
    memo: str | None = None,
):
    """Rows whose claim the model holds true; rows with a missing input never qualify.

    ``explain`` and ``raw`` add ``explanation{suffix}`` and ``raw_output{suffix}``;
    worked examples with ``strategy="cot"`` imply ``explain``. ``stats`` returns
    ``(rows, usage)``.
    """
    judged, names, spec = judge_inputs(
        df, claim, model, examples=examples, strategy=strategy, on_error=on_error, default=default,
        parallel=parallel, memo=memo,
    )
    judged = stage(judged.drop("_context"), "sem_filter")
    explain = explain or (strategy == "cot" and examples is not None)
    out = keep_accepted(df, judged.where(F.col("_verdict")), names, explain, raw, suffix)
    return (out, usage(judged)) if stats else out


def keep_accepted(
    df: DataFrame, accepted: DataFrame, names: Sequence[str], explain: bool, raw: bool, suffix: str
) -> DataFrame:
    extra = []
    if explain:
        extra.append(F.col("_why").alias(f"explanation{suffix}"))
    if raw:
        extra.append(F.col("_reply.text").alias(f"raw_output{suffix}"))
    if not extra:
        return df.join(accepted.select(*KEY), same_key(df, list(names)), "left_semi")
    answered = accepted.select(*KEY, *extra)
    return df.join(answered, same_key(df, list(names))).drop(*KEY)


def sem_filter_batch(
    df: DataFrame,
    claim: str,
    model: AnswerModel,
    *,
    rows_per_prompt: int = 2,
    on_error: str = "raise",
    default: bool = True,
    examples=None,
    parallel: int | None = None,
) -> DataFrame:
    """As :func:`sem_filter`, with several contexts in one prompt and a list as reply.

    Prompts are formed from neighbours inside a partition, so grouping rows into
    prompts moves no data.
    """
    if rows_per_prompt < 1:
        raise ValueError("rows_per_prompt is 1 or more")
    names = distinct_holes(claim)
    inputs = spread(distinct_inputs(df, names), parallel)
    spec = PromptSpec("judge_list", fill_claim(claim), shots=shots_from(examples, names, None))
    keys = [f for f in inputs.schema.fields if f.name != "_context"]
    schema = T.StructType([*keys, T.StructField("_at", T.IntegerType()), T.StructField("_size", T.IntegerType()),
                           T.StructField("_text", T.StringType())])
    key_names = [f.name for f in keys]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            texts = pdf["_context"].tolist()
            groups = [texts[i : i + rows_per_prompt] for i in range(0, len(texts), rows_per_prompt)]
            prompts = ["".join(f"[Context {i}] {t}" for i, t in enumerate(g, 1)) for g in groups]
            replies = call_in_batches(model, spec, prompts)
            out = pdf[key_names].copy()
            out["_at"] = [i for g in groups for i in range(1, len(g) + 1)]
            out["_size"] = [len(g) for g in groups for _ in g]
            out["_text"] = [r.text for r, g in zip(replies, groups) for _ in g]
            yield out

    asked = inputs.mapInPandas(ask, schema)
    verdicts = list_of_bools(F.col("_text"), F.col("_size"), on_error, default)
    accepted = stage(asked.where(F.element_at(verdicts, F.col("_at"))).select(*KEY), "sem_filter")
    return df.join(accepted, same_key(df, names), "left_semi")


def sem_map(
    df: DataFrame,
    instruction: str,
    model: AnswerModel,
    *,
    out: str = "_map",
    examples=None,
    strategy: str | None = None,
    keep_nulls: bool = False,
    explain: bool = False,
    raw: bool = False,
    postprocess: Callable[[Column], Column] | None = None,
    stats: bool = False,
    parallel: int | None = None,
    memo: str | None = None,
):
    """Add a text column answered from each row.

    Rows with a missing input are dropped, or kept with a NULL answer when
    ``keep_nulls`` is set. A column named like ``out`` makes both copies take
    ``_x`` and ``_y``. ``postprocess`` maps the reply text column to the answer.
    """
    names = distinct_holes(instruction)
    spec = PromptSpec("map", fill_claim(instruction), strategy, shots_from(examples, names, strategy))
    asked = with_replies(
        distinct_inputs(df, names), F.col("_context"), model, spec, parallel=parallel, memo=memo
    )
    asked = stage(asked.drop("_context"), "sem_map")
    answer, why = _read_answer(spec, F.col("_reply"))
    if postprocess is not None:
        answer = postprocess(F.col("_reply.text"))
    extra = {out: answer}
    if explain or (strategy == "cot" and examples is not None):
        extra[f"explanation{out}"] = why
    if raw:
        extra[f"raw_output{out}"] = F.col("_reply.text")
    answered = asked.select(*KEY, *[c.alias(f"_a{i}") for i, c in enumerate(extra.values())])
    joined = df.join(answered, same_key(df, names), "left" if keep_nulls else "inner")
    columns = [pick(df, c).alias(f"{c}_x" if c in extra else c) for c in df.columns]
    columns += [
        F.col(f"_a{i}").alias(f"{c}_y" if c in df.columns else c) for i, c in enumerate(extra)
    ]
    result = joined.select(*columns)
    return (result, usage(asked)) if stats else result


def sem_extract(
    df: DataFrame,
    input_cols: Sequence[str],
    fields: Mapping[str, str | None] | Sequence[str],
    model: AnswerModel,
    *,
    quotes: bool = False,
    on_error: str = "raise",
    raw: bool = False,
    parallel: int | None = None,
    memo: str | None = None,
) -> DataFrame:
    """Add one text column per field, read from a JSON reply; all rows are kept.

    ``fields`` maps a field to its description, or to None. ``quotes`` adds
    ``{field}_quote``. A reply that is no JSON object raises, or yields NULLs with
    ``on_error="null"``.
    """
    if on_error not in ("raise", "null"):
        raise ValueError("on_error is 'raise' or 'null'")
    described = dict(fields) if isinstance(fields, Mapping) else {f: None for f in fields}
    wanted = list(described) + ([f"{f}_quote" for f in described] if quotes else [])
    about = tuple((f, described.get(f) or f) for f in wanted)
    spec = PromptSpec("extract", fields=about)
    names = list(input_cols)
    asked = with_replies(
        distinct_inputs(df, names, keep_missing=True), F.col("_context"), model, spec, parallel=parallel, memo=memo
    )
    shape = T.StructType([T.StructField(f, T.StringType()) for f in wanted])
    text = F.col("_reply.text")
    read = F.from_json(text, shape)
    if on_error == "raise":
        whole = F.from_json(text, "map<string,string>")
        read = F.when(whole.isNull(), F.raise_error(F.concat(F.lit("reply is not a JSON object: "), text)).cast(shape))\
            .otherwise(read)
    answered = asked.withColumn("_read", read).select(
        *KEY,
        *[F.col("_read").getField(f).alias(f"_a{i}") for i, f in enumerate(wanted)],
        text.alias("_raw"),
    )
    answered = stage(answered, "sem_extract")
    joined = df.join(answered, same_key(df, names))
    columns = [pick(df, c) for c in df.columns if c not in wanted]
    columns += [F.col(f"_a{i}").alias(f) for i, f in enumerate(wanted)]
    if raw:
        columns.append(F.col("_raw").alias("raw_output"))
    return joined.select(*columns)
