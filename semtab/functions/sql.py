"""Model calls inside Spark SQL: ``llm_map``, ``llm_join`` and ``llm_qa``.

``SELECT llm_map('question', col)`` answers per row, ``JOIN … ON llm_join('criteria',
a, b)`` judges pairs, ``SELECT llm_qa('question', col) … GROUP BY`` answers over a
group. SQL hands these scalar functions rows as they come: use the table functions of the same
names (:mod:`semtab.functions.tables`) where inputs repeat, where pairs are many or where groups are large.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.functions.tables import register_table_functions
from semtab.models.answering import call_in_batches, says_true
from semtab.models.base import AnswerModel
from semtab.models.prompts import PromptSpec
from semtab.operators.folding import sem_agg


def _by_question(questions: pd.Series, contexts: list[str], model: AnswerModel, task: str) -> list[str]:
    out: list[str] = [""] * len(contexts)
    for question, at in questions.groupby(questions).groups.items():
        rows = list(at)
        asked = list(dict.fromkeys(contexts[i] for i in rows))  # repeated inputs of a batch are asked once
        replies = dict(zip(asked, call_in_batches(model, PromptSpec(task, question), asked)))
        for i in rows:
            out[i] = replies[contexts[i]].text
    return out


def register_sql_functions(spark: SparkSession, model: AnswerModel) -> None:
    """Make the three functions known to ``spark.sql``, as scalar and as table functions."""
    register_table_functions(spark, model)

    def llm_map(question: pd.Series, value: pd.Series) -> pd.Series:
        value = value.reset_index(drop=True)
        contexts = [f"[Value]: «{v}»\n" for v in value]
        answers = pd.Series(_by_question(question.reset_index(drop=True), contexts, model, "map"), dtype=object)
        return answers.where(value.notna(), None)

    def llm_join(criteria: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        contexts = [f"[Left]: «{a}»\n\n[Right]: «{b}»\n" for a, b in zip(left, right)]
        texts = _by_question(criteria.reset_index(drop=True), contexts, model, "judge")
        return pd.Series([says_true(PromptSpec("judge"), t) for t in texts], dtype=bool)

    def llm_qa(question: pd.Series, value: pd.Series) -> str:
        parts = "".join(f"\n\tDocument {i}: {v}" for i, v in enumerate(value.dropna(), 1))
        return call_in_batches(model, PromptSpec("fold", question.iloc[0]), [parts])[0].text

    for f, hints, returns in (
        (llm_map, (pd.Series, pd.Series, pd.Series), T.StringType()),
        (llm_join, (pd.Series, pd.Series, pd.Series, pd.Series), T.BooleanType()),
        (llm_qa, (pd.Series, pd.Series, str), T.StringType()),
    ):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        f.__annotations__ = dict(zip([*names, "return"], hints))
        udf = F.pandas_udf(f, returns)
        # an aggregate cannot be marked non-deterministic
        spark.udf.register(f.__name__, udf if f is llm_qa else udf.asNondeterministic() if f is llm_map else udf)


def qa_over(query: DataFrame, question: str, model: AnswerModel, out: str = "Answer", **options) -> DataFrame:
    """The answer to a question over a subquery of any size, as one row."""
    return sem_agg(query, question, model, out=out, all_cols=True, **options)
