"""Running a stored process: a list of typed steps over named tables.

Every step adds a table under a derived name. Relational steps are lazy: those that lead
nowhere cost nothing.
"""

from __future__ import annotations

import re
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from semtab.models.base import AnswerModel, Embedder
from semtab.models.memo import Recorded
from semtab.operators import values
from semtab.operators.clustering import cluster_summary
from semtab.operators.folding import sem_agg
from semtab.operators.matching import sem_join
from semtab.operators.ranking import sem_topk
from semtab.operators.retrieval import embed
from semtab.operators.semantic import sem_filter, sem_map

OPERATORS = (
    "filter", "join", "agg", "head", "groupby", "orderby", "map", "column_calculate", "value_calculate",
    "sem_filter", "sem_join", "sem_map", "sem_agg", "sem_topk", "sem_cluster_by",
)


@dataclass(frozen=True)
class Ref:
    """The scalar that an earlier step, counted from 0, returned."""

    step: int


@dataclass(frozen=True)
class Step:
    op: str
    table: str | None
    args: tuple = ()
    options: Mapping[str, object] = field(default_factory=dict)


@dataclass
class Run:
    """What a process left behind."""

    tables: dict[str, DataFrame]
    results: list[DataFrame] = field(default_factory=list)
    names: list[str | None] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    error: str | None = None

    @property
    def scalars(self) -> list[int]:
        """The steps that returned a scalar."""
        return [i for i, n in enumerate(self.names) if n is None]

    @property
    def answer(self) -> DataFrame | None:
        """The last step's result; none where a step failed."""
        return self.results[-1] if self.results and self.error is None else None


def derived_name(table: str, op: str, taken: Mapping[str, object]) -> str:
    """``{table}_{op}``, then ``_2``, ``_3`` and so on."""
    name, n = f"{table}_{op}", 2
    while name in taken:
        name, n = f"{table}_{op}_{n}", n + 1
    return name


_BOUND = re.compile(r"@step(\d+)")

#: Stored steps use this word for the first scalar of the process.
PLACEHOLDER = "<placeholder>"


def bind(text: str, results: Sequence[DataFrame], scalars: Sequence[int] = ()) -> str:
    """Replace ``@stepN`` in an instruction by the scalar of step ``N``, the placeholder by the first one."""
    if PLACEHOLDER in text and scalars:
        text = text.replace(PLACEHOLDER, f"@step{scalars[0]}")
    return _BOUND.sub(lambda m: str(results[int(m.group(1))].first()[0]), text)


def run_steps(
    tables: Mapping[str, DataFrame],
    steps: Sequence[Step],
    model: AnswerModel | None = None,
    embedder: Embedder | None = None,
    *,
    stop_when_empty: bool = False,
) -> Run:
    """Apply the steps in order. An error, or an empty table if asked for, ends the run and is recorded.

    Steps by value stay lazy. Steps that call a model write its answers when they are
    applied, so several later steps can read them without new calls. With a model made by
    :func:`semtab.models.memo.recorded` calls and tokens are counted per step.
    """
    run = Run(dict(tables))
    for i, step in enumerate(steps):
        began = time.perf_counter()
        try:
            # a recorded model counts each step by itself
            out, scalar = _apply(step, run, model.at(f"{i} {step.op}") if isinstance(model, Recorded) else model, embedder)
            empty = stop_when_empty and not scalar and out.isEmpty()
        except Exception as e:
            run.error = f"step {i} ({step.op}): {e}"
            run.history.append({"step": i, "op": step.op, "error": str(e)})
            return run
        name = None
        if not scalar:
            name = derived_name(step.table, step.op, run.tables)
            run.tables[name] = out
        run.results.append(out)
        run.names.append(name)
        run.history.append(
            {"step": i, "op": step.op, "table": name, "tables": list(run.tables), "seconds": time.perf_counter() - began}
        )
        if empty:
            run.error = f"step {i} ({step.op}): empty table"
            return run
    return run


def _apply(step: Step, run: Run, model, embedder) -> tuple[DataFrame, bool]:
    if step.op not in OPERATORS:
        raise ValueError(f"operator {step.op!r} is not one of {OPERATORS}")

    def value(a):
        if a == PLACEHOLDER and run.scalars:
            a = Ref(run.scalars[0])
        return run.results[a.step] if isinstance(a, Ref) else a

    args, options = [value(a) for a in step.args], dict(step.options)
    if step.op == "value_calculate":
        return values.value_calculate(*args, **options), True
    if step.table not in run.tables:
        raise ValueError(f"table {step.table!r} not found")
    df = run.tables[step.table]
    if step.op.startswith("sem_") and model is None:
        raise ValueError(f"{step.op} needs a model")
    if step.op == "agg":
        return values.agg(df, *args, **options), True
    if step.op == "filter":
        column, conditions = args
        return values.filter_rows(df, column, [(op, value(v)) for op, v in conditions]), False
    if step.op in ("join", "sem_join"):
        if args[0] not in run.tables:
            raise ValueError(f"table {args[0]!r} not found")
        other = run.tables[args[0]]
        if step.op == "join":
            return values.join(df, other, *args[1:], **options), False
        return sem_join(df, other, bind(args[1], run.results, run.scalars), model, **options), False
    if step.op == "sem_cluster_by":
        return _cluster(df, args, options, model, embedder), False
    by_value = {
        "head": values.head, "groupby": values.groupby, "orderby": values.orderby, "map": values.project,
        "column_calculate": values.column_calculate,
    }
    if step.op in by_value:
        return by_value[step.op](df, *args, **options), False
    instruction = bind(args[0], run.results, run.scalars)
    if step.op == "sem_topk":
        return sem_topk(df, instruction, args[1], model, embedder=embedder, **options), False
    by_meaning = {"sem_filter": sem_filter, "sem_map": sem_map, "sem_agg": sem_agg}
    return by_meaning[step.op](df, instruction, model, **options), False


def _cluster(df, args, options, model, embedder) -> DataFrame:
    column, k, agg_col, func = args
    if embedder is None:
        raise ValueError("sem_cluster_by needs an embedder")
    vectors = embed(df, column, embedder, "_vec")
    return cluster_summary(vectors, column, "_vec", k, agg_col, func, model, **options)


# --- stored argument text --------------------------------------------------


def _names(text: str) -> list[str]:
    return [p.strip() for p in text.strip().strip("[]").split(",")]


def _number(text: str):
    try:
        n = float(text)
    except ValueError:
        return text
    return int(n) if n.is_integer() and re.fullmatch(r"[+-]?\d+", text) else n


def typed_step(operator: str, params: str) -> Step:
    """A typed step from a stored operator name and its ``;;``-separated arguments."""
    op = operator.strip().strip("\"'")
    parts = [p.strip().strip("\"'") for p in params.split(";;")]
    if op == "value_calculate":
        return Step(op, None, (parts[0], *[_number(p) for p in parts[1:]]))
    table, rest = parts[0], parts[1:]
    if op == "filter":
        pairs = re.findall(r"\(\s*(\w+)\s*,\s*([^()]*?)\s*\)", rest[1])
        return Step(op, table, (rest[0], tuple((o, v.strip("\"'")) for o, v in pairs)))
    if op == "orderby":
        return Step(op, table, (_names(rest[0]), rest[1]))
    if op == "map":
        return Step(op, table, (_names(rest[0]),))
    if op == "groupby":
        return Step(op, table, (_names(rest[0]), rest[1], rest[2]))
    if op == "head":
        return Step(op, table, (int(rest[0]),))
    if op == "sem_topk":
        return Step(op, table, (rest[0], int(rest[1])))
    if op == "sem_cluster_by":
        return Step(op, table, (rest[0], int(rest[1]), rest[2], rest[3]))
    return Step(op, table, tuple(rest))
