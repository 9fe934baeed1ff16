"""Model calls as table functions of Spark SQL: ``FROM llm_map(TABLE(…), …)``, ``llm_join`` and ``llm_qa``.

The scalar functions of the same names see rows as SQL hands them over. Table functions take a whole
``TABLE`` argument, say how it is to be partitioned and sorted, and read it as a stream: a question is
asked once per distinct input, pairs exist inside a task only, and a group of any size is
folded with a state of a few prompts.

    SELECT * FROM part JOIN llm_map(TABLE(SELECT DISTINCT p_name FROM part), 'Which quality?', 'p_name') USING (p_name)

    SELECT * FROM llm_join(TABLE(pairs), 'same ending')                      -- pairs: blocking_index(…)

    SELECT * FROM llm_qa(TABLE(SELECT g, t, text FROM notes) PARTITION BY g ORDER BY (t), 'What happened?', 'text', 'g')
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from semtab.models.answering import call_in_batches, says_true
from semtab.models.base import AnswerModel, count_tokens
from semtab.models.prompts import PromptSpec
from semtab.runtime import col, missing, require_columns, split_join, stage

#: Distinct left values that a task holds for one block or cell; larger blocks are cut into cells by :func:`blocking_index`.
HELD = 100_000
#: Values of one side that a cell holds, about.
CELL_VALUES = 1024


def _table(argument: AnalyzeArgument, needs: list[str], name: str) -> T.StructType:
    if not argument.isTable:
        raise ValueError(f"the first argument of {name} is a table: {name}(TABLE(…), …)")
    shape = argument.dataType
    absent = [n for n in needs if n not in shape.fieldNames()]
    if absent:
        raise ValueError(f"{name} needs column(s) {absent}; the table has {shape.fieldNames()}")
    return shape


def _names(columns: str | None) -> list[str]:
    return [c.strip() for c in (columns or "").split(",") if c.strip()]


def map_function(model: AnswerModel):
    """``llm_map(TABLE(t), question, column)``: one row ``column, answer`` per distinct value of a column.

    Values repeated within a task are asked once; write ``SELECT DISTINCT`` inside ``TABLE()`` so that each
    is asked once in all, and join the answers back. Missing values are left out.
    """

    class LlmMap:
        @staticmethod
        def analyze(table: AnalyzeArgument, question: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
            shape = _table(table, [column.value], "llm_map")
            return AnalyzeResult(T.StructType([shape[column.value], T.StructField("answer", T.StringType())]))

        def __init__(self) -> None:
            self.waiting: dict = {}
            self.seen: set = set()
            self.spec: PromptSpec | None = None

        def _answers(self) -> Iterator[tuple]:
            values = list(self.waiting)
            self.waiting = {}
            for value, reply in zip(values, call_in_batches(model, self.spec, [f"[Value]: «{v}»\n" for v in values])):
                yield value, reply.text

        def eval(self, row: Row, question: str, column: str) -> Iterator[tuple]:
            self.spec = self.spec or PromptSpec("map", question)
            value = row[column]
            if value is None or value in self.seen:
                return
            if len(self.seen) >= HELD:
                self.seen.clear()
            self.seen.add(value)
            self.waiting[value] = None
            if len(self.waiting) >= model.batch_size:
                yield from self._answers()

        def terminate(self) -> Iterator[tuple]:
            if self.waiting:
                yield from self._answers()

    return LlmMap


def join_function(model: AnswerModel):
    """``llm_join(TABLE(sides), criteria, max_pairs)``: the pairs ``left, right`` of values that hold.

    The table has columns ``side`` ('left' or 'right'), ``block`` and ``value``: only values of the same block are
    paired. :func:`blocking_index` makes it; it adds ``cell``, which parts large blocks, and ``blocks``, by which
    a pair that meets in several blocks is judged in one of them. The function has the table partitioned by
    block and cell and sorted by side and value, holds the left values and reads the right ones, so pairs
    never are rows. Repeated values are asked once, missing values nothing. A row without a block,
    a block of more than ``max_pairs`` pairs and one of more than ``HELD`` left values are refused: that is a product of two tables.
    """

    class LlmJoin:
        @staticmethod
        def analyze(table: AnalyzeArgument, criteria: AnalyzeArgument, max_pairs: AnalyzeArgument | None = None) -> AnalyzeResult:
            shape = _table(table, ["side", "block", "value"], "llm_join")
            parts = ["block", *(["cell"] if "cell" in shape.fieldNames() else [])]
            out = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
            return AnalyzeResult(out, partitionBy=[PartitioningColumn(c) for c in parts], orderBy=[OrderingColumn("side"), OrderingColumn("value")])

        def __init__(self) -> None:
            self.lefts: list[tuple] = []
            self.pairs: list[tuple[str, str]] = []
            self.last: tuple = ()
            self.asked = 0
            self.spec: PromptSpec | None = None

        def _accepted(self) -> Iterator[tuple]:
            pairs, self.pairs = self.pairs, []
            replies = call_in_batches(model, self.spec, [f"[Left]: «{a}»\n\n[Right]: «{b}»\n" for a, b in pairs])
            for pair, reply in zip(pairs, replies):
                if says_true(self.spec, reply.text):
                    yield pair

        def eval(self, row: Row, criteria: str, max_pairs: int = 1 << 20) -> Iterator[tuple]:
            self.spec = self.spec or PromptSpec("judge", criteria)
            if row["block"] is None:
                raise ValueError("llm_join: a row without a block would be paired with the whole other table")
            side, value = row["side"], row["value"]
            if side not in ("left", "right"):
                raise ValueError(f"llm_join: side is 'left' or 'right', not {side!r}")
            if value is None or (side, value) == self.last:
                return
            self.last = (side, value)
            blocks = row["blocks"] if "blocks" in row else None
            if side == "left":
                self.lefts.append((value, blocks))
                if len(self.lefts) > HELD:
                    raise ValueError(f"llm_join: block {row['block']!r} has more than {HELD} left values; use blocking_index")
                return
            self.asked += len(self.lefts)
            if self.asked > max_pairs:
                raise ValueError(f"llm_join: block {row['block']!r} has more than {max_pairs} pairs; use finer blocks, or raise max_pairs")
            for left, others in self.lefts:
                # a pair that shares several blocks belongs to the first one
                if blocks and others and len(blocks) > 1 and len(others) > 1 and min(set(blocks).intersection(others)) != row["block_hash"]:
                    continue
                self.pairs.append((left, value))
                if len(self.pairs) >= model.batch_size:
                    yield from self._accepted()

        def terminate(self) -> Iterator[tuple]:
            if self.pairs:
                yield from self._accepted()

    return LlmJoin


def qa_function(model: AnswerModel):
    """``llm_qa(TABLE(t) PARTITION BY … ORDER BY …, question, column, keep, folded, budget)``: one answer per partition.

    Rows are read in order and packed into prompts of ``budget`` tokens. An answered prompt leaves one summary
    behind; a level of summaries is folded when it fills a prompt, so the state is a few prompts however many rows
    the partition has. ``keep`` names columns to hand through (those of PARTITION BY, comma-separated), ``folded`` says that the
    rows are answers of an earlier ``llm_qa`` already. ``calls`` counts the prompts.

    A group that holds much of the table is one partition and hence one task; part it by a further
    column and fold the answers once more:

        SELECT * FROM llm_qa(TABLE(
            SELECT * FROM llm_qa(TABLE(SELECT g, t DIV 1000 AS slice, t, text FROM notes) PARTITION BY (g, slice) ORDER BY (t), 'q', 'text', 'g,slice')
        ) PARTITION BY g ORDER BY (slice), 'q', 'answer', 'g', true)
    """

    class LlmQa:
        @staticmethod
        def analyze(
            table: AnalyzeArgument, question: AnalyzeArgument, column: AnalyzeArgument, keep: AnalyzeArgument | None = None,
            folded: AnalyzeArgument | None = None, budget: AnalyzeArgument | None = None,
        ) -> AnalyzeResult:
            names = _names(keep.value if keep else None)
            shape = _table(table, [column.value, *names], "llm_qa")
            out = [*[shape[n] for n in names], T.StructField("answer", T.StringType()), T.StructField("calls", T.LongType())]
            return AnalyzeResult(T.StructType(out))

        def __init__(self) -> None:
            self.head: list | None = None
            self.levels: list[tuple[list[str], int]] = []
            self.calls = 0

        def _measure(self, text: str, n: int, level: int) -> int:
            return getattr(model, "count_tokens", count_tokens)(f"\n\t{self._tag(level)} {n}: {text}")

        def _tag(self, level: int) -> str:
            return "Source" if level or self.folded else "Document"

        def _ask(self, level: int) -> str:
            held = self.levels[level][0]
            text = "".join(f"\n\t{self._tag(level)} {n}: {d}" for n, d in enumerate(held, 1))
            self.calls += 1
            return call_in_batches(model, self._spec(level), [text])[0].text

        def _spec(self, level: int) -> PromptSpec:
            return PromptSpec("fold_again" if level or self.folded else "fold", self.question)

        def _add(self, level: int, text: str) -> None:
            if level == len(self.levels):
                self.levels.append(([], 0))
            held, used = self.levels[level]
            size = self._measure(text, len(held) + 1, level)
            room = max(1, self.budget - sum(count_tokens(m["content"]) for m in self._spec(level).messages("")))
            if held and used + size > room:
                if len(held) == 1 and self._tag(level) == "Source":
                    raise ValueError("answers are too long to fold: no two fit into one prompt; raise the budget")
                self._fold(level)
                held, used, size = self.levels[level][0], 0, self._measure(text, 1, level)
            held.append(text)
            self.levels[level] = (held, used + size)

        def _fold(self, level: int) -> None:
            answer = self._ask(level)
            self.levels[level] = ([], 0)
            self._add(level + 1, answer)

        def eval(self, row: Row, question: str, column: str, keep: str | None = None, folded: bool = False, budget: int | None = None) -> None:
            if self.head is None:
                self.head = [row[n] for n in _names(keep)]
                self.question, self.folded = question, bool(folded)
                self.budget = budget or model.context_tokens - model.reply_tokens
            if row[column] is not None:
                self._add(0, str(row[column]))

        def terminate(self) -> Iterator[tuple]:
            if self.head is None:
                return
            answer, level = None, 0
            while level < len(self.levels):
                held = self.levels[level][0]
                last = not any(above for above, _ in self.levels[level + 1 :])
                if last and len(held) == 1 and self._tag(level) == "Source":
                    answer = held[0]  # one summary is left
                    break
                if held:
                    self._fold(level)
                level += 1
            yield (*self.head, answer, self.calls)

    return LlmQa


def register_table_functions(spark: SparkSession, model: AnswerModel) -> None:
    """Make the three table functions known to ``spark.sql``."""
    for name, make in (("llm_map", map_function), ("llm_join", join_function), ("llm_qa", qa_function)):
        spark.udtf.register(name, F.udtf(make(model)))


def blocking_index(
    left: DataFrame, right: DataFrame, left_value: str, right_value: str, left_block: str | Column, right_block: str | Column,
    *, max_calls: int | None = None, cell_values: int = CELL_VALUES,
) -> DataFrame:
    """The two sides of a judged join for ``llm_join``: ``side block block_hash cell value blocks``.

    Values may hold together only where their blocks are equal; a value may have several blocks (several rows), one judged
    pair is asked once all the same. Distinct values and blocks are kept, values as text; rows without value or block,
    and blocks that only one side has, pair with nothing. Blocks of more than ``cell_values`` values of a side become
    a grid of cells, so that a block that holds a third of the tables is spread over many tasks. With ``max_calls`` a join of more
    pairs is refused, as by ``sem_join``; without it any number passes.
    """

    def distinct(df: DataFrame, value: str, block: str | Column) -> DataFrame:
        require_columns(df, [value, *([block] if isinstance(block, str) else [])])
        by = col(block) if isinstance(block, str) else block
        rows = df.where(~missing(df, value)).select(by.cast("string").alias("block"), col(value).cast("string").alias("value"))
        return rows.where(F.col("block").isNotNull()).distinct()

    l, r = (stage(distinct(*a), "sides") for a in ((left, left_value, left_block), (right, right_value, right_block)))
    counts = l.groupBy("block").agg(F.count("*").alias("_nl")).join(r.groupBy("block").agg(F.count("*").alias("_nr")), "block")
    total = 0 if max_calls is None else counts.agg(F.sum(F.col("_nl") * F.col("_nr"))).first()[0] or 0
    if max_calls is not None and total > max_calls:
        raise ValueError(f"{total} pairs in the blocks are more than max_calls={max_calls}; use finer blocks, or raise max_calls")

    def cells(n: Column) -> Column:
        # three quarters on average: values are dealt by hash, and no cell may have more pairs than llm_join takes
        return F.when(n <= cell_values, 1).otherwise(F.ceil(n / (0.75 * cell_values))).cast("int")

    grid = counts.select("block", cells(F.col("_nl")).alias("_a"), cells(F.col("_nr")).alias("_b"))

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = split_join(df, grid, "block").withColumn("block_hash", F.xxhash64("block"))
        own, other = ("_a", "_b") if name == "left" else ("_b", "_a")
        at = F.pmod(F.xxhash64("value"), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        placed = rows.select("block", "block_hash", "value", at.alias("_own"), each.alias("_other"), "_b")
        cell = F.col("_own") * F.col("_b") + F.col("_other") if name == "left" else F.col("_other") * F.col("_b") + F.col("_own")
        # few values have several blocks: only those carry the list of them
        several = rows.groupBy("value").agg(F.collect_set("block_hash").alias("blocks")).where(F.size("blocks") > 1)
        placed = placed.select(F.lit(name).alias("side"), "block", "block_hash", cell.alias("cell"), "value")
        return placed.join(several, "value", "left").select("side", "block", "block_hash", "cell", "value", "blocks")

    return side(l, "left").unionByName(side(r, "right"))
