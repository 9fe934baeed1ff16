"""Semantic join: pairs of a left and a right value that a model holds true.

Distinct values are paired, never rows. The smaller list, of checked size, is
broadcast; beyond that both lists are cut into chunks and every pair of chunks is
one task. Pairs exist only inside a task while their prompts are asked; tasks
return accepted pairs alone, and two equality joins bring the rows back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.functions.claims import distinct_holes, row_text
from semtab.models.answering import call_in_batches, says_true, slots, why, with_replies
from semtab.models.base import AnswerModel, Embedder
from semtab.models.prompts import PromptSpec, shots_from
from semtab.operators import metric as M
from semtab.operators import vectors as V
from semtab.operators.cascade import Thresholds, draw_chance, learn_thresholds
from semtab.operators.ranking import refuse_numeric
from semtab.operators.semantic import sem_map
from semtab.runtime import col, key_hash, missing, pick, require_columns, stage, tasks_for

BROADCAST_BYTES = 32 << 20
BLOCK_VALUES = 1024
#: Prompts of pairs that a task holds at once, whatever the size of the lists.
PAIRS_HELD = 4096


@dataclass(frozen=True)
class JoinCascade:
    """Targets under which similarity may settle pairs instead of the model.

    Thresholds are learnt from a share ``sample`` of all pairs, about ``max_labelled`` at most. Below
    ``min_pairs`` pairs the model judges all of them.
    """

    embedder: Embedder
    recall_target: float | None = None
    precision_target: float | None = None
    sample: float = 0.1
    failure_probability: float = 0.2
    map_instruction: str | None = None
    map_examples: object = None
    min_pairs: int = 0
    seed: int = 42
    max_labelled: int = 250


def sides(claim: str, left: DataFrame, right: DataFrame) -> tuple[str, str, str, str]:
    """Hole and column of each side: ``{c:left} {c:right}``, or by name where only one side has it."""
    holes, found = distinct_holes(claim), []
    shared = [h for h in holes if h in left.columns and h in right.columns]
    if shared:
        raise ValueError(f"column {shared[0]!r} is on both sides; mark it with :left or :right")
    for mark, names in ((":left", left.columns), (":right", right.columns)):
        fitting = [h for h in holes if mark in h][-1:] or [h for h in holes if h in names]
        if not fitting:
            raise ValueError("the claim needs one column of each side")
        found += [fitting[0], fitting[0].split(mark)[0]]
    return tuple(found)


def _values(df: DataFrame, name: str, out: str) -> DataFrame:
    return df.where(~missing(df, name)).select(col(name).cast("string").alias(out)).distinct()


def _lines(label: str, values: list[str]) -> list[str]:
    return [f"[{label.capitalize()}]: «{v}»\n" for v in values]


class _PairJudge:
    """Asks the model about every pair of two short lists, in batches, and keeps what holds."""

    def __init__(self, model, spec, labels, on_error, default) -> None:
        self.model, self.spec, self.labels = model, spec, labels
        self.on_error, self.default = on_error, default

    def __call__(self, lefts: list[str], rights: list[str], wanted: np.ndarray | None = None) -> pd.DataFrame:
        lt, rt = _lines(self.labels[0], lefts), _lines(self.labels[1], rights)
        found: list[tuple] = []
        for i, head in enumerate(lt):
            at = range(len(rt)) if wanted is None else np.flatnonzero(wanted[i])
            for begin in range(0, len(at), PAIRS_HELD):
                some = at[begin : begin + PAIRS_HELD]
                replies = call_in_batches(self.model, self.spec, [f"{head}\n{rt[j]}" for j in some])
                for j, r in zip(some, replies):
                    if says_true(self.spec, r.text, self.on_error, self.default):
                        found.append((lefts[i], rights[j], why(self.spec, r.text)))
        return pd.DataFrame(found, columns=["_l", "_r", "_why"])


PAIRS = T.StructType([T.StructField(n, T.StringType()) for n in ("_l", "_r", "_why")])


def _judge_all(lv: DataFrame, rv: DataFrame, sizes, judge: _PairJudge, broadcast_bytes: int, block: int) -> DataFrame:
    (nl, bl), (nr, br) = sizes
    spark = lv.sparkSession
    if min(bl, br) <= broadcast_bytes:
        flip = bl < br
        held_side, name = (lv, "_l") if flip else (rv, "_r")
        other = rv if flip else lv
        held = spark.sparkContext.broadcast([r[0] for r in held_side.collect()])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                mine = pdf.iloc[:, 0].tolist()
                step = max(1, 4 * PAIRS_HELD // max(1, len(held.value)))
                for at in range(0, len(mine), step):
                    part = mine[at : at + step]
                    yield judge(held.value, part) if name == "_l" else judge(part, held.value)

        return other.repartition(slots(spark)).mapInPandas(run, PAIRS)
    kl, kr = tasks_for(nl, block), tasks_for(nr, block)
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    l = lv.select("_l", F.pmod(F.xxhash64("_l"), F.lit(kl)).cast("int").alias("_a"), grid(kr).alias("_b"))
    r = rv.select("_r", F.pmod(F.xxhash64("_r"), F.lit(kr)).cast("int").alias("_b"), grid(kl).alias("_a"))

    def run_pair(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        return judge(lp["_l"].tolist(), rp["_r"].tolist())

    # an explicit width: merging small partitions would put many blocks of calls into one task
    n = max(slots(spark), min(kl * kr, 100_000))
    l, r = l.repartition(n, "_a", "_b"), r.repartition(n, "_a", "_b")
    return l.groupBy("_a", "_b").cogroup(r.groupBy("_a", "_b")).applyInPandas(run_pair, PAIRS)


def _size(values: DataFrame, name: str) -> tuple[int, int]:
    row = values.agg(F.count("*").alias("n"), F.sum(F.octet_length(name) + 64).alias("b")).first()
    return row["n"], row["b"] or 0


def _text_hash(name: str) -> list:
    """As ``key_hash`` of the value as text, which is what pairs hold whatever the type of the column."""
    text = col(name).cast("string")
    return [F.xxhash64(F.lit(seed), text.isNull(), text) for seed in (1, 2)]


def bring_back(left: DataFrame, right: DataFrame, pairs: DataFrame, lc: str, rc: str, extra: dict[str, str]) -> DataFrame:
    """Rows of both sides for accepted value pairs; clashing columns become ``c:left`` and ``c:right``."""
    clash = set(left.columns) & set(right.columns)
    # written out: pairs hold model answers, and only their true size tells how to join them
    hashed = stage(
        pairs.select(
            *[h.alias(f"_p{i}") for i, h in enumerate(key_hash(pairs, ["_l"]) + key_hash(pairs, ["_r"]))],
            *[F.col(a) for a in extra],
        ),
        "pairs",
    )
    l1, l2 = _text_hash(lc)
    r = right.select(
        *[pick(right, c).alias(f"_r{i}") for i, c in enumerate(right.columns)],
        *[h.alias(f"_s{i}") for i, h in enumerate(_text_hash(rc))],
    )
    joined = left.join(hashed, (l1 == F.col("_p0")) & (l2 == F.col("_p1"))).join(
        r, (F.col("_p2") == F.col("_s0")) & (F.col("_p3") == F.col("_s1")))
    out = [pick(left, c).alias(f"{c}:left" if c in clash else c) for c in left.columns]
    out += [F.col(f"_r{i}").alias(f"{c}:right" if c in clash else c) for i, c in enumerate(right.columns)]
    out += [F.col(a).alias(b) for a, b in extra.items()]
    return joined.select(*out)


def sem_join(
    left: DataFrame,
    right: DataFrame,
    claim: str,
    model: AnswerModel,
    *,
    how: str = "inner",
    examples=None,
    strategy: str | None = None,
    on_error: str = "raise",
    default: bool = True,
    explain: bool = False,
    suffix: str = "_join",
    candidates: DataFrame | None = None,
    cascade: JoinCascade | None = None,
    max_calls: int | None = None,
    stats: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_values: int = BLOCK_VALUES,
):
    """Inner join of all rows whose claim about one left and one right column holds.

    Each distinct pair of values is judged once. Three ways to need fewer calls:
    ``candidates``, a table of (left value, right value) outside of which nothing
    can hold; ``cascade``, which lets similarity settle the clear pairs; and
    ``max_calls``, which refuses a join that would ask more.
    """
    if how != "inner":
        raise NotImplementedError("a semantic join is an inner join")
    lh, lc, rh, rc = sides(claim, left, right)
    require_columns(left, [lc])
    require_columns(right, [rc])
    refuse_numeric(left, [lc])
    refuse_numeric(right, [rc])
    shots = shots_from(examples, [lc, rc], strategy, [lh, rh])
    spec = PromptSpec("judge", claim, strategy, shots)
    explain = explain or (strategy == "cot" and examples is not None)
    extra = {"_why": f"explanation{suffix}"} if explain else {}
    judge = _PairJudge(model, spec, (lh, rh), on_error, default)
    report: dict = {}
    if candidates is not None:
        pairs = _judge_candidates(candidates, spec, model, (lh, rh), on_error, default)
    else:
        lv, rv = _values(left, lc, "_l"), _values(right, rc, "_r")
        sizes = _size(lv, "_l"), _size(rv, "_r")
        total = sizes[0][0] * sizes[1][0]
        targets = cascade is not None and (cascade.recall_target is not None or cascade.precision_target is not None)
        if targets and total >= cascade.min_pairs:
            pairs, report = _cascade(lv, rv, sizes[0][0], total, judge, cascade, lc, rc, max_calls)
        else:
            if max_calls is not None and total > max_calls:
                raise ValueError(f"the join needs {total} calls, more than max_calls={max_calls}")
            report = {"total_LM_calls": total}
            pairs = _judge_all(lv, rv, sizes, judge, broadcast_bytes, block_values)
    out = bring_back(left, right, pairs, lc, rc, extra)
    return (out, report) if stats else out


def _judge_candidates(candidates, spec, model, labels, on_error, default) -> DataFrame:
    from semtab.functions.claims import answer_of, bool_of, explanation_of, pair_text

    a, b = candidates.columns[:2]
    known = candidates.select(col(a).cast("string").alias("_l"), col(b).cast("string").alias("_r")).where(
        "_l IS NOT NULL AND _r IS NOT NULL").distinct()
    text = pair_text(row_text(known, ["_l"], [labels[0]]), row_text(known, ["_r"], [labels[1]]))
    asked = with_replies(known, text, model, spec)
    reply = F.col("_reply.text")
    answer = answer_of(reply) if spec.reasons else reply
    told = explanation_of(reply) if spec.reasons else F.lit(None).cast("string")
    return asked.where(bool_of(answer, on_error, default)).select("_l", "_r", told.alias("_why"))


# --- cascade ---------------------------------------------------------------


def _clipped(s: np.ndarray) -> np.ndarray:
    return np.clip(s, 0.0, 1.0)


_SUMS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("_n", "_root")])
_BANDS = T.StructType([T.StructField(n, T.LongType()) for n in ("_high", "_middle")])
_DRAWN = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("_l", "_r")] + [T.StructField(n, T.DoubleType()) for n in ("_s", "_chance")])


def _similar(values: DataFrame, text: str, name: str, embedder: Embedder, out: str) -> DataFrame:
    from semtab.models.answering import vector_column

    coded = values.repartition(slots(values.sparkSession)).withColumn(
        out, vector_column(F.col(text).cast("string"), embedder))
    return stage(coded.select(name, out), "vectors")


def _noise(lk: np.ndarray, rk: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for every pair that depends on its two values and the seed only."""
    a, b = (pd.util.hash_array(np.asarray(k, object), categorize=False) for k in (lk, rk))
    x = (a * np.uint64(0x9E3779B97F4A7C15))[:, None] ^ (b + np.uint64(seed))[None, :]
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _learn(l: DataFrame, r: DataFrame, size: tuple, nl: int, total: int, judge: _PairJudge, c: JoinCascade) -> tuple[Thresholds, int]:
    """Thresholds from a judged sample: up to ``max_labelled`` left values by hash, of each its pairs weighted by similarity.

    With as many left values as labels, the labels spread over left values, and only their rows of the
    pair matrix are computed. The first step gives all left values one chance, so weights need the second only.
    """
    some = min(nl, c.max_labelled)
    few = stage(l.orderBy(F.xxhash64(F.lit(c.seed), "_lk"), "_lk").limit(some), "sampled")
    pairs, wanted = some * size[0], min(float(c.max_labelled), c.sample * total)

    def sums(lk, left, rk, right):
        s = _clipped(V.inner_products(left, right))
        return pd.DataFrame({"_n": [float(s.size)], "_root": [float(np.sqrt(s).sum())]})

    root = V.every_block(few, r, sums, _SUMS, measured=size).agg(F.sum("_root")).first()[0] or 0.0

    def draw(lk, left, rk, right):
        s = _clipped(V.inner_products(left, right))
        chance = np.minimum(draw_chance(np.sqrt(s), pairs, root, wanted), 1.0)
        li, ri = np.nonzero(_noise(lk, rk, c.seed) < chance)
        return pd.DataFrame({"_l": lk[li], "_r": rk[ri], "_s": s[li, ri], "_chance": chance[li, ri]})

    drawn = stage(V.every_block(few, r, draw, _DRAWN, measured=size), "labelled")
    held = _judge_candidates(drawn.select("_l", "_r"), judge.spec, judge.model, judge.labels, judge.on_error, judge.default)
    true = {(x["_l"], x["_r"]) for x in held.select("_l", "_r").collect()}
    rows = drawn.orderBy("_l", "_r").collect()
    learnt = learn_thresholds(
        np.array([x["_s"] for x in rows]), np.array([(x["_l"], x["_r"]) in true for x in rows], bool),
        1.0 / np.array([x["_chance"] for x in rows]),
        1.0 if c.recall_target is None else c.recall_target,
        1.0 if c.precision_target is None else c.precision_target, c.failure_probability / 2,
    )
    return learnt, len(rows)


def _floor(t: Thresholds) -> float:
    """Pairs below can only be rejected; clipped scores say nothing of products below zero."""
    return t.negative - 1e-9 if t.negative >= 0 else -1e9


def _bands(l: DataFrame, r: DataFrame, size: tuple, total: int, t: Thresholds) -> tuple[int, int, int]:
    """How many pairs are accepted, rejected and open; only those that are not rejected are visited."""
    def count(lk, left, rk, right):
        s = _clipped(V.inner_products(left, right))
        high = s >= t.positive
        return pd.DataFrame({"_high": [int(high.sum())], "_middle": [int((~high & (s > t.negative)).sum())]})

    row = M.pairs_above(l, r, _floor(t), count, _BANDS, measured=size).agg(*[F.sum(f.name).alias(f.name) for f in _BANDS]).first()
    high, middle = row["_high"] or 0, row["_middle"] or 0
    return high, total - high - middle, middle


def _cascade(lv, rv, nl, total, judge: _PairJudge, c: JoinCascade, lc: str, rc: str, max_calls) -> tuple[DataFrame, dict]:
    """Two plans, similarity of the values or of values mapped first; the one with fewer open pairs runs.

    The second is looked at only if the first leaves more pairs open than the left values it would have mapped.
    """
    r = _similar(rv, "_r", "_r", c.embedder, "_vec").select(F.col("_r").alias("_rk"), F.col("_vec").alias("_rv"))
    plain = _similar(lv, "_l", "_l", c.embedder, "_vec").select(F.col("_l").alias("_lk"), F.col("_vec").alias("_lv"))
    size = V.measure(r, "_rv")

    def planned(name: str, l: DataFrame) -> tuple:
        learnt, asked = _learn(l, r, size, nl, total, judge, c)
        return name, l, learnt, asked, _bands(l, r, size, total, learnt)

    chosen = planned("search", plain)
    learning = chosen[3]
    # mapping asks once per left value: with fewer open pairs than that, the second plan can't be the cheaper one
    if chosen[4][2] > nl:
        default_map = (
            f"For {{{lc}}}, name the {rc} values that fit it best, as a list of 2 to 10 of them separated by commas."
        )
        named = lv.select(F.col("_l").alias(lc))
        mapped = sem_map(named, c.map_instruction or default_map, judge.model, out="_mapped", examples=c.map_examples)
        mapped = mapped.select(col(lc).alias("_l"), "_mapped")
        as_right = _similar(mapped, "_mapped", "_l", c.embedder, "_vec").select(
            F.col("_l").alias("_lk"), F.col("_vec").alias("_lv"))
        other = planned("map-search", as_right)
        learning += other[3] + as_right.count()
        chosen = chosen if chosen[4][2] < other[4][2] else other
    name, l, t, _, (high, low, middle) = chosen
    if max_calls is not None and middle > max_calls:
        raise ValueError(f"{middle} pairs stay open after the cascade, more than max_calls={max_calls}")

    def settle(lk, left, rk, right):
        s = _clipped(V.inner_products(left, right))
        li, ri = np.nonzero(s >= t.positive)
        sure = pd.DataFrame({"_l": lk[li], "_r": rk[ri], "_why": None})
        open_pairs = (s < t.positive) & (s > t.negative)
        rows = np.flatnonzero(open_pairs.any(axis=1))
        asked = judge([lk[i] for i in rows], list(rk), open_pairs[rows])
        return pd.concat([sure, asked]) if len(asked) else sure

    pairs = M.pairs_above(l, r, _floor(t), settle, PAIRS, measured=size)
    report = {
        "plan": name,
        "pos_threshold": t.positive,
        "neg_threshold": t.negative,
        "join_resolved_by_helper_model": high + low,
        "join_helper_positive": high,
        "join_helper_negative": low,
        "join_resolved_by_large_model": middle,
        "optimized_join_cost": learning,
        "total_LM_calls": learning + middle,
    }
    return pairs, report
