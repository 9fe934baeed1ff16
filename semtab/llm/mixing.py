"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semtab.llm.common import WORD, fresh, mark_of
from semtab.operators.running import running_total
from semtab.runtime import col, require_columns, split_join, stage

_EPS = 1e-9
#: Units of a source that are settled by the landing, besides the two the flight leaves.
_LANDING = 12
#: Sources up to which their table is broadcast: well below 10 MB.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _nth(weights: tuple[float, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0, window_sources: int = BROADCAST_SOURCES
) -> DataFrame:
    """``target`` for each row of ``_source source_size``: shares by weight, at most ``cap`` times the source.

    Sources by code point, the missing one last, weigh ``weights`` in turn. What a capped
    source can't take goes to the others by weight. With sources in the order of the level
    at which they are capped, the common level is that of the first one not capped, so no
    rounds are needed. That takes a window of one row per source; of more than ``window_sources`` sources the
    level is found by rounds of sums instead, which give the same targets.
    """
    if sizes.count() > window_sources:
        return _targets_by_rounds(sizes, weights, share, cap)
    turn = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    place = (F.row_number().over(turn) - 1) % len(weights)
    t = sizes.withColumn("_w", _nth(weights, place)).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn("_level", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_level", F.col("_source").isNull(), F.col("_source"))
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.select(
        "*",
        F.sum("source_size").over(every).alias("_all"),
        F.sum("_w").over(every).alias("_weights"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_capped"),
        F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_gone"),
    ).withColumn("_try", (F.lit(float(share)) * F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_gone")))
    first = F.min(F.when(F.col("_level") >= F.col("_try"), F.struct("_level", "_try"))).over(every)
    # when even all caps together are too little, every source is taken cap times
    return t.withColumn("target", F.coalesce(F.least(F.col("_cap"), first["_try"] * F.col("_w")), F.col("_cap"))).select(
        "_source", "source_size", "target"
    )


def _targets_by_rounds(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """As :func:`source_targets`, for any number of sources: places by range-partitioned running counts, the level by sums.

    Every round caps the sources that the level of the last one caps, and shares the rest again. The level only rises, so
    the capped ones only grow in number, and the rounds end when none is added.
    """
    named = sizes.select("_source", "source_size", F.col("_source").isNull().alias("_none"), F.lit(1).cast("long").alias("_one"))
    placed = running_total(named, [], ["_none", "_source"], "_one", "_place")
    t = placed.select("_source", "source_size", _nth(weights, (F.col("_place") - 1) % len(weights)).alias("_w"), (F.col("source_size") * F.lit(float(cap))).alias("_cap"))
    t = stage(t, "mix-places")
    words, weight = t.agg(F.sum("source_size"), F.sum("_w")).first()
    level, capped = share * words / weight, 0
    while True:
        under = t.where(F.col("_cap") / F.col("_w") < F.lit(level))
        n, taken, gone = under.agg(F.count("*"), F.coalesce(F.sum("_cap"), F.lit(0.0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
        if n == capped:
            break
        # when even all caps together are too little, every source is taken cap times
        level, capped = (share * words - taken) / (weight - gone) if gone < weight else float("inf"), n
    return t.select("_source", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_w")).alias("target"))


def _draw(key: str) -> Iterator[float]:
    """Numbers in [0, 1) that depend on the key alone."""
    block = 0
    while True:
        digest = hashlib.blake2b(f"{key}:{block}".encode(), digest_size=64).digest()
        yield from (int.from_bytes(digest[i : i + 8], "big") / 2.0**64 for i in range(0, 64, 8))
        block += 1


def _step(p: list[float], u: list[float], draw: float) -> list[float]:
    """Move along the null space until a probability is 0 or 1, either way at odds that keep the mean."""
    up = min(((1 - a) / b if b > 0 else a / -b) for a, b in zip(p, u) if b)
    down = min((a / b if b > 0 else (1 - a) / -b) for a, b in zip(p, u) if b)
    move = up if draw * (up + down) < down else -down
    moved = [a + move * b for a, b in zip(p, u)]
    return [0.0 if a < _EPS else 1.0 if a > 1 - _EPS else a for a in moved]


def _settle_heavy(p: np.ndarray, z: np.ndarray, c: np.ndarray, draws: Iterator[float], heavy: float) -> None:
    """Settle the units that hold over ``heavy`` of all words, each against all open others at once.

    Three at a time, a long document would barely move and stay for the landing. The
    direction moves it by one and the others by a share of the room they have, so that words and
    documents stay balanced.
    """
    limit = heavy * float(z.sum())
    for k in np.argsort(-z, kind="stable"):
        if z[k] <= limit:
            break
        while 0 < p[k] < 1:
            room = np.minimum(p, 1 - p)
            room[k] = 0.0
            m = np.array([[(room * c * c).sum(), (room * c * z).sum()], [(room * c * z).sum(), (room * z * z).sum()]])
            if np.linalg.det(m) <= _EPS * max(1.0, m[0, 0] * m[1, 1]):
                return  # too few others, or all of one length
            a, b = np.linalg.solve(m, [-c[k], -z[k]])
            u = room * (a * c + b * z)
            u[k] = 1.0
            moving = np.flatnonzero(u)
            p[moving] = _step(p[moving].tolist(), u[moving].tolist(), next(draws))


def flight(sizes: np.ndarray, counts: np.ndarray, chances: np.ndarray, key: str, land: bool, heavy: float = 0.002) -> np.ndarray:
    """Cube method on one block: chances moved to 0 or 1 with balanced words and documents.

    Two units at most stay in between (those of equal words per document move on without
    the other balance). With ``land`` these are rounded together with a dozen units of all lengths that the flight
    leaves out: of all roundings the one that comes nearest to the balances, words before documents. For
    these few units nearness goes before their exact chance.
    """
    moved, draws = chances.astype(float), _draw(key)
    z, c = sizes.astype(float), counts.astype(float)
    goal = (float(moved @ z), float(moved @ c))
    _settle_heavy(moved, z, c, draws, heavy)
    between = np.flatnonzero((moved > 0) & (moved < 1))
    spared = set(between[np.unique(np.linspace(0, len(between) - 1, _LANDING).astype(int))].tolist()) if land and len(between) else set()
    p, z, c, open_ = moved.tolist(), z.tolist(), c.tolist(), []
    waiting = (k for k in range(len(p)) if k not in spared)
    while True:
        while len(open_) < 3 and (k := next(waiting, None)) is not None:
            if 0 < p[k] < 1:
                open_.append(k)
        if len(open_) < 3:
            break
        # the null vector of the matrix of words and documents, in three units
        a, b, d = open_
        u = [z[b] * c[d] - z[d] * c[b], z[d] * c[a] - z[a] * c[d], z[a] * c[b] - z[b] * c[a]]
        if not any(u):
            u = [c[b], -c[a], 0.0]
        for k, v in zip(open_, _step([p[k] for k in open_], u, next(draws))):
            p[k] = v
        open_ = [k for k in open_ if 0 < p[k] < 1]
    if len(open_) == 2:
        a, b = open_
        if z[a] * c[b] == z[b] * c[a]:
            for k, v in zip(open_, _step([p[a], p[b]], [c[b], -c[a]], next(draws))):
                p[k] = v
            open_ = [k for k in open_ if 0 < p[k] < 1]
    if land and (rest := sorted({*open_, *spared})):
        out = np.array(p)
        out[rest] = 0.0
        trials = np.arange(1 << len(rest))[:, None] >> np.arange(len(rest)) & 1
        off = [np.abs(g - out @ np.array(v) - trials @ np.array(v)[rest]) for g, v in zip(goal, (z, c))]
        word = max(goal[0], 1.0) / max(goal[1], 1.0)
        out[rest] = trials[int(np.argmin(off[0] / word + 0.05 * off[1]))]
        return out
    return np.array(p)


def _fly(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # long documents first: the shorter ones that follow settle them, and what stays open is short
        weight = pdf["_words"] * pdf["_rows"]
        pdf = pdf.assign(_weight=-weight).sort_values(["_weight", "_order", "_order2"], kind="stable", ignore_index=True).drop(columns="_weight")
        key = f"{seed}:{pdf['_s1'].iat[0]}:{pdf['_level'].iat[0]}:{pdf['_bucket'].iat[0]}"
        land = bool(pdf["_buckets"].iat[0] == 1)
        pdf["_chance"] = flight(pdf["_words"].to_numpy() * pdf["_rows"].to_numpy(), pdf["_rows"].to_numpy(), pdf["_chance"].to_numpy(), key, land)
        return pdf

    return run


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    share: float = 1.0,
    cap: float = 3.0,
    bucket_rows: int = 4096,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often each document is taken so that sources get their shares of all words.

    Returns one row per distinct document (see :func:`keyed`): ``_id _mark _rows`` (equal
    rows it stands for), ``source size source_size target copies``. A document of a source
    with target t and size s is expected t / s times: the whole part is taken outright, the
    fraction is settled by the cube method, balancing words and documents of the source.

    Sources are dealt over blocks of about ``bucket_rows`` documents. Each block moves its
    chances through the null space of the two balances and leaves two of them open at most;
    open ones meet again in fewer blocks until one block per source is left, which lands.
    So a source with a third of all rows spreads over many tasks, and the error of a source
    is that of its last landing. All draws come from hashes: reruns agree.

    A missing text has size 0, and so has an empty one: such documents count as documents
    but have no words. Sources without words have target 0. Equal rows share one decision. A very long text counts with
    all its words; one that holds over a five-hundredth of its block's words is settled first, against all others.
    """
    require_columns(docs, [id_col, text_col, source_col])
    base = docs.select(col(id_col).alias("_id"), mark_of(docs, text_col).alias("_mark"), col(source_col).cast("string").alias("_source"), word_count(F.coalesce(col(text_col), F.lit(""))).alias("_words"))
    units = stage(base.groupBy("_id", "_mark", "_source", "_words").agg(F.count("*").alias("_rows")), "mix-units")
    sizes = units.groupBy("_source").agg(F.sum(F.col("_words") * F.col("_rows")).alias("source_size"), F.count("*").alias("_units"))
    sizes = stage(sizes, "mix-sizes")
    sources = source_targets(sizes.select("_source", "source_size"), weights, share, cap).join(
        sizes.select(F.col("_source").alias("_s"), "_units"), F.col("_source").eqNullSafe(F.col("_s"))
    )
    name = [F.xxhash64(F.lit(k), F.col("_source").isNull(), F.col("_source")).alias(f"_s{k}") for k in (1, 2)]
    sources = stage(sources.select(*name, "source_size", "target", "_units"), "mix-targets")
    spread = units.select("*", *name)
    if sources.count() <= BROADCAST_SOURCES:
        state = spread.join(F.broadcast(sources), ["_s1", "_s2"])
    else:
        state = split_join(spread, sources.drop("_s2"), "_s1")
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    near = F.round(expected)
    expected = F.when(F.abs(expected - near) < _EPS, near).otherwise(expected)
    state = state.withColumn("_whole", F.floor(expected)).withColumn("_chance", expected - F.col("_whole"))
    state = state.select(
        "_id", "_mark", "_rows", "_source", "_words", "source_size", "target", "_s1", "_s2", "_whole", "_chance", "_units",
        F.xxhash64(F.lit(seed), F.col("_id").isNull(), "_id", "_mark").alias("_order"), F.xxhash64(F.lit(seed + 1), "_id", "_mark").alias("_order2"),
    )
    done, level = None, 0
    while True:
        buckets = F.ceil(F.col("_units") / F.lit(bucket_rows)).cast("int")
        # an own hash of the order for every level, or a block would meet its own leftovers again
        dealt = state.withColumn("_buckets", buckets).withColumn("_level", F.lit(level)).withColumn(
            "_bucket", F.pmod(F.xxhash64(F.lit(level), "_order"), F.col("_buckets")).cast("int")
        )
        flown = dealt.groupBy("_s1", "_s2", "_bucket").applyInPandas(_fly(seed), dealt.schema)
        flown = stage(flown, f"mix-level{level}")
        settled = flown.where((F.col("_chance") <= 0) | (F.col("_chance") >= 1))
        done = settled if done is None else done.unionByName(settled)
        left = flown.where((F.col("_chance") > 0) & (F.col("_chance") < 1))
        counts = left.groupBy("_s1", "_s2").agg(F.count("*").alias("_units"))
        most = counts.agg(F.max("_units")).first()[0]
        if not most:
            break
        # blocks of a source leave two units each: at most 2 / bucket_rows of what came in
        widest = counts.agg(F.count("*")).first()[0]
        joined = left.drop("_units", "_buckets", "_level", "_bucket")
        state = joined.join(F.broadcast(counts), ["_s1", "_s2"]) if widest <= BROADCAST_SOURCES else split_join(joined, counts.drop("_s2"), "_s1")
        level += 1
    return done.select(
        "_id", "_mark", "_rows", F.col("_source").alias("source"), F.col("_words").alias("size"), "source_size", "target",
        (F.col("_whole") + F.round("_chance")).cast("long").alias("copies"),
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix_sources` takes it, all its columns kept.

    Columns of ``docs`` may have any names: those used inside give way.
    """
    plan = mix_sources(docs, id_col=id_col, text_col=text_col, **options)
    mix_id, mix_mark, copies, nth = (fresh(n, docs.columns) for n in ("_mix_id", "_mix_mark", "_mix_copies", "_mix_nth"))
    plan = plan.where("copies > 0").select(F.col("_id").alias(mix_id), F.col("_mark").alias(mix_mark), F.col("copies").alias(copies))
    ident = docs["`" + id_col.replace("`", "``") + "`"]
    hit = ident.eqNullSafe(F.col(mix_id)) & (mark_of(docs, text_col) == F.col(mix_mark))
    # never broadcast: the list grows with the documents
    joined = docs.join(plan.hint("shuffle_hash"), hit)
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[joined["`" + c.replace("`", "``") + "`"] for c in docs.columns])
