"""Vector kernels, and matching where one side fits into a broadcast or all pairs of blocks are wanted.

A small right side, of checked size, is broadcast as one matrix. Scores are inner products, rounded so
that equal vectors tie. Larger sides are matched by :mod:`semtab.operators.metric`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 2048
#: Left rows and rows of a held right side that are scored at once.
STEP, HELD_TILE = 1_024, 4_096
SLACK = 1e-6

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


def matrix(rows) -> np.ndarray:
    """Rows of float arrays as one float64 matrix."""
    return np.stack([np.asarray(r, dtype=np.float64) for r in rows]) if len(rows) else np.zeros((0, 0))


def arrow_matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All products, rounded so that equal vectors tie exactly."""
    return np.round(left @ right.T, 10)


def rough_products(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float] | None:
    """All products in 32-bit floats, and how far from the exact ones they may be; None where a number is missing or too large."""
    longest = np.sqrt((left * left).sum(axis=1).max(initial=0.0)) * np.sqrt((right * right).sum(axis=1).max(initial=0.0))
    if not longest < 1e15:
        return None
    return left.astype(np.float32) @ right.astype(np.float32).T, 2.0**-22 * (left.shape[1] + 4) * longest + 1e-9


def some_products(left: np.ndarray, right: np.ndarray, li: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """The products of :func:`inner_products` for some pairs of rows."""
    parts = [np.einsum("ij,ij->i", left[li[at : at + 16_384]], right[ri[at : at + 16_384]]) for at in range(0, len(li), 16_384)]
    return np.round(np.concatenate(parts), 10) if parts else np.zeros(0)


def near_pairs(left: np.ndarray, right: np.ndarray, floor: float) -> np.ndarray:
    """Which products are above ``floor``; only those too near to it for 32-bit floats are worked out exactly."""
    rough = rough_products(left, right)
    if rough is None:
        return inner_products(left, right) > floor
    s, off = rough
    off += abs(floor) * 2.0**-22
    near = s > np.float32(floor - off)
    li, ri = np.nonzero(near & (s <= np.float32(floor + off)))
    near[li, ri] = some_products(left, right, li, ri) > floor
    return near


def best_pairs(left: np.ndarray, right: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows of both sides and their exact products: the ``k`` best of each left row and few more, or what reaches its ``floor``.

    None where a number is missing, or where many products tie.
    """
    rough = rough_products(left, right)
    if rough is None:
        return None
    s, off = rough
    if floor is None:
        n = s.shape[1]
        least = (np.partition(s, n - k, axis=1)[:, n - k] if k < n else s.min(axis=1)) - np.float32(2 * off)
    else:
        least = (floor - off - np.abs(floor) * 2.0**-22).astype(np.float32)
    li, ri = np.nonzero(s >= least[:, None])
    if floor is None and len(li) > 8 * k * len(s) + 1_000:
        return None
    score = some_products(left, right, li, ri)
    if floor is not None:
        kept = score >= floor[li]
        li, ri, score = li[kept], ri[kept], score[kept]
    return li, ri, score


def dot_column(vector: Column, query) -> Column:
    """Inner product of a vector column with one query vector."""
    q = np.asarray(query, dtype=np.float64)

    def run(vectors: pa.Array) -> pa.Array:
        return pa.array(np.round(arrow_matrix(vectors) @ q, 10) if len(vectors) else np.zeros(0))

    run.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.DoubleType())(vector)


# --- kernels: what one block of left rows yields against one block of right rows ---


def best(k: int) -> Kernel:
    """The ``k`` highest products of every left row; ties by right key."""

    def kernel(lk, left, rk, right):
        order = np.argsort(rk, kind="stable")
        rk, right = rk[order], right[order]
        few = best_pairs(left, right, k)
        if few is not None:
            li, ri, score = few
            order = np.lexsort((ri, -score, li))
            li, ri, score = li[order], ri[order], score[order]
            place = np.arange(len(li)) - np.searchsorted(li, li)
            return pd.DataFrame({"_lk": lk[li], "_rk": rk[ri], "_score": score})[place < k]
        s = inner_products(left, right)
        n = min(k, s.shape[1])
        if n < s.shape[1]:
            floor = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        else:
            floor = s.min(axis=1)
        li, ri = [], []
        for i in range(len(s)):
            near = np.flatnonzero(s[i] >= floor[i])
            near = near[np.argsort(-s[i, near], kind="stable")[:n]]
            li.append(np.full(len(near), i))
            ri.append(near)
        li, ri = np.concatenate(li), np.concatenate(ri)
        return pd.DataFrame({"_lk": lk[li], "_rk": rk[ri], "_score": s[li, ri]})

    return kernel


def above(floor: float) -> Kernel:
    """All pairs with a product above ``floor``."""

    def kernel(lk, left, rk, right):
        s = inner_products(left, right)
        li, ri = np.nonzero(s > floor)
        return pd.DataFrame({"_lk": lk[li], "_rk": rk[ri], "_score": s[li, ri]})

    return kernel


def links(floor: float) -> Kernel:
    """Stars that connect what products above ``floor`` connect inside the block.

    A block of near copies yields one edge per row, not one per pair.
    """

    def kernel(lk, left, rk, right):
        # a name needs no link to itself
        near = near_pairs(left, right, floor) & (lk[:, None] != rk[None])
        open_left = near.any(axis=1)
        roots, members = [], []
        for start in np.flatnonzero(open_left):
            if not open_left[start]:
                continue
            in_left = np.zeros(len(lk), dtype=bool)
            in_right = np.zeros(len(rk), dtype=bool)
            frontier = np.array([start])
            while len(frontier):
                in_left[frontier] = True
                fresh = near[frontier].any(axis=0) & ~in_right
                in_right |= fresh
                frontier = np.flatnonzero(near[:, fresh].any(axis=1) & ~in_left)
            open_left &= ~in_left
            names = np.unique(np.concatenate([lk[in_left], rk[in_right]]))
            if len(names) > 1:
                roots.append(np.full(len(names) - 1, names[0], dtype=object))
                members.append(names[1:])
        if not roots:
            return pd.DataFrame({"_u": [], "_v": []}, dtype=object)
        return pd.DataFrame({"_u": np.concatenate(members), "_v": np.concatenate(roots)})

    return kernel


NO_LINKS = pd.DataFrame({"_u": [], "_v": []}, dtype=object)


def links_by_bounds(floor: float, dim: int) -> Kernel:
    """Like :func:`links` for rows of ``dim`` numbers, then fewer whose products are at least as large as those of the rows.

    Pairs are ruled out by the fewer numbers; where few remain, a link each is returned.
    """
    stars = links(floor)

    def kernel(lk, left, rk, right):
        rows = np.arange(len(lk))
        for part in (slice(dim, None), slice(dim)):
            rough = rough_products(left[rows, part], right[:, part])
            if rough is None:
                break
            s, off = rough
            least = np.float32(floor - off - abs(floor) * 2.0**-22)
            some = np.flatnonzero(s.max(axis=1) > least)
            rows, near = rows[some], np.flatnonzero(s[some] > least)
            if not len(near):
                return NO_LINKS
            if len(near) <= 8 * (len(lk) + len(rk)):
                li, ri = rows[near // len(rk)], near % len(rk)
                kept = some_products(left[:, :dim], right[:, :dim], li, ri) > floor
                u, v = lk[li[kept]], rk[ri[kept]]
                return pd.DataFrame({"_u": np.maximum(u, v), "_v": np.minimum(u, v)})[u != v]
        return stars(lk[rows], left[rows, :dim], rk, right[:, :dim])

    return kernel


# --- sizes -----------------------------------------------------------------


def measure(vectors: DataFrame, vec: str) -> tuple[int, int, float]:
    """Rows, dimension and largest squared length of a vector table, in one pass."""

    def run(v: pa.Array) -> pa.Array:
        m = arrow_matrix(v)
        return pa.array(np.nan_to_num((m * m).sum(axis=1)) if len(m) else np.zeros(0))

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    square = F.arrow_udf(run, T.DoubleType())
    row = vectors.agg(
        F.count("*").alias("n"), F.max(F.size(vec)).alias("d"), F.max(square(F.col(vec))).alias("m")
    ).first()
    return row["n"], row["d"] or 0, row["m"] or 0.0


def fits_broadcast(rows: int, dim: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * (dim * 8 + 64) <= limit


def every_block(
    left: DataFrame, right: DataFrame, kernel: Kernel, schema: T.StructType,
    broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS,
    measured: tuple[int, int, float] | None = None,
) -> DataFrame:
    """Run a kernel that returns totals over all blocks of left against right rows."""
    n, dim, _ = measured or measure(right, "_rv")
    if fits_broadcast(n, dim, broadcast_bytes):
        return match_broadcast(left, right, kernel, schema)
    nl, nr = -(-max(left.count(), 1) // block_rows), -(-n // block_rows)

    def chunk(key: str, count: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(count).cast("long"))

    def copies(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    l = left.select("_lk", "_lv", chunk("_lk", nl).alias("_a"), copies(nr).alias("_b"))
    r = right.select("_rk", "_rv", chunk("_rk", nr).alias("_b"), copies(nl).alias("_a"))
    return l.groupBy("_a", "_b").cogroup(r.groupBy("_a", "_b")).applyInPandas(_block_runner(kernel, schema), schema)


def hits_schema(left_key: T.DataType, right_key: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("_lk", left_key), T.StructField("_rk", right_key),
                         T.StructField("_score", T.DoubleType())])


def _block_runner(kernel: Kernel, schema: T.StructType):
    def run(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return pd.DataFrame({f.name: [] for f in schema})
        return kernel(lp["_lk"].to_numpy(), matrix(lp["_lv"]), rp["_rk"].to_numpy(), matrix(rp["_rv"]))

    return run


def match_broadcast(left: DataFrame, right: DataFrame, kernel: Kernel, schema: T.StructType) -> DataFrame:
    """Run ``kernel`` with the whole right side, of checked size, in every task; nothing is shuffled."""
    held = held_matrix(right)
    shared = left.sparkSession.sparkContext.broadcast(held)
    step = max(1, 4_000_000 // max(len(held[0]), 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rk, r = shared.value
        if not len(rk):
            return
        for pdf in batches:
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                yield kernel(part["_lk"].to_numpy(), matrix(part["_lv"]), rk, r)

    return left.select("_lk", "_lv").mapInPandas(run, schema)


def held_matrix(right: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a right side of checked size."""
    table = right.select("_rk", "_rv").toArrow()
    return table["_rk"].to_pandas().to_numpy(), arrow_matrix(pa.concat_arrays(table["_rv"].chunks)) if len(
        table) else np.zeros((0, 0))


def best_held(m: np.ndarray, rk: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``m``, of a right side sorted by key, and their products: the ``k`` best, by tiles that keep what they need small."""
    kernel = best(k)
    # a missing number of the right side counts among the best of what is scored with it, so all is scored at once then
    tile = HELD_TILE if np.isfinite(r).all() else len(r)
    floor = np.full(len(m), -np.inf)
    li, ri, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(r), tile):
        some = r[at : at + tile]
        few = best_pairs(m, some, k, floor if np.isfinite(floor).all() else None) if tile == HELD_TILE else None
        if few is None or len(few[0]) > 8 * k * len(m) + 1_000:
            hits = kernel(np.arange(len(m)), m, np.arange(len(some)), some)
            few = hits["_lk"].to_numpy(np.int64), hits["_rk"].to_numpy(np.int64), hits["_score"].to_numpy(float)
        li, ri, score = np.concatenate([li, few[0]]), np.concatenate([ri, few[1] + at]), np.concatenate([score, few[2]])
        order = np.lexsort((ri, -score, li))
        li, ri, score = li[order], ri[order], score[order]
        place = np.arange(len(li)) - np.searchsorted(li, li)
        floor[li[place == k - 1]] = score[place == k - 1]
        li, ri, score = li[place < k], ri[place < k], score[place < k]
    return li, ri, score


def hits_column(vector: Column, right: DataFrame, k: int, key_type: T.DataType) -> Column:
    """The ``k`` best rows of a right side of checked size, as an array of ``_rk _score`` for every vector."""
    keys, rows = held_matrix(right)
    order = np.argsort(keys, kind="stable")
    shared = right.sparkSession.sparkContext.broadcast((keys[order], rows[order]))
    arrow_key = to_arrow_type(key_type)

    def run(vectors: pa.Array) -> pa.Array:
        rk, r = shared.value
        shape = pa.struct([("_rk", arrow_key), ("_score", pa.float64())])
        if not len(rk) or not len(vectors):
            return pa.array([[] for _ in range(len(vectors))], pa.list_(shape))
        parts = []
        step = STEP if np.isfinite(r).all() else max(1, 4_000_000 // len(r))
        for at in range(0, len(vectors), step):
            li, ri, score = best_held(arrow_matrix(vectors.slice(at, step)), rk, r, k)
            parts.append((li + at, ri, score))
        li, ri, score = (np.concatenate(x) for x in zip(*parts))
        # a vector with a missing number has no hits, so rows differ in their number
        ends = np.concatenate([[0], np.bincount(li, minlength=len(vectors)).cumsum()])
        values = pa.StructArray.from_arrays([pa.array(rk[ri], arrow_key), pa.array(score)], ["_rk", "_score"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    run.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    shape = T.StructType([T.StructField("_rk", key_type), T.StructField("_score", T.DoubleType())])
    return F.arrow_udf(run, T.ArrayType(shape))(vector)


def top_per_left(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("_lk").orderBy(F.desc("_score"), F.asc("_rk"))
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
