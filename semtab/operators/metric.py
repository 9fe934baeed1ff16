"""Similarity matching beyond a broadcast: a two-level tree of pivots, or sign buckets, and blocks of neighbouring rows.

The right rows are dealt into cells, the left rows into blocks of neighbours of bounded size. A plan
table says which cells a block has to visit. One task holds one block at a time and reads the right rows of its
cells as a stream: a left row is sent once per round, pairs never leave the task, and memory does not
grow with a cell. The number of cells grows with the square root of the right side. A right row is sent to each block that
visits its cell, so there are no more blocks than keep the cores busy until a block's vectors fill what a task may hold.

* :class:`Tree` is exact. A cell is skipped if the triangle inequality, or the plane between its
  pivot and the row's own one, keeps all of its rows too far away; whole branches of cells are skipped by their top pivot first.
* :class:`Buckets` is approximate. Cells are the sign patterns of some random orthogonal directions; a row visits
  patterns in the order of their chance to hold a neighbour, until the chances add up to the wanted recall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from semtab.operators.vectors import BROADCAST_BYTES, SLACK, Kernel, arrow_matrix, best, best_pairs, fits_broadcast, inner_products, links_by_bounds, match_broadcast, matrix, measure
from semtab.runtime import stage

#: Left rows of a block, if there are no more blocks than tasks for the cores; else blocks are larger, up to some bytes of vectors.
BLOCK_ROWS, BLOCKS_PER_CORE, HELD_BYTES = 8_192, 2, 64 << 20
#: Left rows whose cells are looked up at once, and names that a task's forest remembers.
LOOKED_UP, FOREST_NAMES = 1_024, 1_000_000
#: Cells for the square root of n right rows, and cells at most: the table of pivots is a few dozen MB then.
CELLS_PER_ROOT, MAX_CELLS = 8, 16_384
MAX_BITS = 12
#: Right rows that are scored at once, and rows of a plan up to which it is broadcast.
TILE, PLAN_ROWS = 4_096, 2_000_000
#: For links: rows of a leaf and times that leaves are halved at most, sampled rows for each leaf, directions, and rows of a tile.
LEAF_ROWS, HALVINGS, SAMPLED, DIRECTIONS, LINK_ROWS = 8, 12, 8, 32, 2_048
_HOME = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()), T.StructField("far_top", T.DoubleType())])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0.0))


class Tree:
    """Right rows around leaf pivots, leaf pivots around top pivots; vectors are lifted so that a larger product is a smaller distance."""

    #: The share of a block's rows that visit a cell from which on it is scored for all of them.
    wide = 0.5

    def __init__(self, right: DataFrame, rows: int, longest: float) -> None:
        self.longest = longest
        wanted = int(min(MAX_CELLS, max(1, ceil(CELLS_PER_ROOT * sqrt(rows))), max(1, rows // 4)))
        chosen = right.orderBy(F.xxhash64("_rk")).limit(wanted).select("_rv").collect()
        pivots = np.unique(self.lift(matrix([r[0] for r in chosen])), axis=0)
        pivots = pivots[np.isfinite(pivots).all(axis=1)] if np.isfinite(pivots).all(axis=1).any() else np.zeros_like(pivots[:1])
        self.dim = pivots.shape[1] - 1
        draw = np.random.default_rng(0).permutation(len(pivots))
        self.tops = pivots[draw[: ceil(sqrt(len(pivots)))]]
        top_of = _distances(pivots, self.tops).argmin(axis=1)
        order = np.argsort(top_of, kind="stable")
        self.leaves, top_of = pivots[order], top_of[order]
        self.first = np.searchsorted(top_of, np.arange(len(self.tops) + 1))
        self.counts = np.zeros(len(self.leaves))
        self.radii = np.zeros(len(self.leaves))
        self.top_radii = np.zeros(len(self.tops))

    def lift(self, m: np.ndarray, flat: bool = False) -> np.ndarray:
        rest = np.zeros(len(m)) if flat else np.sqrt(np.maximum(self.longest - (m * m).sum(axis=1), 0.0))
        return np.column_stack([m, rest])

    def find(self, m: np.ndarray, flat: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest leaf of each row, and its distance to the pivots of the leaf and of the leaf's top."""
        lifted = self.lift(m, flat)
        leaf, far = np.zeros(len(m), np.int32), np.zeros(len(m))
        step = max(1, 4_000_000 // len(self.leaves))
        for at in range(0, len(m), step):
            d = _distances(lifted[at : at + step], self.leaves)
            leaf[at : at + step], far[at : at + step] = d.argmin(axis=1), d.min(axis=1)
        top = self.tops[np.searchsorted(self.first, leaf, side="right") - 1]
        # a vector with a missing number matches nothing, so it widens no cell
        return leaf, np.nan_to_num(far), np.nan_to_num(np.sqrt(((lifted - top) ** 2).sum(axis=1)))

    def learn(self, found: list) -> None:
        for r in found:
            self.counts[r["cell"]], self.radii[r["cell"]] = r["n"], r["r"]
            t = np.searchsorted(self.first, r["cell"], side="right") - 1
            self.top_radii[t] = max(self.top_radii[t], r["rt"])

    def first_cells(self, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of row and cell: each row's own leaf, and further ones until they hold ``k`` rows."""
        leaf = self.find(m, flat=True)[0]
        rows, cells = [np.arange(len(m))], [leaf]
        lifted = self.lift(m, flat=True)
        for i in np.flatnonzero(self.counts[leaf] < k):
            d = _distances(lifted[i : i + 1], self.leaves)[0]
            order = np.argsort(np.where(self.counts > 0, d, np.inf), kind="stable")
            n = min(len(order), int(np.searchsorted(self.counts[order].cumsum(), k)) + 1)
            take = order[:n][self.counts[order[:n]] > 0]
            rows.append(np.full(len(take), i))
            cells.append(take.astype(np.int32))
        return np.concatenate(rows), np.concatenate(cells)

    def needed_cells(self, m: np.ndarray, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of row and cell for all cells that can hold a product of ``floor`` or more, one top pivot after the other."""
        lifted = self.lift(m, flat=True)
        reach = np.sqrt(np.maximum((lifted**2).sum(axis=1) + self.longest - 2 * floor, 0.0)) + SLACK
        leaf, far, _ = self.find(m, flat=True)
        outer = _distances(lifted, self.tops) - self.top_radii[None]
        for t in range(len(self.tops)):
            a, b = self.first[t], self.first[t + 1]
            alive = np.flatnonzero(outer[:, t] <= reach)
            if not len(alive) or a == b:
                continue
            inner = _distances(lifted[alive], self.leaves[a:b])
            gaps = _distances(self.leaves[leaf[alive]], self.leaves[a:b])
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(gaps > 0, (inner**2 - far[alive][:, None] ** 2) / (2 * gaps), 0.0)
            least = np.maximum(plane, inner - self.radii[None, a:b])
            least[:, self.counts[a:b] == 0] = np.inf
            row, cell = np.nonzero(least <= reach[alive][:, None])
            yield alive[row], (cell + a).astype(np.int32)


def _normal_below(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by a polynomial that errs by less than 1e-7."""
    z = np.abs(x) / sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z) / 2
    return np.where(x < 0, tail, 1 - tail)


class Buckets:
    """Right rows by the signs of their products with random orthogonal directions.

    A neighbour of similarity ``s`` differs from the row in the sign of a direction by a chance that falls with the
    row's own product there. The chances multiply to those of whole patterns, which are visited in falling
    order until their sum is ``recall``: as the floor is the worst hit so far, that holds for neighbours as near as it,
    and more for nearer ones.
    """

    #: Only cells that all rows visit: which pairs a row meets decides its hits here.
    wide = 1.0

    def __init__(self, right: DataFrame, rows: int, longest: float, dim: int, recall: float, seed: int = 0) -> None:
        self.longest, self.dim, self.recall = longest, dim, recall
        self.bits = int(max(1, min(MAX_BITS, dim, round(np.log2(max(2.0, CELLS_PER_ROOT * sqrt(rows)))) - 1)))
        turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
        self.turn = turn[:, : self.bits]
        self.counts = np.zeros(1 << self.bits)

    def _cells(self, turned: np.ndarray) -> np.ndarray:
        return ((turned > 0) << np.arange(self.bits)).sum(axis=1).astype(np.int32)

    def find(self, m: np.ndarray, flat: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._cells(m @ self.turn), np.zeros(len(m)), np.zeros(len(m))

    def learn(self, found: list) -> None:
        for r in found:
            self.counts[r["cell"]] = r["n"]

    def _chances(self, m: np.ndarray, similarity: np.ndarray) -> np.ndarray:
        """Per row and pattern: the chance that a neighbour of this similarity has it."""
        length = np.sqrt((m * m).sum(axis=1))
        q = (m @ self.turn) / np.where(length > 0, length, 1)[:, None]
        s = np.clip(similarity, -0.999999, 0.999999)[:, None]
        spread = np.sqrt((1 - s * s) * np.maximum(1 - q * q, 1e-12) / max(1, self.dim - 1))
        above = _normal_below(s * q / spread)  # the neighbour's product is positive
        chance = np.ones((len(m), 1))
        for bit in range(self.bits):
            up = above[:, bit : bit + 1]
            chance = np.concatenate([chance * (1 - up), chance * up], axis=1)
        return chance

    def _until(self, chance: np.ndarray, enough: Callable) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-np.where(self.counts > 0, chance, -1.0), axis=1, kind="stable")
        full = self.counts[order] > 0
        take = enough(order) & full
        row, place = np.nonzero(take)
        return row, order[row, place].astype(np.int32)

    def first_cells(self, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        def enough(order: np.ndarray) -> np.ndarray:
            held = self.counts[order]
            return held.cumsum(axis=1) - held < k

        return self._until(self._chances(m, np.full(len(m), 0.5)), enough)

    def needed_cells(self, m: np.ndarray, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        length = np.sqrt((m * m).sum(axis=1) * self.longest)
        similarity = np.where(np.isfinite(floor), floor, -1.0) / np.where(length > 0, length, 1)
        chance = self._chances(m, similarity)

        def enough(order: np.ndarray) -> np.ndarray:
            sorted_chance = np.take_along_axis(chance, order, axis=1)
            return (sorted_chance.cumsum(axis=1) - sorted_chance < self.recall) | ~np.isfinite(floor)[:, None]

        yield self._until(chance, enough)


class Splits:
    """Rows in leaves by halving them along the directions in which they spread most; both sides of links are the same rows.

    Linked rows are near each other, and nearer yet in these directions, so leaves, or tiles of rows, whose boxes are too far apart
    hold no link. Directions and halves are learnt from some rows, which decides how much is skipped, not what is found.
    """

    def __init__(self, rows: DataFrame, n: int, longest: float) -> None:
        self.longest = longest
        halvings = int(min(HALVINGS, max(0.0, log2(max(1, n // LEAF_ROWS)))))
        chosen = rows.orderBy(F.xxhash64("_rk")).limit(max(1_024, SAMPLED << halvings)).select("_rv").toArrow()["_rv"]
        m = arrow_matrix(pa.concat_arrays(chosen.chunks))
        m = m[np.isfinite(m).all(axis=1)] if np.isfinite(m).all(axis=1).any() else np.zeros_like(m[:1])
        self.dim = m.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            spread = (m - m.mean(axis=0)).T @ (m - m.mean(axis=0))
        turn = np.linalg.eigh(spread)[1][:, ::-1] if np.isfinite(spread).all() else np.eye(self.dim)
        self.turn = turn[:, : min(DIRECTIONS, self.dim)]
        p = m @ self.turn
        inner = (1 << halvings) - 1
        self.axis, self.middle = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full((2 * inner + 1, p.shape[1]), -np.inf), np.full((2 * inner + 1, p.shape[1]), np.inf)
        members = [np.arange(len(p))]
        for node in range(inner):
            some = p[members[node]]
            if len(some):
                self.axis[node] = axis = some.var(axis=0).argmax()
                self.middle[node] = np.median(some[:, axis])
            axis, middle = self.axis[node], self.middle[node]
            above = some[:, axis] > middle
            members += [members[node][~above], members[node][above]]
            for child in (2 * node + 1, 2 * node + 2):
                low[child], high[child] = low[node], high[node]
            high[2 * node + 1, axis] = min(high[node, axis], middle)
            low[2 * node + 2, axis] = max(low[node, axis], middle)
        self.low, self.high = low[inner:], high[inner:]
        self.counts = np.zeros(inner + 1)

    def find(self, m: np.ndarray, flat: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, node = m @ self.turn, np.zeros(len(m), np.int64)
        while len(self.axis) and node.min(initial=len(self.axis)) < len(self.axis):
            node = 2 * node + 1 + (p[np.arange(len(m)), self.axis[node]] > self.middle[node])
        return (node - len(self.axis)).astype(np.int32), np.zeros(len(m)), np.zeros(len(m))

    def learn(self, found: list) -> None:
        for r in found:
            self.counts[r["cell"]] = r["n"]

    def bounded(self, m: np.ndarray) -> np.ndarray:
        """The rows, and beside them their places along the directions and the length of what is left: products of these are no smaller."""
        p = m @ self.turn
        return np.column_stack([m, p, np.sqrt(np.maximum((m * m).sum(axis=1) - (p * p).sum(axis=1), 0.0))])

    def boxes(self, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least and largest places in each tile of :meth:`bounded` rows, and their largest squared lengths; a row with a missing number has no place."""
        p = rows[:, self.dim : -1]
        known = np.isfinite(p)
        low, high = np.minimum.reduceat(np.where(known, p, -np.inf), starts), np.maximum.reduceat(np.where(known, p, np.inf), starts)
        return low, high, np.fmax.reduceat((rows[:, : self.dim] ** 2).sum(axis=1), starts)

    def reach(self, floor: float, one, other) -> np.ndarray:
        """How far rows of these squared lengths may be apart if their product is above ``floor``."""
        apart = np.nan_to_num(np.maximum(np.asarray(one) + other - 2 * floor, 0.0), nan=np.inf, posinf=np.inf)
        return np.sqrt(apart) * (1 + 1e-9) + SLACK * max(1.0, sqrt(self.longest))

    @staticmethod
    def near(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, reach) -> np.ndarray:
        """Which of the boxes ``lows highs``, or rows where these are the same, are within ``reach`` of the box ``low high``."""
        gaps = np.maximum(np.maximum(lows - high, low - highs), 0.0)
        return np.flatnonzero(~((gaps * gaps).sum(axis=1) > np.square(reach)))


class Matcher:
    """Both sides laid out for matching: right rows by cell, left rows by block, both written once."""

    def __init__(self, left: DataFrame, right: DataFrame, index, block_rows: int) -> None:
        self.index = index
        self.right = stage(right.select("_rk", "_rv", self._home(F.col("_rv"), False).alias("_h")).select("_rk", "_rv", "_h"), "cells")
        index.learn(
            self.right.groupBy(F.col("_h.cell").alias("cell")).agg(F.count("*").alias("n"), F.max("_h.far").alias("r"), F.max("_h.far_top").alias("rt")).collect()
        )
        homes = stage(left.select("_lk", "_lv", self._home(F.col("_lv"), True)["cell"].alias("_home")), "homes")
        counts = np.zeros(len(index.counts), np.int64)
        for r in homes.groupBy("_home").count().collect():
            counts[r["_home"]] = r["count"]
        tasks = BLOCKS_PER_CORE * max(1, left.sparkSession.sparkContext.defaultParallelism)
        self.block_rows = max(block_rows, min(HELD_BYTES // (8 * max(1, index.dim)), -(-int(counts.sum()) // tasks)))
        self.begin, self.parts = self._deal(counts)
        self.blocks = int((self.begin + self.parts).max(initial=0))
        self.left = homes.withColumn("_block", self._block(F.col("_home"), F.xxhash64("_lk")))

    def _deal(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First block and number of blocks of each cell: small neighbouring cells share one, large ones are split."""
        begin, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        block = used = 0
        for cell, n in enumerate(counts.tolist()):
            if used and used + n > self.block_rows:
                block, used = block + 1, 0
            begin[cell], parts[cell] = block, max(1, -(-n // self.block_rows))
            block, used = (block + parts[cell], 0) if n >= self.block_rows else (block, used + n)
        return begin, parts

    def _home(self, vector: Column, flat: bool) -> Column:
        index = self.index

        def run(v: pa.Array) -> pa.Array:
            leaf, far, top = index.find(arrow_matrix(v), flat) if len(v) else (np.zeros(0, np.int32), np.zeros(0), np.zeros(0))
            return pa.StructArray.from_arrays([pa.array(leaf, pa.int32()), pa.array(far), pa.array(top)], _HOME.fieldNames())

        run.__annotations__ = {"v": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, _HOME)(vector)

    def _block(self, home: Column, key: Column) -> Column:
        begin, parts = self.begin, self.parts

        def run(h: pa.Array, k: pa.Array) -> pa.Array:
            cell = h.to_numpy(zero_copy_only=False)
            return pa.array(begin[cell] + np.mod(k.to_numpy(zero_copy_only=False), parts[cell]), pa.int64())

        run.__annotations__ = {"h": pa.Array, "k": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, T.LongType())(home, key)

    def plan(self, rows: DataFrame, k: int | None = None) -> DataFrame:
        """``_block _cell``: which cells the rows of each block visit; ``rows`` has ``_lv _block``, and ``_floor`` unless ``k`` is given."""
        index = self.index
        floor = F.lit(0.0) if k is not None else F.col("_floor")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m, block, least = arrow_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                found = (block[row] * len(index.counts) + cell for row, cell in _visits(index, m, least, k))
                for pairs in _distinct(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pairs // len(index.counts), pa.int64()), pa.array((pairs % len(index.counts)).astype(np.int32))], names=["_block", "_cell"]
                    )

        pairs = rows.select("_lv", "_block", floor.cast("double").alias("_floor")).mapInArrow(run, "_block long, _cell int")
        return stage(pairs.distinct(), "plan")

    def plan_links(self, floor: float) -> DataFrame:
        """``_block _cell``: which leaves a block meets. Of two blocks one is sent the other's rows; leaves of the block alone are settled in it."""
        index, begin, parts = self.index, self.begin, self.parts
        reach = index.reach(floor, index.longest, index.longest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for leaf in batch.column(0).to_pylist():
                    cells = index.near(index.low[leaf], index.high[leaf], index.low, index.high, reach)
                    cells = cells[index.counts[cells] > 0] if index.counts[leaf] else cells[:0]
                    for block in range(begin[leaf], begin[leaf] + parts[leaf]):
                        # by turns, so that blocks near many others share what they have in common
                        home = begin[cells]
                        mine = (home != block) & ((np.mod(home + block, 2) == 1) == (block < home)) | (parts[cells] > 1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(mine.sum(), block), pa.int64()), pa.array(cells[mine].astype(np.int32))], names=["_block", "_cell"])

        session = self.right.sparkSession
        leaves = session.range(0, len(index.counts), 1, max(1, min(len(index.counts), session.sparkContext.defaultParallelism)))
        return stage(leaves.mapInArrow(run, "_block long, _cell int").distinct(), "plan")

    def count(self, rows: DataFrame, k: int) -> int:
        """Pairs of rows that both rounds score."""
        index = self.index

        def run(m: pa.Array, least: pa.Array) -> pa.Array:
            total = np.zeros(len(m))
            if len(m):
                left = arrow_matrix(m)
                for seen in (_visits(index, left, least.to_numpy(zero_copy_only=False), k), _visits(index, left, least.to_numpy(zero_copy_only=False))):
                    for row, cell in seen:
                        np.add.at(total, row, index.counts[cell])
            return pa.array(total.astype(np.int64))

        run.__annotations__ = {"m": pa.Array, "least": pa.Array, "return": pa.Array}
        return int(rows.agg(F.sum(F.arrow_udf(run, T.LongType())(F.col("_lv"), F.col("_floor")))).first()[0] or 0)

    def run(
        self, rows: DataFrame, plan: DataFrame, kernel: Kernel, schema: T.StructType, k: int | None = None, first: bool = False,
        right: DataFrame | None = None, floor: float | None = None,
    ) -> DataFrame:
        """What ``kernel`` yields for the left rows and the right rows of the cells they visit; with ``k`` the best rows per left row.

        The plan says which right rows a block is sent. Inside the task each left row meets the cells that itself has to visit, and those that most rows of its block visit.
        ``right`` stands for the right rows of the matcher. With ``floor`` a task yields links of names that its earlier ones don't imply, from tiles near each other.
        """
        small = plan.count() <= PLAN_ROWS
        cells = (self.right if right is None else right).select("_rk", "_rv", F.col("_h.cell").alias("_cell"))
        visits = cells.join(F.broadcast(plan) if small else plan, "_cell")
        lk, rk = rows.schema["_lk"].dataType, cells.schema["_rk"].dataType
        worst = F.lit(0.0) if first or floor is not None else F.col("_floor")
        left = rows.select("_block", F.lit(-1).alias("_cell"), "_lk", F.lit(None).cast(rk).alias("_rk"), F.col("_lv").alias("_v"), worst.cast("double").alias("_floor"))
        right = visits.select("_block", "_cell", F.lit(None).cast(lk).alias("_lk"), "_rk", F.col("_rv").alias("_v"), F.lit(None).cast("double").alias("_floor"))
        tasks = max(1, min(self.blocks, 100_000))
        # by number, not by hash, so that no task gets several blocks while others have none
        dealt = left.unionByName(right).repartitionById(tasks, F.pmod("_block", F.lit(tasks)).cast("int")).sortWithinPartitions("_block", "_cell")
        arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
        index = self.index

        def out(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
            for f in frames:
                if len(f):
                    yield pa.RecordBatch.from_pandas(f[schema.fieldNames()], schema=arrow, preserve_index=False)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Held(index, kernel, k, first) if floor is None else _Linking(index, kernel, floor)
            for batch in batches:
                block, cell = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                mark = block * (len(index.counts) + 1) + cell + 1
                edges = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
                for a, b in zip(edges, edges[1:]):
                    if b > a:
                        yield from out(held.read(int(block[a]), int(cell[a]), batch.slice(a, b - a)))
            yield from out(held.finish())

        return dealt.mapInArrow(run, schema)

    def settle_blocks(self, kernel: Kernel, floor: float) -> DataFrame:
        """``_lk _label _lv _block`` of the left rows: the least name that links inside the block lead to. Names are whole numbers."""
        tasks = max(1, min(self.blocks, 100_000))
        rows = self.left.select("_block", "_home", "_lk", "_lv")
        dealt = rows.repartitionById(tasks, F.pmod("_block", F.lit(tasks)).cast("int")).sortWithinPartitions("_block", "_home")
        schema = T.StructType([rows.schema["_lk"], T.StructField("_label", T.LongType()), rows.schema["_lv"], rows.schema["_block"]])
        arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

        index = self.index

        def settled(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, m = np.concatenate([b.column(2).to_numpy() for b in held]), np.concatenate([arrow_matrix(b.column(3)) for b in held])
            forest, tiles = Forest(), _Tiles(index, names, m)
            for one in range(len(tiles.starts)):
                tiles.meet(forest, kernel, floor, tiles, one, one)
            labels, at = forest.roots(names), 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array(labels[at : at + b.num_rows], pa.int64()), b.column(3), b.column(0)], schema=arrow)
                at += b.num_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                block = batch.column(0).to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
                for a, b in zip(edges, edges[1:]):
                    if held and b > a and held[0].column(0)[0].as_py() != block[a]:
                        yield from settled(held)
                        held = []
                    if b > a:
                        held.append(batch.slice(a, b - a))
            if held:
                yield from settled(held)

        return stage(dealt.mapInArrow(run, schema), "settled")


def _visits(index, m: np.ndarray, floor: np.ndarray, k: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row and cell, a bounded number of rows at a time: all needed cells, or with ``k`` the first ones."""
    for at in range(0, len(m), LOOKED_UP):
        some = m[at : at + LOOKED_UP]
        for row, cell in [index.first_cells(some, k)] if k is not None else index.needed_cells(some, floor[at : at + LOOKED_UP]):
            yield row + at, cell


def _distinct(found: Iterator[np.ndarray], keep: int = 1_000_000) -> Iterator[np.ndarray]:
    """Distinct numbers, in a few large arrays; a number may come in several of them."""
    held, n = [], 0
    for x in found:
        held.append(np.unique(x))
        n += len(held[-1])
        if n > keep:
            held = [np.unique(np.concatenate(held))]
            n = len(held[0])
            if n > keep // 2:
                yield held[0]
                held, n = [], 0
    if held:
        yield np.unique(np.concatenate(held))


class Forest:
    """Which names hang together by the links seen so far; a name stands for itself until it is linked."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.changes = 0

    def root(self, x: int) -> int:
        parent = self.parent
        while (above := parent.get(x, x)) != x:
            parent[x] = parent.get(above, above)
            x = above
        return x

    def roots(self, names: np.ndarray) -> np.ndarray:
        if not self.parent:
            return names
        distinct, place = np.unique(names, return_inverse=True)
        return np.array([self.root(x) for x in distinct.tolist()], names.dtype)[place]

    def add(self, stars: pd.DataFrame) -> None:
        for u, v in zip(stars["_u"].tolist(), stars["_v"].tolist()):
            a, b = self.root(u), self.root(v)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.parent.setdefault(min(a, b), min(a, b))
                self.changes += 1

    def link(self, kernel: Kernel, left_names: np.ndarray, left: np.ndarray, right_names: np.ndarray, right: np.ndarray) -> None:
        """Add links between rows named by their roots; pairs that share the commonest right root are not scored."""
        roots, counts = np.unique(right_names, return_counts=True)
        common = roots[counts.argmax()]
        apart, rest = left_names != common, right_names != common
        if apart.all():
            self.add(kernel(left_names, left, right_names, right))
        elif apart.any():
            self.add(kernel(left_names[apart], left[apart], right_names, right))
        if rest.any() and not apart.all():
            self.add(kernel(left_names[~apart], left[~apart], right_names[rest], right[rest]))

    def links(self) -> pd.DataFrame:
        found = [(x, self.root(x)) for x in list(self.parent)]
        return pd.DataFrame([f for f in found if f[0] != f[1]], columns=["_u", "_v"])


class _Held:
    """One block of left rows and, for the best rows, what they have found so far."""

    def __init__(self, index, kernel: Kernel, k: int | None, first: bool) -> None:
        self.index, self.kernel, self.k, self.first = index, kernel, k, first
        self._begin(None)

    def _begin(self, block: int | None) -> None:
        self.block, self.pieces, self.left = block, [], None
        self.hits: list[pd.DataFrame] = []
        self.waiting = 0
        self.wide: list[tuple[np.ndarray, np.ndarray]] = []
        self.wide_rows = 0

    def _settle(self) -> None:
        """The left rows of the block, and for each cell which of them visit it, eight rows to a byte."""
        names, vectors, floors = zip(*self.pieces)
        self.names, self.left, self.floor, self.pieces = np.concatenate(names), np.concatenate(vectors), np.concatenate(floors), []
        self.visits = np.zeros((len(self.index.counts), -(-len(self.names) // 8)), np.uint8)
        for at in range(0, len(self.names), LOOKED_UP):
            some = slice(at, at + LOOKED_UP)
            seen = np.zeros((len(self.index.counts), len(self.names[some])), bool)
            for row, cell in _visits(self.index, self.left[some], self.floor[some], self.k if self.first else None):
                seen[cell, row] = True
            packed = np.packbits(seen, axis=1)
            self.visits[:, at // 8 : at // 8 + packed.shape[1]] = packed

    def read(self, block: int, cell: int, rows: pa.RecordBatch) -> Iterator[pd.DataFrame]:
        if block != self.block:
            yield from self.finish()
            self._begin(block)
        if cell < 0:
            self.pieces.append((rows.column(2).to_pandas().to_numpy(), arrow_matrix(rows.column(4)), rows.column(5).to_numpy(zero_copy_only=False)))
            return
        if self.left is None:
            if not self.pieces:
                return
            self._settle()
        mine = np.flatnonzero(np.unpackbits(self.visits[cell], count=len(self.names)))
        for at in range(0, rows.num_rows if len(mine) else 0, TILE):
            tile = rows.slice(at, TILE)
            rk, right = tile.column(3).to_pandas().to_numpy(), arrow_matrix(tile.column(4))
            if len(mine) < len(self.names) * self.index.wide:
                yield from self._score(mine, rk, right)
                continue
            # scored for all rows, several cells at once
            self.wide.append((rk, right))
            self.wide_rows += len(rk)
            if self.wide_rows >= TILE:
                yield from self._score_wide()

    def _score_wide(self) -> Iterator[pd.DataFrame]:
        rk, right = (np.concatenate(x) for x in zip(*self.wide))
        self.wide, self.wide_rows = [], 0
        yield from self._score(np.arange(len(self.names)), rk, right)

    def _score(self, mine: np.ndarray, rk: np.ndarray, right: np.ndarray) -> Iterator[pd.DataFrame]:
        step = max(1, 4_000_000 // len(rk))
        for begin in range(0, len(mine), step):
            some = mine[begin : begin + step]
            if self.k is None:
                yield self.kernel(self.names[some], self.left[some], rk, right)
            else:
                self.hits.append(self._best(some, rk, right))
                self.waiting += len(self.hits[-1])
                if self.waiting > max(1_000_000, 4 * self.k * len(self.names)):
                    self._cut()

    def _best(self, some: np.ndarray, rk: np.ndarray, right: np.ndarray) -> pd.DataFrame:
        """Candidates for the ``k`` best of some rows: what reaches the floor, or the ``k``-th best here."""
        floor = None if self.first or not np.isfinite(self.floor[some]).all() else self.floor[some]
        few = best_pairs(self.left[some], right, self.k, floor)
        if few is not None and len(few[0]) <= 8 * self.k * len(some) + 1_000:
            return pd.DataFrame({"_lk": some[few[0]], "_rk": rk[few[1]], "_score": few[2]})
        s = inner_products(self.left[some], right)
        if floor is None:
            n = s.shape[1]
            least = np.partition(s, n - self.k, axis=1)[:, n - self.k] if self.k < n else s.min(axis=1)
        else:
            least = floor
        li, ri = np.nonzero(s >= least[:, None])
        if len(li) > 8 * self.k * len(some) + 1_000:  # many equal scores: settle them here
            return self.kernel(some, self.left[some], rk, right)
        return pd.DataFrame({"_lk": some[li], "_rk": rk[ri], "_score": s[li, ri]})

    def _cut(self) -> None:
        hits = pd.concat(self.hits).sort_values(["_lk", "_score", "_rk"], ascending=[True, False, True], kind="stable")
        hits = hits[hits.groupby("_lk").cumcount() < self.k]
        self.hits, self.waiting = [hits], 0
        # what a row has found bounds what it still looks for
        last = hits[hits.groupby("_lk").cumcount() == self.k - 1]
        rows = last["_lk"].to_numpy(np.int64)
        self.floor[rows] = np.fmax(self.floor[rows], last["_score"].to_numpy())

    def finish(self) -> Iterator[pd.DataFrame]:
        if self.wide:
            yield from self._score_wide()
        if self.hits:
            self._cut()
            hits = self.hits[0]
            yield hits.assign(_lk=self.names[hits["_lk"].to_numpy(np.int64)])
        self.hits = []


class _Tiles:
    """Named rows by leaf, in tiles with the boxes that hold them, and the roots of their names as they were some links ago."""

    def __init__(self, index: Splits, names: np.ndarray, m: np.ndarray) -> None:
        order = np.argsort(index.find(m)[0], kind="stable")
        self.index, self.rows = index, index.bounded(m[order])
        self.distinct, self.place = np.unique(names[order], return_inverse=True)
        self.roots, self.changes = self.distinct, 0
        self.starts = np.arange(0, len(m), LINK_ROWS)
        self.low, self.high, self.length = index.boxes(self.rows, self.starts)

    def named(self, forest: Forest) -> np.ndarray:
        """The roots of all rows' names; links of late may be missing, which only costs scores."""
        if forest.changes - self.changes > len(self.distinct) // 16:
            self.roots, self.changes = forest.roots(self.distinct), forest.changes
        return self.roots

    def meet(self, forest: Forest, kernel: Kernel, floor: float, other: _Tiles, one: int, since: int = 0) -> None:
        """Link a tile of ``other`` and those of these tiles that are near it, from ``since`` on."""
        index, begin = self.index, other.starts[one]
        reach = index.reach(floor, other.length[one], self.length)
        for tile in index.near(other.low[one], other.high[one], self.low[since:], self.high[since:], reach[since:]) + since:
            at = self.starts[tile]
            left, right = (index.near(low, high, p := x.rows[a : a + LINK_ROWS, index.dim : -1], p, reach[tile]) + a
                           for x, a, low, high in ((self, at, other.low[one], other.high[one]), (other, begin, self.low[tile], self.high[tile])))
            if len(left) and len(right):
                forest.link(kernel, self.named(forest)[self.place[left]], self.rows[left], other.named(forest)[other.place[right]], other.rows[right])


class _Linking:
    """One block of left rows, and the links of names that a task has found."""

    def __init__(self, index: Splits, kernel: Kernel, floor: float) -> None:
        self.index, self.kernel, self.floor, self.forest = index, kernel, floor, Forest()
        self._begin(None)

    def _begin(self, block: int | None) -> None:
        self.block, self.pieces, self.left = block, [], None
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def read(self, block: int, cell: int, rows: pa.RecordBatch) -> Iterator[pd.DataFrame]:
        if block != self.block:
            yield from self._meet()
            self._begin(block)
        if cell < 0:
            self.pieces.append((rows.column(2).to_numpy(zero_copy_only=False), arrow_matrix(rows.column(4))))
            return
        self.waiting.append((rows.column(3).to_numpy(zero_copy_only=False), arrow_matrix(rows.column(4))))
        self.rows += rows.num_rows
        if self.rows >= TILE:
            yield from self._meet()

    def _meet(self) -> Iterator[pd.DataFrame]:
        if not self.waiting or not (self.pieces or self.left):
            return
        if self.left is None:
            self.left, self.pieces = _Tiles(self.index, *(np.concatenate(x) for x in zip(*self.pieces))), []
        right = _Tiles(self.index, *(np.concatenate(x) for x in zip(*self.waiting)))
        self.waiting, self.rows = [], 0
        right.changes = -len(right.distinct)
        for one in range(len(right.starts)):
            self.left.meet(self.forest, self.kernel, self.floor, right, one)
        if len(self.forest.parent) > FOREST_NAMES:
            yield self.forest.links()
            self.forest, self.left.roots, self.left.changes = Forest(), self.left.distinct, 0

    def finish(self) -> Iterator[pd.DataFrame]:
        yield from self._meet()
        if self.forest.parent:
            yield self.forest.links()
        self.forest = Forest()


def pairs_above(
    left: DataFrame, right: DataFrame, floor: float, kernel: Kernel, schema: T.StructType,
    broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS,
    measured: tuple[int, int, float] | None = None,
) -> DataFrame:
    """Exact matching at a fixed floor: ``kernel`` sees every pair with a product above it."""
    n, dim, longest = measured or measure(right, "_rv")
    if fits_broadcast(n, dim, broadcast_bytes):
        return match_broadcast(left, right, kernel, schema)
    matcher = Matcher(left, right, Tree(right, n, longest), block_rows)
    rows = matcher.left.withColumn("_floor", F.lit(float(floor)))
    return matcher.run(rows, matcher.plan(rows), kernel, schema)


def linked(rows: DataFrame, floor: float, block_rows: int = BLOCK_ROWS, measured: tuple[int, int, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """``_lk _label`` of all ``rows`` and links ``_u _v`` of labels: what products above ``floor`` connect, exactly.

    ``rows`` has whole numbers ``_lk`` and vectors ``_lv``. Each block is settled by itself first. Then blocks meet the leaves of others
    near them, as labels: a task yields a forest of the labels it saw, no pairs, and scores only what doesn't hang together yet.
    """
    right = rows.select(F.col("_lk").alias("_rk"), F.col("_lv").alias("_rv"))
    n, _, longest = measured or measure(right, "_rv")
    matcher = Matcher(rows, right, Splits(right, n, longest), block_rows)
    kernel = links_by_bounds(floor, matcher.index.dim)
    settled = matcher.settle_blocks(kernel, floor)
    labels = settled.select("_lk", "_label")
    if matcher.blocks < 2:
        return labels, settled.select(F.col("_lk").alias("_u"), F.col("_label").alias("_v")).limit(0)
    left = settled.select(F.col("_label").alias("_lk"), "_lv", "_block")
    named = matcher.right.join(labels, F.col("_rk") == F.col("_lk")).select(F.col("_label").alias("_rk"), "_rv", "_h")
    schema = T.StructType([T.StructField("_u", T.LongType()), T.StructField("_v", T.LongType())])
    return labels, matcher.run(left, matcher.plan_links(floor), kernel, schema, right=named, floor=floor)


def nearest(
    left: DataFrame, right: DataFrame, k: int, schema: T.StructType,
    broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS,
    measured: tuple[int, int, float] | None = None, recall: float | None = None, report: dict | None = None,
) -> DataFrame:
    """The ``k`` best right rows of every left row as ``_lk _rk _score``.

    Exact at any size, or with sign buckets where ``recall`` is given. A first round over each block's own cells gives its rows
    ``k`` candidates; their worst score then says which further cells can, or may well, hold better ones. ``report``
    is told the number of pairs scored and of all pairs.
    """
    n, dim, longest = measured or measure(right, "_rv")
    if recall is None and fits_broadcast(n, dim, broadcast_bytes):
        if report is not None:
            report.update(pairs_scored=n * left.count(), pairs=n * left.count())
        return match_broadcast(left, right, best(k), schema)
    index = Tree(right, n, longest) if recall is None else Buckets(right, n, longest, max(1, dim), recall)
    matcher = Matcher(left, right, index, block_rows)
    near = stage(matcher.run(matcher.left, matcher.plan(matcher.left, k), best(k), schema, k, first=True), "nearest")
    worst = near.groupBy("_lk").agg(F.min("_score").alias("_worst"), F.count("*").alias("_held"))
    # fewer than k found: every cell may hold one more
    floor = F.when(F.col("_held") >= k, F.col("_worst")).otherwise(F.lit(float("-inf")))
    rows = stage(matcher.left.join(worst, "_lk", "left").select("_lk", "_lv", "_block", F.coalesce(floor, F.lit(float("-inf"))).alias("_floor")), "floors")
    # a row's own cells are read once more with the others: they hold the first hits, so this round is whole by itself
    if report is not None:
        report.update(pairs_scored=matcher.count(rows, k), pairs=n * rows.count())
    return matcher.run(rows, matcher.plan(rows), best(k), schema, k)
