from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.models import base
from semtab.models.base import HashEmbedder, OverlapScorer
from semtab.operators import metric as M
from semtab.operators import retrieval as E
from semtab.operators import vectors as V
from semtab.operators.components import components
from semtab.runtime import split_join, stage
from tests.conftest import rows


@pytest.fixture(scope="module")
def clumped():
    """Vectors of unequal length, half of them near copies of one vector."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(150, 8)) * rng.uniform(0.2, 2.0, size=(150, 1))
    clump = base[0] + rng.normal(size=(150, 8)) * 0.01
    return np.vstack([base, clump])


@pytest.fixture(scope="module")
def table(spark, clumped):
    data = [(i, f"t{i:03d}", [float(x) for x in v]) for i, v in enumerate(clumped)]
    return stage(spark.createDataFrame(data, "id long, name string, vec array<float>").repartition(5))


def brute_nearest(m, k):
    m = m.astype(np.float32).astype(float)
    s = np.round(m @ m.T, 10)
    return {i: [int(j) for j in np.argsort(-s[i], kind="stable")[:k]] for i in range(len(m))}


@pytest.mark.parametrize("small", [True, False])
def test_sim_join_is_exact(table, clumped, small):
    size = {} if small else {"broadcast_bytes": 0, "block_rows": 23}
    out = E.sim_join(table, table, "vec", "vec", 5, left_key="id", right_key="id", lsuffix="_l", rsuffix="_r", **size)
    got: dict[int, list] = {}
    for r in out.orderBy("id_l", F.desc("_scores"), "id_r").collect():
        got.setdefault(r["id_l"], []).append(r["id_r"])
    assert got == brute_nearest(clumped, 5)


def test_sim_join_names_and_more_wanted_than_there_are(table):
    few = table.limit(3)
    out = E.sim_join(few, few.withColumnRenamed("id", "other"), "vec", "vec", 10, left_key="id", right_key="other",
                     lsuffix="_l", score_suffix="_s", keep_index=True)
    assert out.columns == ["id", "name_l", "vec_l", "_scores_s", "other", "name", "vec", "_left_id", "_right_id"]
    assert out.count() == 9
    with pytest.raises(ValueError):
        E.sim_join(few, few, "vec", "vec", 1, left_key="id", right_key="id")
    cells = E.sim_join(few, few, "vec", "vec", 10, left_key="id", right_key="id", rsuffix="_r", broadcast_bytes=0, block_rows=2)
    assert cells.count() == 9


def test_sim_join_approx_recall(table, clumped):
    out = E.sim_join(table, table, "vec", "vec", 5, left_key="id", right_key="id", lsuffix="_l", rsuffix="_r", approx=True, block_rows=50)
    got = {(r["id_l"], r["id_r"]) for r in out.collect()}
    want = {(i, j) for i, near in brute_nearest(clumped, 5).items() for j in near}
    assert len(got) == 5 * len(clumped)
    assert len(got & want) >= 0.9 * len(want)


@pytest.fixture(scope="module")
def grouped(spark):
    """1,500 vectors in 60 groups far apart."""
    rng = np.random.default_rng(3)
    m = np.repeat(rng.normal(size=(60, 16)), 25, axis=0) + rng.normal(size=(1500, 16)) * 0.02
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return m, stage(spark.createDataFrame(data, "id long, vec array<float>").repartition(6))


@pytest.mark.parametrize("approx", [False, True])
def test_cells_that_cannot_hold_a_hit_are_skipped(grouped, approx):
    m, df = grouped
    out, report = E.sim_join(df, df.withColumnsRenamed({"id": "id2", "vec": "vec2"}), "vec", "vec2", 4, left_key="id", right_key="id2",
                             approx=approx, recall=0.9, stats=True, broadcast_bytes=0, block_rows=200)
    got: dict[int, list] = {}
    for r in out.orderBy("id", F.desc("_scores"), "id2").collect():
        got.setdefault(r["id"], []).append(r["id2"])
    want = brute_nearest(m, 4)
    assert report["pairs"] == 1500 * 1500 and report["pairs_scored"] < 0.5 * report["pairs"]
    if approx:
        assert sum(len({*got[i]} & {*near}) for i, near in want.items()) >= 0.9 * 4 * len(m)
    else:
        assert got == want


def test_copies_of_one_vector_are_settled_by_key(spark):
    same = [(i, [1.0, 0.0, 0.5]) for i in range(700)] + [(700 + i, [float(i % 7), 1.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame(same, "id long, vec array<float>").repartition(3)
    m = np.array([v for _, v in same])
    out = E.sim_join(df, df.withColumnsRenamed({"id": "id2", "vec": "vec2"}), "vec", "vec2", 3, left_key="id", right_key="id2", broadcast_bytes=0, block_rows=64)
    got: dict[int, list] = {}
    for r in out.orderBy("id", F.desc("_scores"), "id2").collect():
        got.setdefault(r["id"], []).append(r["id2"])
    assert got == brute_nearest(m, 3)


def test_sides_without_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<float>")
    none, other = df.limit(0), df.withColumnsRenamed({"id": "id2", "vec": "vec2"})
    assert E.sim_join(none, other, "vec", "vec2", 2, left_key="id", right_key="id2", broadcast_bytes=0).collect() == []
    assert E.sim_join(df, other.limit(0), "vec", "vec2", 2, left_key="id", right_key="id2").collect() == []


def test_normal_distribution():
    from math import erf

    x = np.linspace(-6, 6, 101)
    assert np.abs(M._normal_below(x) - [(1 + erf(v / 2**0.5)) / 2 for v in x]).max() < 1e-6


def brute_kept(m, floor):
    m = m.astype(np.float32).astype(float)
    near = np.round(m @ m.T, 10) > floor
    label = np.arange(len(m))
    while True:
        new = np.array([label[near[i]].min() if near[i].any() else label[i] for i in range(len(m))])
        new = np.minimum(new, label)
        if (new == label).all():
            return [i for i in range(len(m)) if label[i] == i]
        label = new


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("floor", [0.8, 3.0])
def test_dedup_is_exact(table, clumped, small, floor):
    size = {} if small else {"broadcast_bytes": 0, "block_rows": 23}
    out = E.sem_dedup(table, "name", "vec", floor, **size)
    assert sorted(r["id"] for r in out.collect()) == brute_kept(clumped, floor)


def test_dedup_keeps_copies_and_rows_without_vector(spark):
    df = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "b", [0.99, 0.1]), (4, "c", [0.0, 1.0]), (5, None, None)],
        "id long, name string, vec array<float>")
    assert rows(E.sem_dedup(df, "name", "vec", 0.9), "id") == [(1,), (2,), (4,), (5,)]


def test_dedup_with_several_vectors_of_a_value_and_missing_numbers(spark):
    df = spark.createDataFrame(
        [(1, "c", [1.0, 0.0]), (2, "c", [0.0, 1.0]), (3, "b", [0.99, 0.1]), (4, "a", [0.1, 0.99]), (5, "d", [float("nan"), 1.0]), (6, "e", [-1.0, 0.0]), (7, "b", [0.99, 0.1])],
        "id long, name string, vec array<double>")
    for size in ({}, {"broadcast_bytes": 0, "block_rows": 1}):
        assert rows(E.sem_dedup(df, "name", "vec", 0.9, **size), "id") == [(4,), (5,), (6,)]


def test_more_rows_than_blocks_send_no_more(spark):
    """Right rows go to a bounded number of blocks, however small the least block is."""
    m = np.random.default_rng(3).normal(size=(3_000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "_lk long, _lv array<double>")
    right = df.select(F.col("_lk").alias("_rk"), F.col("_lv").alias("_rv"))
    matcher = M.Matcher(df, right, M.Tree(right, 3_000, float((m**2).sum(axis=1).max())), 10)
    assert matcher.blocks <= 2 * M.BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism
    labels, edges = M.linked(df, -100.0, 10)
    assert labels.select("_label").distinct().count() <= matcher.blocks
    # a star per task over what each block has settled, not links of rows
    assert edges.count() <= matcher.blocks**2


def test_what_hangs_together_is_not_scored():
    m = np.random.default_rng(5).normal(size=(500, 4))
    names, seen = np.arange(500), []

    def kernel(lk, left, rk, right):
        seen.append(len(lk) * len(rk))
        return V.links(2.0)(lk, left, rk, right)

    forest = M.Forest()
    forest.add(V.links(-100.0)(names[:490], m[:490], names[:490], m[:490]))
    forest.link(kernel, forest.roots(names), m, forest.roots(names), m)
    assert sum(seen) <= 2 * 10 * 500
    near = m @ m.T > 2.0
    assert all(forest.root(i) == 0 for i in range(490, 500) if near[i, :490].any())


def _splits(spark, m):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "_rk long, _rv array<double>")
    return M.Splits(df, len(m), float(np.nan_to_num(m * m).sum(axis=1).max()))


def test_tiles_that_cannot_hold_a_link_are_not_scored(spark, monkeypatch):
    """Rows in groups: a tile meets few others, each link is found, and copies and missing numbers do no harm."""
    monkeypatch.setattr(M, "LINK_ROWS", 64)
    rng = np.random.default_rng(11)
    m = (rng.normal(size=(60, 1, 40)) + rng.normal(size=(1, 50, 40)) * 0.04).reshape(-1, 40)
    m = rng.permutation(m / np.sqrt((m * m).sum(axis=1))[:, None])
    m[7], m[9, 3], m[11] = m[8], np.nan, 0.0
    index, scored = _splits(spark, m), []

    def kernel(lk, left, rk, right):
        scored.append(len(lk) * len(rk))
        return V.links_by_bounds(0.95, 40)(lk, left, rk, right)

    forest, names = M.Forest(), np.arange(len(m))
    tiles = M._Tiles(index, names, m)
    for one in range(len(tiles.starts)):
        tiles.meet(forest, kernel, 0.95, tiles, one, one)
    near = np.nan_to_num(V.inner_products(m, m)) > 0.95
    label = names.copy()
    for _ in range(20):
        label = np.array([min(label[near[i]].min(initial=label[i]), label[i]) for i in range(len(m))])
    assert (forest.roots(names) == label).all() and len(np.unique(label)) < 100
    assert sum(scored) < len(m) ** 2 / 10


def test_leaves_have_homes_within_their_bounds(spark):
    m = np.random.default_rng(4).normal(size=(900, 6)) * [4, 2, 1, 1, 1, 1]
    index = _splits(spark, m)
    leaf, p = index.find(m)[0], m @ index.turn
    assert len(np.unique(leaf)) > 50 and (p >= index.low[leaf]).all() and (p <= index.high[leaf]).all()
    bounded, s = index.bounded(m), m @ m.T
    assert (bounded[:, 6:] @ bounded[:, 6:].T >= s - 1e-9).all()


@pytest.mark.parametrize("floor", [0.99, 0.3, -2.0])
def test_links_by_bounds_connect_what_links_do(floor):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 12))
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    m[20:40] = m[:20]
    bounded = np.column_stack([m, m[:, :5], np.sqrt((m[:, 5:] ** 2).sum(axis=1))])
    names, got, want = np.arange(300), M.Forest(), M.Forest()
    got.add(V.links_by_bounds(floor, 12)(names[:150], bounded[:150], names[100:], bounded[100:]))
    want.add(V.links(floor)(names[:150], m[:150], names[100:], m[100:]))
    assert (got.roots(names) == want.roots(names)).all()


def test_words_are_hashed_once(monkeypatch):
    hashed = []
    md5 = base.hashlib.md5
    monkeypatch.setattr(base.hashlib, "md5", lambda data, **kw: hashed.append(data) or md5(data, **kw))
    texts = ["the cat the Cat", "the dog", "", "w" * 100 + " cat", "a b c d e f the"]
    for room in (200_000, 3):
        monkeypatch.setattr(HashEmbedder, "held_words", room)
        got, hashed[:] = HashEmbedder(16).embed(texts * 3), []
        want = np.zeros((5, 16))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = md5(word.encode()).digest()
                want[i, int.from_bytes(h[:4], "big") % 16] += 1 if h[4] & 1 else -1
        want /= np.maximum(np.sqrt((want**2).sum(axis=1)), 1e-9)[:, None]
        assert np.allclose(got, np.vstack([want] * 3), atol=1e-6)
    encoder = HashEmbedder(16)
    encoder.embed(["the cat the cat"] * 50)
    assert sorted(hashed) == [b"cat", b"the"]


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_rough_products_decide_nothing_that_is_close(scale):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(40, 16)), rng.normal(size=(90, 16))
    b[5] = b[17]
    a, b = a * scale, b * scale
    s = V.inner_products(a, b)
    for floor in (s[3, 5], s[7, 8], 0.0):
        assert (V.near_pairs(a, b, floor) == (s > floor)).all()
    got = V.best(3)(np.arange(40), a, np.arange(90), b)
    want = [j for i in range(40) for j in np.argsort(-s[i], kind="stable")[:3]]
    assert got["_rk"].tolist() == want


def test_blocks_of_copies_yield_few_links():
    m = np.ones((400, 3))
    names = np.array([f"n{i:03d}" for i in range(400)], dtype=object)
    out = V.links(0.5)(names, m, names, m)
    assert len(out) == 399 and set(out["_v"]) == {"n000"}


@pytest.mark.parametrize("task_edges", [0, 100_000])
def test_components(spark, task_edges):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    hub = [("hub", f"h{i:03d}") for i in range(200)]
    edges = spark.createDataFrame(chain + hub + [("x", "y"), ("y", "x"), ("z", "z")], "_u string, _v string").where("_u != _v")
    got = {r["_u"]: r["_v"] for r in components(edges, task_edges=task_edges).collect()}
    want = {f"c{i:03d}": "c000" for i in range(1, 61)} | {f"h{i:03d}": "h000" for i in range(1, 200)}
    assert got == want | {"hub": "h000", "y": "x"}


def test_split_join_with_hot_key(spark):
    big = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    small = big.select("k").distinct().withColumn("v", F.col("k") * 2)
    out = split_join(big, small, "k")
    assert out.count() == 60_000 and out.where("v != 2 * k").count() == 0
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_split_join_keeps_rows_without_key(spark):
    big = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 3000 > 1, F.col("id")).alias("k"), "id")
    small = big.select("k").where("k IS NOT NULL").distinct().withColumn("v", F.col("k") * 2)
    for how in ("left", "inner"):
        assert rows(split_join(big, small, "k", how), "id", "v") == rows(big.join(small, "k", how), "id", "v")
    assert split_join(big, small, "k", "left").count() == 30_000


def test_hits_of_vectors_with_missing_numbers(spark):
    right = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "_rk long, _rv array<double>")
    left = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, [0.0, 1.0])], "id long, vec array<double>").coalesce(1)
    got = {r["id"]: [h["_rk"] for h in r["hits"]] for r in left.withColumn("hits", V.hits_column(F.col("vec"), right, 1, T.LongType())).collect()}
    assert got[1] == [1] and got[3] == [2]


def test_texts_move_once_to_be_encoded(spark, monkeypatch):
    """Whole texts are in one exchange, not in one for the distinct ones and one to deal them out; each is encoded once."""
    df = spark.createDataFrame([(i, f"text {i % 7}" if i % 5 else None) for i in range(400)], "id long, text string").repartition(4)
    plans, real = [], E.stage

    def staged(table, label="table"):
        plans.append(table._jdf.queryExecution().optimizedPlan().toString())
        out = real(table, label)
        assert label != "vectors" or out.count() == 7
        return out

    monkeypatch.setattr(E, "stage", staged)
    out = E.embed(df, "text", HashEmbedder(8))
    assert out.count() == 400 and out.where("(text IS NULL) <> (vec IS NULL)").count() == 0
    aggregate = plans[0].index("Aggregate")
    assert "Repartition" not in plans[0][:aggregate] and "RepartitionByExpression" in plans[0][aggregate:]


@pytest.mark.parametrize("wide, met", [(0.5, {0, 1, 2, 3}), (1.0, {0, 1, 2})])
def test_what_a_row_finds_bounds_what_it_looks_for(wide, met):
    """Cells that most rows visit are scored together, by an approximate index only for the rows that visit them."""
    class Index:
        counts = np.ones(2)

        def needed_cells(self, m, floor):
            yield np.array([0, 1, 2]), np.zeros(3, np.int32)

    Index.wide = wide
    rng = np.random.default_rng(1)
    left, right = rng.normal(size=(4, 3)), rng.normal(size=(50, 3))
    held = M._Held(Index(), V.best(2), 2, False)

    def batch(m):
        n = np.arange(len(m))
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(n), pa.array(n), pa.array(n), pa.array(m.tolist()), pa.array(np.full(len(m), -5.0))], names=list("abcdef"))

    assert not list(held.read(0, -1, batch(left))) and not list(held.read(0, 0, batch(right)))
    out = pd.concat(held.finish())
    best = np.sort(left @ right.T, axis=1)[:, -2]
    assert set(out["_lk"]) == met and np.allclose(held.floor[sorted(met)], best[sorted(met)])


def test_a_held_side_is_scored_by_tiles(monkeypatch):
    rng = np.random.default_rng(4)
    r = rng.normal(size=(20_000, 8))
    r[500:520] = r[3]
    m = np.vstack([rng.normal(size=(50, 8)), r[3:4] * 2])
    s, sizes, real = V.inner_products(m, r), [], V.rough_products
    monkeypatch.setattr(V, "rough_products", lambda a, b: sizes.append(len(a) * len(b)) or real(a, b))
    li, ri, score = V.best_held(m, np.arange(len(r)), r, 3)
    assert ri.reshape(-1, 3).tolist() == [np.argsort(-x, kind="stable")[:3].tolist() for x in s]
    assert (li == np.repeat(np.arange(51), 3)).all() and (score == s[li, ri]).all() and max(sizes) <= 51 * V.HELD_TILE


def test_search(spark):
    df = spark.createDataFrame([(1, "red apple", [1.0, 0.0]), (2, "green pear", [0.0, 1.0]), (3, "red pear", [0.7, 0.7]), (4, None, None)],
                               "id long, text string, vec array<float>")
    out = E.sem_search(df, "vec", [1.0, 0.1], 2, key="id", scores=True)
    assert [r["id"] for r in out.collect()] == [1, 3] and out.columns[-1] == "vec_scores_sim_score"
    again = E.sem_search(df.where("text IS NOT NULL"), "vec", "red pear", 3, key="id", embedder=HashEmbedder(2), text_col="text",
                         rerank=OverlapScorer(), n_rerank=1)
    assert [r["id"] for r in again.collect()] == [3]
    with pytest.raises(ValueError):
        E.sem_search(df, "vec", [1.0, 0.0], key="id")


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, None)], "id long, text string")
    index = E.sem_index(df, "id", "text", HashEmbedder(16), str(tmp_path / "ix"))
    assert rows(index, "key") == [(1,), (2,), (3,), (4,)]
    joined = {r["id"]: r["vec"] for r in E.attach_index(df, "id", index).collect()}
    assert joined[1] == joined[3] != joined[2] and joined[4] is None
    assert np.isclose(np.linalg.norm(joined[1]), 1.0)
