"""Columns that bear the names operators use inside come through unharmed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from semtab.llm.line_dedup import dedup_lines
from semtab.llm.mixing import take_mix
from semtab.llm.simhash import drop_near_copies

NAMES = ["_gone_id", "_gone_mark", "_gone_lines", "_lead_id", "_lead_mark", "_lead_rows", "_mix_id", "_mix_mark", "_mix_copies", "_mix_nth", "_id", "_MARK", "_Text", "__gone_id"]


@pytest.mark.parametrize("step", [lambda d: dedup_lines(d, removed_col="_removed").drop("_removed"), drop_near_copies, take_mix])
def test_inner_names_give_way(make, step):
    texts = ["one line here\nanother line there\nthe end", "one line here\nanother line there\nnot the end", "something else altogether", None, "", "something else altogether"]
    plain = make([(k // 2 if k > 3 else k, t, f"s{k % 2}") for k, t in enumerate(texts)])
    clashing = plain.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in NAMES])
    got = step(clashing)
    assert got.columns == clashing.columns
    assert sorted((tuple(r) for r in got.select(*plain.columns).collect()), key=repr) == sorted((tuple(r) for r in step(plain).collect()), key=repr)
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got.collect() for n in NAMES)
