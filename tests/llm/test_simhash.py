from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
import xxhash

from semtab.llm.simhash import covering_masks, drop_near_copies, fingerprint, near_links, simhash_components, spanning_links
from tests.conftest import rows


def plain_print(text: str, n: int = 4) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\x0b\x0c\r":
        words = words.replace(gap, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints: dict) -> dict:
    lead = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and lead[a] != lead[b]:
                lead[a] = lead[b] = min(lead[a], lead[b])
                changed = True
    return lead


def test_whole_table_against_brute_force(spark, sample):
    got = {r[0]: (r[1], r[2]) for r in simhash_components(sample).collect()}
    prints = {r["doc_id"]: plain_print(r["text"]) for r in sample.collect()}
    lead = plain_groups(prints)
    assert got == {k: (f"{prints[k]:016x}", lead[k]) for k in prints}


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_masks_cover_every_pair_within_radius(radius):
    masks, draw = covering_masks(radius), random.Random(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        differing = sum(1 << b for b in draw.sample(range(64), radius))
        assert any(not m & differing for m in masks)


def test_spanning_links_connect_what_all_links_connect():
    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(6)]
    members = list({b ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4))) & (2**64 - 1) for b in base for _ in range(60)})
    found = spanning_links(np.array(members, np.uint64), 4)
    assert len(found) < len(members)
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    want = plain_groups({m: m for m in members})
    lead = {m: m for m in members}
    for _ in members:
        for a, b in found:
            lead[a] = lead[b] = min(lead[a], lead[b])
    assert lead == want


@pytest.mark.parametrize("bucket_rows", [3, 8192])
def test_large_buckets_lose_no_link(spark, bucket_rows):
    draw = random.Random(2)
    centre = draw.getrandbits(62)
    prints = list({centre ^ (1 << draw.randrange(60)) ^ (1 << draw.randrange(60)) for _ in range(40)} | {draw.getrandbits(62) for _ in range(20)})
    links = near_links(spark.createDataFrame([(p,) for p in prints], "_print long"), 4, bucket_rows).collect()
    lead = {p: p for p in prints}
    for _ in prints:
        for u, v in links:
            lead[u] = lead[v] = min(lead[u], lead[v])
    assert lead == plain_groups({p: p for p in prints})


def test_odd_rows(spark, make):
    long = " ".join(f"w{i % 977}x{i}" for i in range(80_000))
    df = make([(5, None), (3, ""), (9, " \t\n"), (7, "one two"), (6, "One  TWO\n"), (None, "one two"), (8, long), (2, long), (2, long)], extra=True)
    got = rows(simhash_components(df))
    zero = "0" * 16
    assert [r for r in got if r[1] == zero] == [(3, zero, 3), (5, zero, 3), (9, zero, 3)]
    assert sorted([r[::2] for r in got if r[1] != zero], key=repr) == [(2, 2), (2, 2), (6, 6), (7, 6), (8, 2), (None, 6)]
    kept = rows(drop_near_copies(df), "doc_id", "_text")
    assert kept == [(2, "x"), (3, "x"), (6, "x")]
    assert fingerprint(long, 4) == plain_print(long)


def test_empty_table(make):
    assert simhash_components(make([])).collect() == []
    assert drop_near_copies(make([])).collect() == []
