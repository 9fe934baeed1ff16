"""Near copies by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.llm.common import fresh, keyed, mark_of
from semtab.operators.components import components
from semtab.runtime import col, split_join, stage

SEED = 42
BITS = 64
_CHUNK = 1 << 16


def fingerprint(text: str, shingle_words: int) -> int:
    """SimHash of a whole text: a bit is 1 if it is set in over half of the shingles' hashes.

    A-Z are lower-cased, words end at ASCII white space, shingles count as often as they
    occur. A text with fewer words is one shingle; one without words has fingerprint 0.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    last = max(len(words) - shingle_words, 0)
    starts = [0, *[e + 1 for e in ends[:last]]]
    ends = ends[min(shingle_words, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for a in range(0, len(starts), _CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a : a + _CHUNK], ends[a : a + _CHUNK])], dtype="<u8")
        ones += np.add.reduce(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def covering_masks(radius: int) -> list[int]:
    """Masks such that any two fingerprints within ``radius`` bits agree under one of them.

    Each bit has a vector of ``radius + 1`` bits; a mask, one per vector v other than zero,
    keeps the bits whose vector has an odd product with v. At most ``radius`` differing bits
    leave some v whose product with all their vectors is even, and that mask hides them all.
    """
    every = (1 << radius + 1) - 1
    vectors = [1 + i % every for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, every + 1)]


def spanning_links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within ``radius`` that connect what all links together connect; at most one per member.

    Breadth first: members reached leave the rest, so each one is compared with the rest
    once.
    """
    rest, out = np.arange(len(members)), []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            at, front = front[:64], front[64:]
            near = np.bitwise_count(members[at][:, None] ^ members[rest][None, :]) <= radius
            reached = near.any(axis=0)
            by = near.argmax(axis=0)
            out += zip(members[at[by[reached]]].tolist(), members[rest[reached]].tolist())
            front, rest = np.concatenate([front, rest[reached]]), rest[~reached]
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def fingerprints(docs: DataFrame, shingle_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id _mark _print`` of every row; the fingerprint is a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint(t.as_py(), shingle_words)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], names=["_id", "_mark", "_print"])

    plain = keyed(docs, id_col, text_col)
    schema = T.StructType([*plain.schema.fields[:2], T.StructField("_print", T.LongType())])
    return plain.mapInArrow(run, schema)


def near_links(prints: DataFrame, max_bits: int, bucket_rows: int = 8192) -> DataFrame:
    """``_u _v``: links between distinct fingerprints within ``max_bits``, enough to connect what all of them connect.

    ``prints`` holds distinct ``_print``. Every fingerprint goes to one bucket of each covering
    table; buckets are read in key order. Up to ``bucket_rows`` members are linked on the spot.
    The members of a larger bucket are numbered and leave; blocks of that size then
    meet pairwise in tasks of their own, so no task holds a whole bucket and none emits
    more than one link per member.
    """
    masks = [_signed(m) for m in covering_masks(max_bits)]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links as (0, u, v, 0, 0, 0); members of large buckets as (1, member, 0, table, key, block)."""
        held, bucket, gone = np.empty(0, np.uint64), None, 0

        def rows(kind, a, b, table=0, key=0, block=0):
            n = len(a)
            same = lambda x: np.broadcast_to(np.asarray(x, np.int64), n)
            return pa.RecordBatch.from_arrays(
                [pa.array(same(kind)), pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64)), pa.array(same(table)), pa.array(same(key)), pa.array(same(block))],
                names=["_kind", "_u", "_v", "_table", "_key", "_block"],
            )

        def flush():
            if gone and len(held):
                yield rows(1, held, np.zeros(len(held), np.uint64), *bucket, gone)
            elif len(held) > 1:
                found = spanning_links(held, max_bits)
                if found:
                    yield rows(0, [f[0] for f in found], [f[1] for f in found])

        for batch in batches:
            table, key, member = (batch.column(k).to_numpy() for k in range(3))
            member = member.view(np.uint64)
            cuts = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            firsts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(table)]])
            if not len(table):
                continue
            # buckets of one member inside a batch have no links; only the first and last may go on
            work = np.flatnonzero(ends - firsts > 1).tolist()
            for k in sorted({0, len(firsts) - 1, *work}):
                a, b = firsts[k], ends[k]
                if bucket != (table[a], key[a]):
                    yield from flush()
                    held, bucket, gone = np.empty(0, np.uint64), (table[a], key[a]), 0
                held = np.concatenate([held, member[a:b]])
                while len(held) > bucket_rows:
                    yield rows(1, held[:bucket_rows], np.zeros(bucket_rows, np.uint64), *bucket, gone)
                    held, gone = held[bucket_rows:], gone + 1
        if bucket is not None:
            yield from flush()

    tables = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("_print").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
    spread = prints.select("_print", F.explode(tables).alias("_at")).select(F.col("_at.t").alias("_table"), F.col("_at.k").alias("_key"), F.col("_print").alias("_member"))
    sorted_ = spread.repartition("_table", "_key").sortWithinPartitions("_table", "_key")
    found = stage(sorted_.mapInArrow(settle, "_kind long, _u long, _v long, _table long, _key long, _block long"), "simhash-links")
    links = found.where("_kind = 0").select("_u", "_v")
    large = found.where("_kind = 1").select("_table", "_key", "_block", F.col("_u").alias("_member"))
    if large.isEmpty():
        return links
    blocks = large.groupBy("_table", "_key").agg((F.max("_block") + 1).alias("_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    met = large.join(blocks, ["_table", "_key"]).withColumn("_other", other)
    met = met.withColumn("_low", F.least("_block", "_other")).withColumn("_high", F.greatest("_block", "_other"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        members = pdf["_member"].to_numpy(np.int64).view(np.uint64)
        found = spanning_links(members, max_bits)
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["_u", "_v"])

    wide = met.groupBy("_table", "_key", "_low", "_high").applyInPandas(meet, "_u long, _v long")
    return links.unionByName(wide)


def near_copies(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id _mark _print _lead`` for every row: its fingerprint and the leading document of its group.

    Documents are linked where fingerprints differ in ``max_bits`` bits or fewer; groups are what links
    connect. ``_lead`` is a struct ``(no_id, id, mark)`` of the least id of the group; rows without an id come
    last, then the hash of the text decides. Equal fingerprints meet in an aggregate before anything else, so
    a group of exact copies is one node. Texts that are missing or without words have fingerprint 0 and are
    linked like any other.
    """
    rows = stage(fingerprints(docs, shingle_words, id_col, text_col), "simhash-prints")
    lead = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_mark").alias("mark"))
    nodes = stage(rows.groupBy("_print").agg(F.min(lead).alias("_lead")), "simhash-nodes")
    grouped = components(near_links(nodes.select("_print"), max_bits))
    grouped = stage(grouped.select(F.col("_u").alias("_print"), F.col("_v").alias("_root")), "simhash-groups")
    members = grouped.unionByName(grouped.select(F.col("_root").alias("_print"), "_root").distinct())
    named = stage(members.join(nodes, "_print"), "simhash-members")
    least = split_join(named.select("_print", "_root"), named.groupBy("_root").agg(F.min("_lead").alias("_least")), "_root")
    leads = nodes.join(least.select("_print", "_least"), "_print", "left").select("_print", F.coalesce("_least", "_lead").alias("_lead"))
    return split_join(rows, stage(leads, "simhash-leads"), "_print")


def simhash_components(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id fingerprint component_id`` for every row of ``docs``; see :func:`near_copies`.

    The fingerprint has 16 hex digits; the component is the least id of the group, missing only where no
    document of the group has an id.
    """
    out = near_copies(docs, shingle_words, max_bits, id_col, text_col)
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), F.col("_lead.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that lead their group, all columns kept; of equal rows one stays.

    Columns of ``docs`` may have any names: those used inside give way. Texts are read whole, however long.
    """
    groups = near_copies(docs, shingle_words, max_bits, id_col, text_col)
    leads = groups.where((F.col("_lead.id").eqNullSafe(F.col("_id"))) & (F.col("_lead.mark") == F.col("_mark")))
    lead_id, lead_mark, lead_rows = (fresh(n, docs.columns) for n in ("_lead_id", "_lead_mark", "_lead_rows"))
    leads = stage(leads.groupBy(F.col("_id").alias(lead_id), F.col("_mark").alias(lead_mark)).agg(F.count("*").alias(lead_rows)), "simhash-kept")
    ident = docs["`" + id_col.replace("`", "``") + "`"]
    # never broadcast: the list grows with the documents
    kept = docs.join(leads.hint("shuffle_hash"), ident.eqNullSafe(F.col(lead_id)) & (mark_of(docs, text_col) == F.col(lead_mark)))
    once = kept.where(F.col(lead_rows) == 1).select(*[col(c) for c in docs.columns])
    if leads.where(F.col(lead_rows) > 1).isEmpty():
        return once
    return once.unionByName(kept.where(F.col(lead_rows) > 1).dropDuplicates([lead_id, lead_mark]).select(*[col(c) for c in docs.columns]))
