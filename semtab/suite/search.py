"""Suite queries for embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from semtab.models.base import HashEmbedder, OverlapScorer
from semtab.operators import retrieval as E
from semtab.runtime import stage, staging_root
from semtab.suite.registry import query

#: A fixed query vector for the 64-valued test embeddings.
PROBE = [((i * 7) % 11 - 5) / 20 for i in range(64)]
_PROBE_SQL = "[" + ", ".join(map(str, PROBE)) + "]::DOUBLE[]"


@query(f"""SELECT vec_id, label, round(s, 6) AS vec_scores_sim_score FROM
           (SELECT *, round(list_inner_product(embedding::DOUBLE[], {_PROBE_SQL}), 10) AS s FROM embeddings)
           ORDER BY s DESC, vec_id LIMIT 25""")
def sem_search(t):
    out = E.sem_search(t.embeddings, "embedding", PROBE, 25, key="vec_id", scores=True)
    return out.select("vec_id", "label", F.round("vec_scores_sim_score", 6).alias("vec_scores_sim_score"))


@query(f"""SELECT vec_id, label FROM
           (SELECT *, round(list_inner_product(embedding::DOUBLE[], {_PROBE_SQL}), 10) AS s FROM embeddings WHERE label >= 5)
           ORDER BY s DESC, vec_id LIMIT 25""")
def sem_search_filtered(t):
    return E.sem_search(t.embeddings.where("label >= 5"), "embedding", PROBE, 25, key="vec_id").select("vec_id", "label")


@query("""SELECT doc_id FROM (SELECT doc_id, text, list_contains(w, 'the')::INT + list_contains(w, 'and')::INT
            + list_contains(w, 'license')::INT AS s
            FROM (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '[ \\n\\t\\r]+'), lambda x: x <> '') AS w FROM documents))
          ORDER BY s DESC, doc_id LIMIT 30""")
def rerank(t):
    out = E.sem_search(t.documents, None, "the and license", key="doc_id", text_col="text", rerank=OverlapScorer(),
                       n_rerank=30)
    return out.select("doc_id")


@query("""WITH s AS (SELECT a.vec_id AS vec_id_l, b.vec_id AS vec_id_r,
                 round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) AS s
                 FROM embeddings a, embeddings b)
          SELECT vec_id_l, vec_id_r, round(s, 6) AS _scores FROM
          (SELECT *, row_number() OVER (PARTITION BY vec_id_l ORDER BY s DESC, vec_id_r) AS n FROM s) WHERE n <= 3""",
       name="sem_sim_join")
def sim_join(t):
    out = E.sim_join(t.embeddings, t.embeddings, "embedding", "embedding", 3, left_key="vec_id", right_key="vec_id",
                     lsuffix="_l", rsuffix="_r")
    return out.select("vec_id_l", "vec_id_r", F.round("_scores", 6).alias("_scores"))


@query("""WITH s AS (SELECT a.vec_id AS vec_id_l, b.vec_id AS vec_id_r,
                 round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) AS s
                 FROM embeddings a, embeddings b)
          SELECT vec_id_l, vec_id_r, round(s, 6) AS _scores FROM
          (SELECT *, row_number() OVER (PARTITION BY vec_id_l ORDER BY s DESC, vec_id_r) AS n FROM s) WHERE n <= 3""")
def sem_sim_join_cells(t):
    """The same join by cells, as it runs when the right side is too large to broadcast."""
    out = E.sim_join(t.embeddings, t.embeddings, "embedding", "embedding", 3, left_key="vec_id", right_key="vec_id",
                     lsuffix="_l", rsuffix="_r", broadcast_bytes=0, block_rows=1024)
    return out.select("vec_id_l", "vec_id_r", F.round("_scores", 6).alias("_scores"))


@query("SELECT count(*) * 3 AS n, true AS recall_90 FROM embeddings")
def sim_join_approx(t):
    """Sign buckets against the exact join: three hits for every row, nine of ten of them the right ones."""
    e, by = t.embeddings, {"left_key": "vec_id", "right_key": "vec_id", "lsuffix": "_l", "rsuffix": "_r"}
    approx = E.sim_join(e, e, "embedding", "embedding", 3, approx=True, recall=0.95, block_rows=1024, **by).select("vec_id_l", "vec_id_r", F.lit(1).alias("hit"))
    exact = E.sim_join(e, e, "embedding", "embedding", 3, **by).select("vec_id_l", "vec_id_r", F.lit(1).alias("wanted"))
    both = approx.join(exact, ["vec_id_l", "vec_id_r"], "full")
    return both.agg(F.count("hit").alias("n"), (F.count(F.col("hit") + F.col("wanted")) >= 0.9 * F.count("wanted")).alias("recall_90"))


_DEDUP_SQL = """WITH RECURSIVE e AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a, embeddings b
            WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4 AND a.vec_id <> b.vec_id),
          r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
          SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT u FROM r WHERE v < u)"""


@query(_DEDUP_SQL)
def sem_dedup(t):
    return E.sem_dedup(t.embeddings, "vec_id", "embedding", 0.4).select("vec_id", "label")


@query(_DEDUP_SQL)
def sem_dedup_cells(t):
    out = E.sem_dedup(t.embeddings, "vec_id", "embedding", 0.4, broadcast_bytes=0, block_rows=1024)
    return out.select("vec_id", "label")


def _vectors_sql(table: str, key: str) -> str:
    """The vectors of :class:`HashEmbedder` for a table's texts, as ``id v``: signed word counts by MD5, divided by their length in 32-bit floats."""
    return f"""(SELECT id, list(CAST(coalesce(x, 0) / n AS FLOAT)::DOUBLE ORDER BY p) AS v FROM (
            SELECT id, p, x, CASE WHEN n = 0 THEN 1 ELSE n END AS n FROM (SELECT id, CAST(sqrt(sum(x * x)) AS FLOAT)::DOUBLE AS n FROM {{0}} GROUP BY id) JOIN {{0}} USING (id))
          GROUP BY id)""".replace("{0}", f"""(SELECT id, p, coalesce(sum(sign), 0)::DOUBLE AS x FROM (SELECT {key} AS id, unnest(range(64)) AS p FROM {table} WHERE text IS NOT NULL)
            LEFT JOIN (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS p, CASE WHEN CAST('0x' || substr(md5(w), 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END AS sign
                       FROM (SELECT {key} AS id, unnest(string_split_regex(lower(text), '[ \\n\\t\\r]+')) AS w FROM {table}) WHERE w <> '') USING (id, p) GROUP BY id, p)""")


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT text, v FROM (SELECT text, min(doc_id) AS id FROM documents GROUP BY text) JOIN {_vectors_sql('documents', 'doc_id')} USING (id)),
          l AS MATERIALIZED (SELECT a.text AS u, b.text AS v FROM e a, e b WHERE round(list_inner_product(a.v, b.v), 10) > 0.97 AND a.text <> b.text),
          r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
          SELECT doc_id FROM documents WHERE text NOT IN (SELECT u FROM r WHERE v < u)""")
def sem_dedup_text(t):
    # read several times by the next step: written, so that the texts don't move to their vectors each time
    coded = stage(E.embed(t.documents.select("doc_id", "text"), "text", HashEmbedder(64), "vec"), "coded")
    return E.sem_dedup(coded, "text", "vec", 0.97).select("doc_id")


@query("SELECT doc_id, CAST(64 AS INTEGER) AS dim FROM documents")
def sem_index(t):
    path = f"{staging_root(t.spark).rstrip('/')}/semtab-suite/{uuid.uuid4().hex}"
    index = E.sem_index(t.documents, "doc_id", "text", HashEmbedder(64), path)
    out = E.attach_index(t.documents, "doc_id", index)
    return out.select("doc_id", F.size("vec").alias("dim"))


@query(f"""WITH s AS (SELECT d.id AS doc_id, i.id AS item_id, round(list_inner_product(d.v, i.v), 10) AS s
                 FROM {_vectors_sql('documents', 'doc_id')} d, {_vectors_sql('benchmark', 'item_id')} i)
          SELECT doc_id, item_id, round(s, 6) AS _scores FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id) AS n FROM s) WHERE n = 1""")
def sim_join_text(t):
    """The passage of the benchmark table that is most like each document."""
    coder = HashEmbedder(64)
    docs = E.embed(t.documents.select("doc_id", "text"), "text", coder, "vec").drop("text")
    items = E.embed(t.benchmark, "text", coder, "vec")
    out = E.sim_join(docs, items, "vec", "vec", 1, left_key="doc_id", right_key="item_id", lsuffix="_l", rsuffix="_r")
    return out.select("doc_id", "item_id", F.round("_scores", 6).alias("_scores"))
