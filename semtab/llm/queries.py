"""The operators of this package over their whole tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semtab.llm.byte_bpe import decode_ids, encode_texts
from semtab.llm.decontaminate import find_leaks
from semtab.llm.divergence import source_divergence
from semtab.llm.language import held_out, identify_languages, learn_profiles
from semtab.llm.line_dedup import dedup_lines
from semtab.llm.middle import fill_in_middle, restored
from semtab.llm.mixing import mix_sources
from semtab.llm.pii import KINDS, find_personal_data, learn_trees, span_text
from semtab.llm.quality import learn_quality, score_quality
from semtab.llm.rules import judge
from semtab.llm.simhash import simhash_components
from semtab.llm.tokens import count_tokens
from semtab.llm.urls import filter_urls, rule_table
from semtab.runtime import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``f(documents-like reader)`` under its name, with its SQL twin if it has one."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def op1_language_id(table) -> DataFrame:
    docs = table("documents")
    out = held_out("doc_id", 0, 5)
    profiles = learn_profiles(docs, ~out)
    return identify_languages(docs, profiles).withColumn("held_out", out)


@query(
    """
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), word AS (
        SELECT doc_id, unnest(w) AS x FROM d
    ), words AS (
        SELECT doc_id, count(*) FILTER (WHERE upper(x) = x AND lower(x) <> x) AS shouted, count(DISTINCT x) AS variety,
               count(*) FILTER (WHERE regexp_matches(x, '\\p{L}')) AS letters, sum(length(x)) AS word_chars
        FROM word GROUP BY doc_id
    ), line AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d
    ), lines AS (
        SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM line WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
    ), pos AS (
        SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d
    ), win AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM pos
    ), covered AS (
        SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE times > 1) GROUP BY doc_id
    ), f AS (
        SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
               coalesce(shouted, 0) AS shouted, coalesce(variety, 0) AS variety, coalesce(letters, 0) AS letters
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
    ), b AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 100 > n_lines * 40 OR word_chars < n_words * 2 OR word_chars > n_words * 15
                OR shouted * 3 > n_words OR variety * 5 < n_words OR letters * 10 < n_words * 6) AS kept
    FROM b
    """
)
def op2_quality_rules(table) -> DataFrame:
    return judge(table("documents"))


@query()
def op3_quality(table) -> DataFrame:
    docs = table("documents")
    out = held_out("doc_id", 2, 4)
    chain = learn_quality(docs, table("labels"), ~out)
    return score_quality(docs, chain, limit=0.7).withColumn("held_out", out)


@query()
def op4_decontaminate(table) -> DataFrame:
    """One row per document and item it holds."""
    leaks = find_leaks(table("documents"), table("benchmark"), shingle_words=5, similarity=0.8)
    return leaks.select(F.col("_id").alias("doc_id"), F.col("_item").alias("item_id"), "similarity", "start_word")


@query()
def op5_mix_sources(table) -> DataFrame:
    plan = mix_sources(table("documents"))
    each = plan.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    return each.select(
        F.col("_id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


@query()
def op6_personal_data(table) -> DataFrame:
    docs = table("documents")
    found = find_personal_data(docs, learn_trees(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col("_id").alias("doc_id"), *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


@query()
def op7_simhash(table) -> DataFrame:
    return simhash_components(table("documents"), shingle_words=4, max_bits=4)


URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


@query(
    """
    WITH u AS (
        SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), p AS (
        SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM u
    ), r(verdict, h, t) AS (
        VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
    ), fit AS (
        SELECT page_id, h || t AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || t) DESC, length(h) DESC) AS n
        FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t)
    )
    SELECT p.page_id, host, path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
    FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND fit.n = 1
    """
)
def op8_url_filter(table) -> DataFrame:
    pages = table("pages")
    return filter_urls(pages, rule_table(pages.sparkSession, URL_RULES))


@query(
    """
    WITH l AS (
        SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place, unnest(string_split(text, chr(10))) AS raw FROM documents
    ), c AS (
        SELECT doc_id, place, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l WHERE regexp_matches(raw, '[^\\x20\\x09-\\x0D]')
    ), n AS (
        SELECT doc_id, place, line, lead(line) OVER d AS line2, lead(place) OVER d AS place2,
               len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 50 AS long
        FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY place)
    ), r AS (
        SELECT doc_id, [place, place2] AS places, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, place) AS nth FROM n WHERE line2 IS NOT NULL
        UNION ALL
        SELECT doc_id, [place] AS places, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS nth FROM n WHERE long
    ), g AS (
        SELECT DISTINCT doc_id, unnest(places) AS place FROM r WHERE nth > 1
    ), t AS (
        SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL) AS text,
               string_agg(l.place, ',' ORDER BY l.place) FILTER (WHERE g.place IS NOT NULL) AS removed, count(g.place) AS n_removed
        FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id
    )
    SELECT doc_id, n_removed, coalesce(removed, '') AS removed, md5(coalesce(text, '')) AS text_md5 FROM t
    """
)
def op9_line_dedup(table) -> DataFrame:
    out = dedup_lines(table("documents"), min_lines=2, long_words=50, removed_col="_removed")
    return out.select(
        "doc_id",
        F.size("_removed").cast("long").alias("n_removed"),
        F.array_join(F.col("_removed").cast("array<string>"), ",").alias("removed"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


@query()
def op10_token_counts(table) -> DataFrame:
    import public_tokenizers

    return count_tokens(table("documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    """
    WITH d AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
        FROM documents
    ), o AS (
        SELECT id, lang, source, unnest(terms) AS term FROM d
    ), k AS (
        SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3
    ), c AS (
        SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term
    ), l AS (
        SELECT lang, sum(n)::HUGEINT AS total, count(*) AS v FROM k GROUP BY lang
    ), g AS (
        SELECT x.lang, x.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY x.lang, x.source
    ), p AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p,
               1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
        FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
        UNION ALL
        SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM k)
    ), every AS (
        SELECT * FROM pairs
        UNION ALL
        SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every
    )
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """
)
def op11_source_divergence(table) -> DataFrame:
    return source_divergence(table("documents"), least_docs=3, top=200)


@query(
    """
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
               sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    ), r AS (
        SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM d
    ), p AS (
        SELECT *, array_to_string(list_slice(u, 1, least(c1, c2)), '') AS prefix, array_to_string(list_slice(u, least(c1, c2) + 1, greatest(c1, c2)), '') AS middle,
               array_to_string(list_slice(u, greatest(c1, c2) + 1, len(u)), '') AS suffix
        FROM r
    )
    SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
    FROM p
    """
)
def op12_fill_in_middle(table) -> DataFrame:
    out = fill_in_middle(table("documents"), seed=1, rate=90, spm=20)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


@query()
def op13_byte_bpe(table) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = decode_ids(encode_texts(table("documents"), ranks, public_tokenizers.PATTERN), ranks)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
