"""Suite queries for semantic steps; their models are offline rules, so SQL can say the same."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import functions as F

from semtab.functions import claims as C
from semtab.functions.sql import qa_over, register_sql_functions
from semtab.functions.tables import blocking_index
from semtab.models.base import HashEmbedder, RuleModel, labelled_values, parts_of
from semtab.models.memo import recorded, usage_of
from semtab.operators import values as V
from semtab.operators.cascade import sem_filter_cascade
from semtab.operators.clustering import cluster_summary, sem_cluster_by
from semtab.operators.folding import sem_agg, sem_partition_by
from semtab.operators.matching import JoinCascade, sem_join
from semtab.operators.ranking import sem_topk
from semtab.operators.semantic import sem_extract, sem_filter, sem_filter_batch, sem_map
from semtab.plans.steps import Step, run_steps
from semtab.runtime import staging_root
from semtab.suite import rules as R
from semtab.suite.registry import query

WIDGET = R.judge(lambda c: "widget" in R.value(c))
IS_WIDGET = "{p_name} is a widget"


def flagship(t):
    """Join, judge and count: how many line items are for a widget."""
    joined = V.join(t.lineitem, t.part, "l_partkey", "p_partkey")
    return V.agg(sem_filter(joined, IS_WIDGET, WIDGET), "l_orderkey", "count")


query("""SELECT count(l_orderkey) AS l_orderkey_count FROM lineitem JOIN part ON l_partkey = p_partkey
         WHERE p_name LIKE '%widget%'""", name="join_filter_count")(flagship)


# --- filter ----------------------------------------------------------------


@query("SELECT * FROM part WHERE p_name LIKE '%widget%'", name="sem_filter")
def filter_(t):
    return sem_filter(t.part, IS_WIDGET, WIDGET)


@query("""SELECT doc_id, lang, n_chars FROM documents WHERE strpos(text, 'License') > 0 OR strpos(text, 'license') > 0""",
       name="sem_filter_documents")
def filter_documents(t):
    out = sem_filter(t.documents, "{text} mentions a license",
                     R.judge(lambda c: "License" in c or "license" in c))
    return out.select("doc_id", "lang", "n_chars")


@query("""SELECT p_partkey, p_name, 'read from the text' AS explanation_filter FROM part
          WHERE p_name LIKE '%widget%' AND p_brand <> 'Brand#7'""")
def sem_filter_reasoned(t):
    model = R.judge(lambda c: "widget" in R.value(c) and R.value(c, 1) != "Brand#7")
    out = sem_filter(t.part, "{p_name} by {p_brand} is a good widget", model, strategy="zs-cot", explain=True)
    return out.select("p_partkey", "p_name", "explanation_filter")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%gear'")
def few_shot(t):
    """The answer depends on the worked examples that come with the prompt."""

    def rule(spec, c):
        liked = {R.value(s.context).split()[-1] for s in spec.shots if s.answer == "True"}
        return str(R.value(c).split()[-1] in liked)

    examples = pd.DataFrame({"p_name": ["red gear", "red bolt"], "Answer": [True, False]})
    return sem_filter(t.part, "{p_name} is alike", RuleModel(rule), examples=examples).select("p_partkey", "p_name")


@query("SELECT * FROM part WHERE p_name LIKE '%widget%'", name="sem_filter_batch")
def filter_batch(t):
    return sem_filter_batch(t.part, IS_WIDGET, R.batch_judge(lambda v: "widget" in v), rows_per_prompt=5)


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%'", name="sem_filter_cascade")
def filter_cascade(t):
    helper = R.judge(lambda c: "widget" in R.value(c), chance=lambda spec, c: 0.8)
    return sem_filter_cascade(
        t.part, IS_WIDGET, WIDGET, helper, sample=0.5, recall_target=0.9, precision_target=0.9,
        failure_probability=0.2,
    ).select("p_partkey", "p_name")


# --- map, extract ----------------------------------------------------------


@query("SELECT *, split_part(p_name, ' ', 1) AS _map FROM part", name="sem_map")
def map_(t):
    return sem_map(t.part, "Say the quality named in {p_name}", R.mapper(lambda c: R.value(c).split()[0]))


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS _map_x, split_part(p_name, ' ', 2) AS _map_y FROM part""")
def sem_map_twice(t):
    once = sem_map(t.part, "first word of {p_name}", R.mapper(lambda c: R.value(c).split()[0]))
    twice = sem_map(once, "last word of {p_name}", R.mapper(lambda c: R.value(c).split()[1]))
    return twice.select("p_partkey", "_map_x", "_map_y")


@query("SELECT doc_id, CAST(length(text) AS VARCHAR) AS length FROM documents")
def sem_map_documents(t):
    out = sem_map(t.documents, "How long is {text}?", R.mapper(lambda c: len(R.whole(c))), out="length")
    return out.select("doc_id", "length")


@query("""SELECT p_partkey, regexp_extract(p_brand, '(\\d+)', 1) AS number, lower(p_type) AS kind FROM part""",
       name="sem_extract")
def extract(t):
    model = R.extractor(lambda c: {"number": re.search(r"\d+", R.value(c)).group(), "kind": R.value(c, 1).lower()})
    out = sem_extract(t.part, ["p_brand", "p_type"], {"number": "digits of the brand", "kind": None}, model)
    return out.select("p_partkey", "number", "kind")


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
                 regexp_extract(html, '(<title>[^<]*</title>)', 1) AS title_quote FROM pages""")
def sem_extract_pages(t):
    def read(c):
        found = re.search(r"<title>([^<]*)</title>", c)
        return {"title": found.group(1) if found else "", "title_quote": found.group(0) if found else ""}

    return sem_extract(t.pages, ["html"], ["title"], R.extractor(read), quotes=True).select(
        "page_id", "title", "title_quote")


# --- join ------------------------------------------------------------------

_SAME_NUMBER = "{p_brand:left} has the number of {s_name:right}"


@query("""SELECT p_partkey, p_brand, s_suppkey, s_name FROM part JOIN supplier
          ON CAST(split_part(p_brand, '#', 2) AS BIGINT) = CAST(split_part(s_name, '#', 2) AS BIGINT)""",
       name="sem_join")
def join_(t):
    model = R.judge(lambda c: R.trailing_number(R.value(c)) == R.trailing_number(R.value(c, 1)))
    return sem_join(t.part.select("p_partkey", "p_brand"), t.supplier.select("s_suppkey", "s_name"), _SAME_NUMBER, model)


@query("""SELECT a.c_custkey, a.c_mktsegment AS "c_mktsegment:left", b.n AS n, b.c_mktsegment AS "c_mktsegment:right"
          FROM customer a JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) b
          ON left(a.c_mktsegment, 1) = left(b.c_mktsegment, 1)""")
def sem_join_clash(t):
    sizes = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    model = R.judge(lambda c: R.value(c)[0] == R.value(c, 1)[0])
    return sem_join(t.customer.select("c_custkey", "c_mktsegment"), sizes,
                    "{c_mktsegment:left} begins like {c_mktsegment:right}", model)


@query("""SELECT p_partkey, p_brand, s_suppkey, s_name FROM part JOIN supplier
          ON CAST(split_part(p_brand, '#', 2) AS BIGINT) = CAST(split_part(s_name, '#', 2) AS BIGINT)""")
def sem_join_candidates(t):
    """Only pairs outside of which nothing can hold are judged: brand and supplier with the same last digit."""
    brands = t.part.select("p_brand", F.regexp_extract("p_brand", r"(\d)$", 1).alias("d")).distinct()
    suppliers = t.supplier.select("s_suppkey", "s_name")
    names = suppliers.select("s_name", F.regexp_extract("s_name", r"(\d)$", 1).alias("d")).distinct()
    model = R.judge(lambda c: R.trailing_number(R.value(c)) == R.trailing_number(R.value(c, 1)))
    return sem_join(t.part.select("p_partkey", "p_brand"), suppliers, _SAME_NUMBER, model,
                    candidates=brands.join(names, "d").select("p_brand", "s_name"))


@query("""SELECT p_partkey, p_name, n_parts FROM part JOIN (SELECT p_name AS label, count(*) AS n_parts FROM part GROUP BY 1)
          ON p_name = label""", name="sem_join_cascade")
def join_cascade(t):
    right = t.part.groupBy(F.col("p_name").alias("label")).agg(F.count("*").alias("n_parts"))

    def rule(spec, c):
        return R.value(c) if spec.task == "map" else str(R.value(c) == R.value(c, 1))

    cascade = JoinCascade(HashEmbedder(512), recall_target=1.0, precision_target=1.0)
    out = sem_join(t.part, right, "{p_name:left} is the same thing as {label:right}", RuleModel(rule), cascade=cascade)
    return out.select("p_partkey", "p_name", "n_parts")


@query("""SELECT o_orderkey, r_name, CAST(1992 + r_regionkey AS VARCHAR) AS label FROM orders
          JOIN region ON substr(CAST(o_orderdate AS VARCHAR), 1, 4) = CAST(1992 + r_regionkey AS VARCHAR)""")
def sem_join_dates(t):
    """A column of dates against one of texts: values are judged and joined as text."""
    days = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    years = t.region.select("r_name", (F.col("r_regionkey") + 1992).cast("string").alias("label"))
    rule = R.judge(lambda c: R.value(c)[:4] == R.value(c, 1))
    return sem_join(days, years, "{day:left} lies in {label:right}", rule).select("o_orderkey", "r_name", "label")


@query("""SELECT p_partkey, label FROM part JOIN (SELECT DISTINCT p_name AS label FROM part)
          ON split_part(p_name, ' ', 1) = split_part(label, ' ', 1)""")
def sem_join_grid(t):
    """Both lists beyond the size that is broadcast: every pair of chunks is one task."""
    right = t.part.select(F.col("p_name").alias("label")).distinct()
    rule = R.judge(lambda c: R.value(c).split()[0] == R.value(c, 1).split()[0])
    out = sem_join(t.part, right, "{p_name:left} begins as {label:right}", rule, broadcast_bytes=0, block_values=16)
    return out.select("p_partkey", "label")


# --- ranking ---------------------------------------------------------------

_TOP = "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 40"
_FIRST = "Which {p_name} comes first in the alphabet?"


def _add_topk(name: str, **options) -> None:
    def run(t):
        return sem_topk(t.part, _FIRST, 40, R.ALPHABET, key="p_partkey", **options).select("p_partkey", "p_name")

    query(_TOP, name=name)(run)


_add_topk("sem_topk_quick")
_add_topk("sem_topk_heap", method="heap")
_add_topk("sem_topk_naive", method="naive")
_add_topk("sem_topk_cascade", cascade=(R.ALPHABET, 0.5))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 40")
def sem_topk_quick_sem(t):
    out = sem_topk(t.customer, "Which {c_name} comes first?", 40, R.ALPHABET, key="c_custkey", method="quick-sem",
                   embedder=HashEmbedder(32))
    return out.select("c_custkey", "c_name")


@query("""SELECT p_partkey, p_name, p_brand, CAST(place AS INTEGER) AS place FROM
          (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS place FROM part)
          WHERE place <= 3""")
def sem_topk_group(t):
    out = sem_topk(t.part, _FIRST, 3, R.ALPHABET, key="p_partkey", group_by="p_brand", rank="place")
    return out.select("p_partkey", "p_name", "p_brand", "place")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 10")
def sem_topk_rounds(t):
    """More documents than one task may take: several rounds of splitting."""
    out = sem_topk(t.customer, "Which {c_name} comes first?", 10, R.ALPHABET, key="c_custkey", local_rows=256)
    return out.select("c_custkey", "c_name")


# --- folding ---------------------------------------------------------------


@query("SELECT max(p_name) AS _output FROM part", name="sem_agg")
def agg_(t):
    return sem_agg(t.part, "Name the last {p_name} in the alphabet", R.LARGEST)


@query("SELECT p_brand, max(p_name) AS _output FROM part GROUP BY p_brand")
def sem_agg_group(t):
    return sem_agg(t.part, "Name the last {p_name} in the alphabet", R.LARGEST, group_by="p_brand")


@query("SELECT conv_id, arg_max(text, turn) AS _output FROM conversations GROUP BY conv_id")
def sem_agg_ordered(t):
    """Folding keeps order: the answer is the last turn of each conversation."""
    return sem_agg(t.conversations, "What was said last in {text}?", R.LAST, group_by="conv_id", order_by="turn")


@query("SELECT lang, CAST(max(length(text)) AS VARCHAR) AS _output FROM documents GROUP BY lang")
def sem_agg_documents(t):
    return sem_agg(t.documents, "How long is the longest {text}?", R.LONGEST, group_by="lang")


@query("""SELECT CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE event_type || user_id % 5 END AS g, CAST(max(event_id) AS VARCHAR) AS _output FROM events GROUP BY 1""")
def sem_agg_skewed(t):
    """One group holds a third of the events and needs several levels; the small ones leave after the first."""
    events = t.events.withColumn("g", F.when(F.col("user_id") % 3 == 0, "hot").otherwise(F.concat("event_type", F.col("user_id") % 5)))
    largest = RuleModel(lambda spec, c: str(max(int(R.whole(p) if spec.task == "fold" else p) for p in parts_of(c))), context_tokens=900, reply_tokens=100)
    return sem_agg(events, "Which {event_id} is the largest?", largest, group_by="g")


@query("SELECT p_brand, max(p_name) AS _output FROM part GROUP BY p_brand")
def sem_agg_partitions(t):
    marked = sem_partition_by(t.part, F.pmod("p_size", F.lit(4)))
    return sem_agg(marked, "Name the last {p_name}", R.LARGEST, group_by="p_brand", partition_by="_partition_id")


@query("SELECT p_partkey, CAST(p_size % 4 AS INTEGER) AS _partition_id FROM part", name="sem_partition_by")
def partition_by(t):
    return sem_partition_by(t.part, F.pmod("p_size", F.lit(4))).select("p_partkey", "_partition_id")


# --- clusters --------------------------------------------------------------


def _clusters_sql(k: int, rounds: int) -> str:
    """K-means in SQL, step by step: farthest-first centres, then rounds of assignment and means. Ends in a table ``a`` of ``id c``."""
    near = "round(list_distance(e.v, s.v), 9)"
    steps = ["e AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
             "s0 AS MATERIALIZED (SELECT 0 AS c, arg_min(v, id) AS v FROM e)"]
    for c in range(1, k):
        steps.append(f"""s{c} AS MATERIALIZED (SELECT * FROM s{c - 1} UNION ALL SELECT {c}, v FROM (
            SELECT e.id, any_value(e.v) AS v, min({near}) AS d FROM e, s{c - 1} s GROUP BY e.id ORDER BY d DESC, e.id LIMIT 1))""")
    before = f"s{k - 1}"
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT id, v, c FROM (SELECT e.id, e.v, s.c, row_number() OVER (PARTITION BY e.id ORDER BY {near}, s.c) AS o FROM e, {before} s) WHERE o = 1)")
        steps.append(f"""m{n} AS MATERIALIZED (SELECT old.c, coalesce(new.v, old.v) AS v FROM {before} old LEFT JOIN (
            SELECT c, list(x ORDER BY p) AS v FROM (SELECT c, p, round(avg(x), 9) AS x FROM
                (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{n}) GROUP BY c, p) GROUP BY c) new ON old.c = new.c)""")
        before = f"m{n}"
    return f"WITH {', '.join(steps)}, a AS (SELECT id, c FROM a{rounds})"


@query(_clusters_sql(8, 10) + " SELECT id AS vec_id, CAST(c AS INTEGER) AS cluster_id FROM a", name="sem_cluster_by")
def cluster_by(t):
    return sem_cluster_by(t.embeddings, "embedding", 8, max_iter=10, key="vec_id").select("vec_id", "cluster_id")


@query(_clusters_sql(8, 10) + " SELECT max('vector ' || id) AS summary, count(*) AS vec_id_count FROM a GROUP BY c", name="cluster_summary")
def cluster_summary_(t):
    named = t.embeddings.withColumn("name", F.concat(F.lit("vector "), "vec_id"))
    return cluster_summary(named, "name", "embedding", 8, "vec_id", "count", R.LARGEST, max_iter=10, key="vec_id")


# --- reading claims and replies --------------------------------------------


@query("""SELECT holes, count(*) AS n FROM
          (SELECT 'p_name,' || CASE WHEN p_size % 2 = 0 THEN 'p_brand' ELSE 'p_type:left' END AS holes FROM part)
          GROUP BY holes""")
def claim_holes(t):
    claim = F.concat(F.lit("{p_name} of {{x}} in {"), F.when(F.col("p_size") % 2 == 0, "p_brand").otherwise("p_type:left"), F.lit("}"))
    out = t.part.select(F.array_join(C.holes_column(claim), ",").alias("holes"))
    return out.groupBy("holes").agg(F.count("*").alias("n"))


@query("""SELECT '[P_name]: «' || p_name || '»' || chr(10) || '[P_size]: «' || p_size || '»' || chr(10) AS text,
                 CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1""")
def prompt_text(t):
    return t.part.select(C.row_text(t.part, ["p_name", "p_size"]).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, '[P_name:left]: «' || p_name || '»' || chr(10) || chr(10) ||
                 '[P_brand:right]: «' || p_brand || '»' || chr(10) AS text FROM part""")
def pair_text(t):
    text = C.pair_text(C.row_text(t.part, ["p_name"], ["p_name:left"]), C.row_text(t.part, ["p_brand"], ["p_brand:right"]))
    return t.part.select("p_partkey", text.alias("text"))


@query("""WITH r AS (SELECT doc_id, text || chr(10) || chr(10) || 'Answer: ' || CASE WHEN n_chars % 2 = 0 THEN 'True' ELSE 'False' END AS said
                     FROM documents),
               a AS (SELECT doc_id, substr(said, strpos(said, 'Answer:') + 7) AS answer,
                            regexp_replace(substr(said, 1, strpos(said, 'Answer:') - 1), '^\\n+|\\n+$', '', 'g') AS why FROM r)
          SELECT doc_id, contains(answer, 'True') AS verdict, why, answer FROM a""")
def parse_cot(t):
    docs = t.documents
    reply = F.concat(F.lit("Reasoning:\n"), "text", F.lit("\n\nAnswer: "), F.when(F.col("n_chars") % 2 == 0, "True").otherwise("False"))
    replies = docs.select("doc_id", reply.alias("r"))
    return replies.select("doc_id", C.bool_of(C.answer_of(F.col("r"))).alias("verdict"),
                          C.explanation_of(F.col("r")).alias("why"), C.answer_of(F.col("r")).alias("answer"))


@query("SELECT event_id, contains(event_type, 'e') AS verdict FROM events")
def parse_bool(t):
    reply = F.when(F.col("event_type").contains("e"), F.concat(F.lit("True: "), "event_type")).otherwise("It is False.")
    return t.events.select("event_id", C.bool_of(reply).alias("verdict"))


@query("SELECT o_orderkey, CAST(o_orderkey % 2 + 1 AS INTEGER) AS choice FROM orders")
def parse_choice(t):
    number = (F.col("o_orderkey") % 2 + 1).cast("string")
    reply = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Document 1 or Document 2? Document "), number)).otherwise(
        F.concat(F.lit("number "), number))
    return t.orders.select("o_orderkey", C.choice_of(reply).alias("choice"))


# --- models as data --------------------------------------------------------


@query("""SELECT count(DISTINCT p_name) AS calls, CAST(0 AS BIGINT) AS calls_again,
                 count(DISTINCT p_name) AS cache_hits_again FROM part""")
def usage_stats(t):
    """One call per distinct input; a second run with the same memo makes none."""
    memo = f"{staging_root(t.spark).rstrip('/')}/semtab-suite/{uuid.uuid4().hex}"
    _, first = sem_filter(t.part, IS_WIDGET, WIDGET, memo=memo, stats=True)
    calls = first.select("calls")
    first_calls = calls.first()["calls"]
    _, again = sem_filter(t.part, IS_WIDGET, WIDGET, memo=memo, stats=True)
    return again.select(F.lit(first_calls).cast("long").alias("calls"), F.col("calls").alias("calls_again"),
                        F.col("cache_hits").alias("cache_hits_again"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS _map FROM part")
def answer_memo(t):
    memo = f"{staging_root(t.spark).rstrip('/')}/semtab-suite/{uuid.uuid4().hex}"
    model = R.mapper(lambda c: R.value(c).split()[0])
    out = sem_map(t.part, "first word of {p_name}", model, memo=memo)
    return out.select("p_partkey", "_map")


def _folder(t) -> str:
    return f"{staging_root(t.spark).rstrip('/')}/semtab-suite/{uuid.uuid4().hex}"


def _call(name: str, t, model):
    """One call of an operator whose model calls stay inside tasks."""
    if name == "sem_join":
        return sem_join(t.nation, t.region, "{n_name:left} lies in {r_name:right}", model)
    if name == "sem_topk":
        return sem_topk(t.part, "Which {p_name} comes first?", 5, model, key="p_partkey")
    if name == "sem_agg":
        return sem_agg(t.part, "Which {p_name} is the last?", model, group_by="p_brand")
    if name == "sem_filter_batch":
        return sem_filter_batch(t.part, "{p_type} is cheap", model, rows_per_prompt=3)
    return sem_filter_cascade(t.part, IS_WIDGET, model, model, sample=0.2, recall_target=0.9, precision_target=0.9, failure_probability=0.2)


def _any_task(spec, c: str) -> str:
    if spec.task == "compare":
        return R.earlier(c)
    if spec.task in ("fold", "fold_again"):
        return max(parts_of(c))
    if spec.task == "judge_list":
        return str([v.startswith("ECO") for _, v in labelled_values(c)])
    return str("widget" in c or "1" in c)


@query("""SELECT * FROM (VALUES ('sem_join'), ('sem_topk'), ('sem_agg'), ('sem_filter_batch'), ('sem_filter_cascade')) o(step),
          (VALUES (true, CAST(0 AS BIGINT), true)) v(asked_first, calls_again, hits_again)""")
def answer_memo_every_operator(t):
    """A second run over a filled memo asks nothing, whichever operator asks."""
    folder, runs = _folder(t), []
    for _ in range(2):
        model = recorded(t.spark, RuleModel(_any_task, chance=lambda spec, c: 0.9, context_tokens=600, reply_tokens=100), folder)
        runs.append(model.run)
        for name in ("sem_join", "sem_topk", "sem_agg", "sem_filter_batch", "sem_filter_cascade"):
            _call(name, t, model.at(name)).write.format("noop").mode("overwrite").save()
    first, again = (usage_of(t.spark, folder, r) for r in runs)
    both = first.select("step", (F.col("calls") > 0).alias("asked_first")).join(again.select("step", F.col("calls").alias("calls_again"), (F.col("hits") > 0).alias("hits_again")), "step")
    return both.select("step", "asked_first", "calls_again", "hits_again")


@query("SELECT count(*) AS calls FROM (SELECT DISTINCT n_name FROM nation), (SELECT DISTINCT r_name FROM region)")
def usage_join(t):
    model = recorded(t.spark, RuleModel(_any_task), _folder(t), "sem_join", remember=False)
    sem_join(t.nation, t.region, "{n_name:left} lies in {r_name:right}", model).count()
    return usage_of(t.spark, model.folder, model.run).select("calls")


@query("SELECT count(*) AS calls FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name")
def usage_topk(t):
    """Each pair of distinct names is compared once."""
    model = recorded(t.spark, R.ALPHABET, _folder(t), "sem_topk", remember=False)
    sem_topk(t.part, "Which {p_name} comes first?", 5, model, key="p_partkey", method="naive").count()
    return usage_of(t.spark, model.folder, model.run).select("calls")


@query("SELECT true AS same_calls, true AS more_than_groups")
def usage_agg(t):
    """Recorded calls, and repeated prompts of a batch that need none, are the prompts that the fold itself counts."""
    model = recorded(t.spark, RuleModel(_any_task, context_tokens=600, reply_tokens=100), _folder(t), "sem_agg", remember=False)
    _, stats = sem_agg(t.part, "Which {p_name} is the last?", model, group_by="p_brand", stats=True)
    groups = t.part.select("p_brand").distinct().count()
    used = usage_of(t.spark, model.folder, model.run)
    return used.select((F.col("calls") + F.col("hits") == stats["total_llm_calls"]).alias("same_calls"), (F.col("calls") >= groups).alias("more_than_groups"))


@query("""SELECT '1 sem_filter' AS step, count(DISTINCT p_name) AS calls FROM part WHERE p_size > 10
          UNION ALL SELECT '2 sem_map', count(DISTINCT p_name) FROM part WHERE p_size > 10 AND p_name LIKE '%widget%'""")
def usage_steps(t):
    steps = [
        Step("filter", "part", ("p_size", (("gt", 10),))),
        Step("sem_filter", "part_filter", (IS_WIDGET,)),
        Step("sem_map", "part_filter_sem_filter", ("What thing is {p_name}?",)),
    ]
    model = recorded(t.spark, RuleModel(_any_task), _folder(t), remember=False)
    run_steps({"part": t.part}, steps, model)
    return usage_of(t.spark, model.folder, model.run).select("step", "calls")


# --- SQL functions ---------------------------------------------------------

SQL_MODEL = RuleModel(
    lambda spec, c: R.value(c).split()[0] if spec.task == "map"
    else str(R.value(c)[-1] == R.value(c, 1)[-1]) if spec.task == "judge"
    else max(c.split("\n\tDocument ")[1:], key=lambda d: d.partition(": ")[2]).partition(": ")[2]
)


@query("SELECT split_part(p_name, ' ', 1) AS quality, count(*) AS n FROM part GROUP BY 1")
def llm_map_sql(t):
    """Each distinct name is asked once; the answers are joined back."""
    register_sql_functions(t.spark, SQL_MODEL)
    return t.spark.sql(
        """SELECT answer AS quality, count(*) AS n FROM {part}
           JOIN llm_map(TABLE(SELECT DISTINCT p_name FROM {part}), 'Which quality?', 'p_name') USING (p_name) GROUP BY answer""",
        part=t.part)


@query("SELECT split_part(p_name, ' ', 1) AS quality, count(*) AS n FROM part GROUP BY 1")
def llm_map_scalar(t):
    register_sql_functions(t.spark, SQL_MODEL)
    return t.spark.sql(
        "SELECT quality, count(*) AS n FROM (SELECT llm_map('Which quality?', p_name) AS quality FROM {part}) GROUP BY quality",
        part=t.part)


_ENDINGS = """SELECT p_brand, s_name FROM (SELECT DISTINCT p_brand, p_size FROM part) JOIN supplier
          ON p_size = s_nationkey AND right(p_brand, 1) = right(s_name, 1)"""


@query(_ENDINGS)
def llm_join_sql(t):
    """Brands and suppliers are judged where a size equals a nation key; the pairs are made inside the tasks."""
    register_sql_functions(t.spark, SQL_MODEL)
    pairs = blocking_index(t.part, t.supplier, "p_brand", "s_name", "p_size", "s_nationkey")
    return t.spark.sql(
        """SELECT b.p_brand, s.s_name FROM (SELECT DISTINCT p_brand, p_size FROM {part}) b
           JOIN llm_join(TABLE(SELECT * FROM {pairs}), 'same ending') j ON b.p_brand = j.left
           JOIN {supplier} s ON s.s_name = j.right AND b.p_size = s.s_nationkey""",
        part=t.part, pairs=pairs, supplier=t.supplier)


@query(_ENDINGS)
def llm_join_scalar(t):
    """An equality beside the judged condition keeps the pairs few."""
    register_sql_functions(t.spark, SQL_MODEL)
    return t.spark.sql(
        """SELECT p_brand, s_name FROM {brands} JOIN {suppliers}
           ON p_size = s_nationkey AND llm_join('same ending', p_brand, s_name)""",
        brands=t.part.select("p_brand", "p_size").distinct(), suppliers=t.supplier)


@query("""WITH n AS (SELECT DISTINCT p_name AS name, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS word FROM part)
          SELECT a.name AS "left", b.name AS "right", CAST(1 AS BIGINT) AS asked FROM n a JOIN n b ON a.word = b.word GROUP BY ALL""")
def llm_join_blocks(t):
    """Names that share a word, in cells of four names: a pair that shares two words, or meets in a large block, is asked once."""
    register_sql_functions(t.spark, RuleModel(lambda spec, c: "True"))
    words = t.part.select("p_name", F.explode(F.split("p_name", " ")).alias("word"))
    pairs = blocking_index(words, words, "p_name", "p_name", "word", "word", cell_values=4)
    return t.spark.sql("SELECT left, right, count(*) AS asked FROM llm_join(TABLE(SELECT * FROM {pairs}), 'any') GROUP BY left, right", pairs=pairs)


@query("SELECT p_brand, max(p_name) AS answer FROM part GROUP BY p_brand")
def llm_qa_sql(t):
    """Groups are read as streams, a prompt of rows at a time."""
    register_sql_functions(t.spark, RuleModel(lambda spec, c: max(parts_of(c)), context_tokens=400, reply_tokens=100))
    return t.spark.sql(
        """SELECT p_brand, answer FROM llm_qa(TABLE(SELECT DISTINCT p_brand, p_name FROM {part}) PARTITION BY p_brand ORDER BY (p_name),
           'Which comes last?', 'p_name', 'p_brand')""",
        part=t.part)


@query("SELECT p_brand, max(p_name) AS answer FROM part GROUP BY p_brand")
def llm_qa_scalar(t):
    register_sql_functions(t.spark, SQL_MODEL)
    return t.spark.sql("SELECT p_brand, llm_qa('Which comes last?', p_name) AS answer FROM {part} GROUP BY p_brand",
                       part=t.part.select("p_brand", "p_name").distinct())


@query("""SELECT CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE event_type END AS event_type, CAST(max(event_id) AS VARCHAR) AS answer
          FROM events GROUP BY 1""")
def llm_qa_sliced(t):
    """A group that holds a third of the events is read in slices by many tasks; the answers are folded once more."""
    latest = RuleModel(lambda spec, c: str(max(map(int, parts_of(c)))), context_tokens=600, reply_tokens=100)
    register_sql_functions(t.spark, latest)
    return t.spark.sql(
        """WITH e AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE event_type END AS event_type, user_id % 64 AS slice,
                             event_id FROM {events})
           SELECT event_type, answer FROM llm_qa(TABLE(
               SELECT * FROM llm_qa(TABLE(SELECT * FROM e) PARTITION BY (event_type, slice) ORDER BY (event_id), 'What came last?', 'event_id', 'event_type,slice')
           ) PARTITION BY event_type ORDER BY (slice), 'What came last?', 'answer', 'event_type', true)""",
        events=t.events)


@query("SELECT max(p_name) AS Answer FROM part WHERE p_type = 'ECONOMY'")
def llm_qa_over(t):
    return qa_over(t.part.where("p_type = 'ECONOMY'").select("p_name"), "Which comes last?", R.LARGEST)


# --- stored processes ------------------------------------------------------


@query("""WITH top AS (SELECT * FROM (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name LIKE '%widget%'
                 AND l_quantity > 45) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100)
          SELECT round(avg(l_extendedprice), 4) AS l_extendedprice_mean FROM top""")
def run_steps_selection(t):
    steps = [
        Step("join", "lineitem", ("part", "l_partkey", "p_partkey")),
        Step("sem_filter", "lineitem_join", (IS_WIDGET,)),
        Step("filter", "lineitem_join_sem_filter", ("l_quantity", (("gt", 45),))),
        Step("orderby", "lineitem_join_sem_filter_filter", (["l_extendedprice"], "desc"),
             {"tie_break": ["l_orderkey", "l_linenumber", "l_partkey"]}),
        Step("head", "lineitem_join_sem_filter_filter_orderby", (100,)),
        Step("agg", "lineitem_join_sem_filter_filter_orderby_head", ("l_extendedprice", "mean")),
    ]
    run = run_steps({"lineitem": t.lineitem, "part": t.part}, steps, WIDGET)
    return run.answer.select(F.round("l_extendedprice_mean", 4).alias("l_extendedprice_mean"))


_ALL = RuleModel(lambda spec, c: R.earlier(c) if spec.task == "compare" else R.value(c).split()[-1])


@query("SELECT p_name, split_part(p_name, ' ', 2) AS _map FROM part WHERE p_size > 10 ORDER BY p_name, p_partkey LIMIT 5")
def run_steps_transformation(t):
    steps = [
        Step("filter", "part", ("p_size", (("gt", 10),))),
        Step("sem_topk", "part_filter", (_FIRST, 5), {"key": "p_partkey"}),
        Step("sem_map", "part_filter_sem_topk", ("What thing is {p_name}?",)),
        Step("map", "part_filter_sem_topk_sem_map", (["p_name", "_map"],)),
    ]
    return run_steps({"part": t.part}, steps, _ALL).answer


@query("""SELECT p_brand, s_name FROM (SELECT * FROM part WHERE p_size > 20) JOIN supplier
          ON CAST(split_part(p_brand, '#', 2) AS BIGINT) = CAST(split_part(s_name, '#', 2) AS BIGINT)
          WHERE s_suppkey > 3 ORDER BY p_partkey DESC, s_suppkey LIMIT 20""")
def run_steps_linking(t):
    """Link by meaning, filter, sort, cut, project."""
    model = R.judge(lambda c: R.trailing_number(R.value(c)) == R.trailing_number(R.value(c, 1)))
    steps = [
        Step("filter", "part", ("p_size", (("gt", 20),))),
        Step("sem_join", "part_filter", ("supplier", _SAME_NUMBER)),
        Step("filter", "part_filter_sem_join", ("s_suppkey", (("gt", 3),))),
        Step("orderby", "part_filter_sem_join_filter", (["p_partkey"], "desc"), {"tie_break": ["s_suppkey"]}),
        Step("head", "part_filter_sem_join_filter_orderby", (20,)),
        Step("map", "part_filter_sem_join_filter_orderby_head", (["p_brand", "s_name"],)),
    ]
    return run_steps({"part": t.part, "supplier": t.supplier}, steps, model).answer


@query("""SELECT c_name FROM (SELECT DISTINCT c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 1000 AND n_name <> 'NATION_3')
          ORDER BY c_name LIMIT 6""")
def run_steps_ranking(t):
    """Join, filter, rank by meaning, project."""
    steps = [
        Step("join", "customer", ("nation", "c_nationkey", "n_nationkey")),
        Step("filter", "customer_join", ("c_acctbal", (("gt", 1000),))),
        Step("filter", "customer_join_filter", ("n_name", (("ne", "NATION_3"),))),
        Step("sem_topk", "customer_join_filter_filter", ("Which {c_name} comes first?", 6), {"key": "c_custkey"}),
        Step("map", "customer_join_filter_filter_sem_topk", (["c_name"],)),
    ]
    return run_steps({"customer": t.customer, "nation": t.nation}, steps, R.ALPHABET).answer


@query("""SELECT p_type AS summary, CAST(sum(l_quantity) AS DOUBLE) AS l_quantity_sum FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 10
          GROUP BY p_type HAVING sum(l_quantity) > 10""")
def run_steps_group(t):
    """Join, filter, cluster by meaning, filter the clusters, project; the texts are as many as the clusters."""
    steps = [
        Step("join", "lineitem", ("part", "l_partkey", "p_partkey")),
        Step("filter", "lineitem_join", ("l_quantity", (("gt", 10),))),
        Step("sem_cluster_by", "lineitem_join_filter", ("p_type", 6, "l_quantity", "sum")),
        Step("filter", "lineitem_join_filter_sem_cluster_by", ("l_quantity_sum", (("gt", 10),))),
        Step("map", "lineitem_join_filter_sem_cluster_by_filter", (["summary", "l_quantity_sum"],)),
    ]
    run = run_steps({"lineitem": t.lineitem, "part": t.part}, steps, R.LARGEST, HashEmbedder(64))
    return run.answer.select("summary", F.col("l_quantity_sum").cast("double").alias("l_quantity_sum"))


@query("""SELECT max(p_name) AS _output FROM (SELECT p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name LIKE '%widget%'
          ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50)""")
def run_steps_summarization(t):
    """Join, filter by meaning, sort, cut, sum up in words."""
    steps = [
        Step("join", "lineitem", ("part", "l_partkey", "p_partkey")),
        Step("sem_filter", "lineitem_join", (IS_WIDGET,)),
        Step("orderby", "lineitem_join_sem_filter", (["l_extendedprice"], "desc"), {"tie_break": ["l_orderkey", "l_linenumber", "l_partkey"]}),
        Step("head", "lineitem_join_sem_filter_orderby", (50,)),
        Step("sem_agg", "lineitem_join_sem_filter_orderby_head", ("Which {p_name} is the last?",)),
    ]
    model = RuleModel(lambda spec, c: R.LARGEST.rule(spec, c) if spec.task in ("fold", "fold_again") else str("widget" in R.value(c)))
    return run_steps({"lineitem": t.lineitem, "part": t.part}, steps, model).answer
