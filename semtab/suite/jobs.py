"""Suite queries for scoring, sampling, profiling and evaluation jobs."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semtab.models.base import count_tokens as tokens_in
from semtab.models.prompts import PromptSpec
from semtab.operators import cascade as C
from semtab.plans import evaluate as Ev
from semtab.plans import prep as P
from semtab.runtime import stage
from semtab.suite import rules as R
from semtab.suite.registry import query

# --- scores ----------------------------------------------------------------

_STEPS = ", ".join(str(i / 50) for i in range(51))


@query(f"""WITH q AS (SELECT quantile_cont(value, [{_STEPS}]) AS q FROM events)
           SELECT event_id, round(least(greatest((len(list_filter(q.q, lambda e: e <= value)) - 1) / 50.0, 0), 1), 6) AS calibrated
           FROM events, q""")
def calibrate(t):
    return C.calibrate(t.events, "value").select("event_id", F.round("calibrated", 6).alias("calibrated"))


@query("SELECT event_id, least(greatest(value / 10 - 0.5, 0), 1) AS score FROM events")
def clip_scores(t):
    return t.events.select("event_id", C.clip_scores(F.col("value") / 10 - 0.5).alias("score"))


@query("""SELECT event_id, round(CASE WHEN event_type = 'error' THEN 1.0
                 ELSE exp(-value / 10) / (exp(-value / 10) + exp(-1.0)) END, 6) AS p FROM events""")
def true_prob(t):
    top = lambda w, lp: F.struct(F.lit(w).alias("token"), lp.alias("logprob"))
    one = F.array(top("True", F.lit(0.0)))
    both = F.array(top("False", F.lit(-1.0)), top("True", -F.col("value") / 10))
    token = F.struct(F.lit("True").alias("token"), F.lit(0.0).alias("logprob"),
                     F.when(F.col("event_type") == "error", one).otherwise(both).alias("top"))
    reply = t.events.select("event_id", F.struct(F.array(token).alias("logprobs")).alias("r"))
    return reply.select("event_id", F.round(C.true_prob(F.col("r")), 6).alias("p"))


@query("""WITH a AS (SELECT count(*) AS n, sum(sqrt(value / 100)) AS r FROM events)
          SELECT event_id, round((0.5 * sqrt(value / 100) / r + 0.5 / n) * n, 6) AS weight_n,
                 round((1.0 / n) / (0.5 * sqrt(value / 100) / r + 0.5 / n), 6) AS correction FROM events, a""")
def importance_sample(t):
    scored = t.events.select("event_id", (F.col("value") / 100).alias("s"))
    out = C.sample_weights(scored, "s")
    n = t.events.agg(F.count("*").alias("n")).scalar()
    return out.select("event_id", F.round(F.col("weight") * n, 6).alias("weight_n"), F.round("correction", 6).alias("correction"))


# --- estimates -------------------------------------------------------------


@query("SELECT count(DISTINCT p_name) * count(DISTINCT p_brand) AS calls FROM part")
def call_estimate_filter(t):
    return P.filter_calls(t.part, "{p_name} suits {p_brand}")


@query("SELECT count(*) AS calls FROM (SELECT DISTINCT p_name, p_brand FROM part)")
def call_estimate_inputs(t):
    return P.input_calls(t.part, "{p_name} suits {p_brand}")


@query("SELECT (SELECT count(DISTINCT p_brand) FROM part) * (SELECT count(DISTINCT s_name) FROM supplier) AS calls")
def call_estimate_join(t):
    return P.join_calls(t.part, t.supplier, "{p_brand:left} has the number of {s_name:right}")


@query("SELECT round(2 * 10 + 2 * count(*) * ln(count(*)), 4) AS calls FROM part")
def call_estimate_topk(t):
    return P.topk_calls(t.part, "Which {p_name} is best?", 10).select(F.round("calls", 4).alias("calls"))


_JUDGE = PromptSpec("judge", "Text is good")
_FIXED = sum(tokens_in(m["content"]) for m in _JUDGE.messages(""))


@query(f"SELECT CAST(sum(ceil(length(text) / 4.0) + {_FIXED}) AS BIGINT) AS tokens FROM documents")
def count_tokens(t):
    return P.prompt_tokens(t.documents, F.col("text"), _JUDGE)


@query("""SELECT DISTINCT x AS "column" FROM (SELECT unnest([p_type, 'p_name', 'p_brand', 'p_size']) AS x FROM part)""")
def referenced_columns(t):
    steps = t.part.select(F.array(
        F.concat("p_type", F.lit(":left")), F.lit("{p_name:right} goes with {p_brand_x}"), F.lit("[p_size, p_brand_y]")
    ).alias("params"))
    return P.referenced_columns(steps)


# --- profile and samples ---------------------------------------------------


def _profile_sql(table: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, dtype) in enumerate(columns):
        parts.append(f"""SELECT {i} AS position, '{c}' AS "column", '{dtype}' AS dtype, CAST(count(*) AS INTEGER) AS n_examples,
            coalesce(string_agg(v, '; ' ORDER BY h), '') AS examples FROM (
              SELECT * FROM (SELECT v, h, first_value(length(v)) OVER (ORDER BY h) AS l, row_number() OVER (ORDER BY h) AS n
                FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v, md5(CAST({c} AS VARCHAR)) AS h FROM {table})
                ORDER BY h LIMIT 6)
              WHERE n = 1 OR NOT ('{dtype}' = 'object' AND l > 50))""")
    return " UNION ALL ".join(parts)


@query(_profile_sql("customer", [("c_custkey", "int64"), ("c_name", "object"), ("c_nationkey", "int64"),
                                 ("c_acctbal", "float64"), ("c_mktsegment", "object")]))
def profile_table(t):
    return P.profile_table(t.customer).drop("profile")


@query(_profile_sql("documents", [("doc_id", "int64"), ("text", "object"), ("lang", "object"), ("source", "object"),
                                  ("n_chars", "int64")]))
def profile_documents(t):
    return P.profile_table(t.documents).drop("profile")


_ORDER_HASH = "md5(concat_ws(chr(31), '42', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority))"
_CUST_HASH = "md5(concat_ws(chr(31), '42', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment))"
_FK = [("orders", "customer", "o_custkey", "c_custkey")]


@query(f"""WITH o AS (SELECT DISTINCT o_custkey FROM (SELECT * FROM orders ORDER BY {_ORDER_HASH} LIMIT 100))
           SELECT * FROM customer ORDER BY c_custkey NOT IN (SELECT o_custkey FROM o), {_CUST_HASH} LIMIT 100""")
def sample_related(t):
    orders = t.orders.drop("o_orderdate")
    return P.sample_path(["orders", "customer"], {"orders": orders, "customer": t.customer}, _FK, 100)["customer"]


@query(f"""WITH c AS (SELECT * FROM customer ORDER BY {_CUST_HASH} LIMIT 50),
                r AS (SELECT o_orderkey, o_custkey, o_totalprice, {_ORDER_HASH} AS h FROM orders
                      WHERE o_custkey IN (SELECT c_custkey FROM c)),
                f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY h) AS n FROM r)
           SELECT o_orderkey, o_custkey, o_totalprice FROM f ORDER BY (n > 1), h LIMIT 50""")
def sample_added(t):
    customer = P.sample_related(t.customer, 50, {})
    out = P.sample_added("orders", {"orders": t.orders.drop("o_orderdate")}, {"customer": customer}, _FK, 50)
    return out.select("o_orderkey", "o_custkey", "o_totalprice")


_KEYS = [
    ("lineitem", "orders", "l_orderkey", "o_orderkey"), ("lineitem", "part", "l_partkey", "p_partkey"),
    ("lineitem", "supplier", "l_suppkey", "s_suppkey"), ("orders", "customer", "o_custkey", "c_custkey"),
    ("customer", "nation", "c_nationkey", "n_nationkey"), ("supplier", "nation", "s_nationkey", "n_nationkey"),
    ("nation", "region", "n_regionkey", "r_regionkey"),
]
_KEYS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS c, '{p}' AS p WHERE NOT EXISTS (SELECT 1 FROM {c} WHERE {cc} NOT IN (SELECT {pc} FROM {p}))"
    for c, p, cc, pc in _KEYS)


@query(f"""WITH e AS ({_KEYS_SQL}) SELECT x.c || ' ' || x.p || ' ' || y.p AS path FROM e x JOIN e y ON x.p = y.c
           WHERE y.p <> x.c""")
def fk_paths(t):
    """Paths over three tables along the keys that hold in the data."""
    held = []
    for child, parent, cc, pc in _KEYS:
        orphans = getattr(t, child).select(F.col(cc).alias("k")).join(
            getattr(t, parent).select(F.col(pc).alias("k")), "k", "left_anti")
        held.append(orphans.agg(F.count("*").alias("n")).where("n = 0").select(
            F.lit(child).alias("child"), F.lit(parent).alias("parent")))
    edges = stage(functools.reduce(DataFrame.unionByName, held), "keys")
    return P.fk_paths(edges, 3).select(F.array_join("path", " ").alias("path"))


# --- evaluation ------------------------------------------------------------


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 2),
               t AS (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity <= 49),
               m AS (SELECT * FROM p INTERSECT SELECT * FROM t)
          SELECT a.n AS n_prediction, b.n AS n_truth, c.n AS n_matched, c.n >= 0.9 * a.n AND c.n >= 0.9 * b.n AS agree
          FROM (SELECT count(*) AS n FROM p) a, (SELECT count(*) AS n FROM t) b, (SELECT count(*) AS n FROM m) c""")
def table_agreement(t):
    p = t.lineitem.where("l_quantity > 2").select(F.col("l_orderkey").alias("l_orderkey:left"), "l_partkey", "l_quantity", "l_tax")
    truth = t.lineitem.where("l_quantity <= 49").select("l_orderkey", "l_partkey", "l_quantity")
    return Ev.table_agreement(p, truth)


@query("""WITH o AS (SELECT o_custkey % 1000 + 1 AS id, o_orderkey, o_totalprice, o_orderkey % 25 <> 0 OR o_custkey % 7 = 0 AS p, o_orderkey % 40 <> 1 AS t FROM orders),
               r AS (SELECT id, o_orderkey, o_totalprice, bool_or(p) AS p, bool_or(t) AS t FROM o GROUP BY ALL),
               n AS (SELECT id, count(*) FILTER (p) AS np, count(*) FILTER (t) AS nt, count(*) FILTER (p AND t) AS m FROM r GROUP BY id),
               a AS (SELECT id, np > 0 AND nt > 0 AND m >= 0.9 * np AND m >= 0.9 * nt AS agree, id % 5 <> 0 AS told, id % 3 AS kind FROM n),
               c AS (SELECT id, CASE kind WHEN 0 THEN told WHEN 1 THEN agree OR told ELSE agree END AS good FROM a)
          SELECT CAST((id - 1) // 143 + 1 AS INTEGER) AS bucket, count(*) AS cases, count(*) FILTER (good) AS good FROM c GROUP BY 1""")
def answer_accuracy(t):
    """All cases of seven buckets scored by one job: tables, numbers and told answers."""
    o = t.orders.withColumn("case_id", F.col("o_custkey") % 1000 + 1)
    row = lambda key: F.create_map(F.lit(key), F.col("o_orderkey").cast("string"), F.lit("o_totalprice"), F.col("o_totalprice").cast("string"))
    predicted = o.where("o_orderkey % 25 <> 0 OR o_custkey % 7 = 0").select("case_id", row("o_orderkey:left").alias("row"))
    true = o.where("o_orderkey % 40 <> 1").select("case_id", row("o_orderkey").alias("row"))
    kind = F.element_at(F.array(F.lit("sem_agg"), F.lit("agg"), F.lit("orderby")), (F.col("case_id") % 3 + 1).cast("int"))
    told = F.when(F.col("case_id") % 5 == 0, "wrong").otherwise(F.col("case_id").cast("string"))
    cases = o.select("case_id").distinct().select("case_id", kind.alias("operator"), told.alias("prediction"), F.col("case_id").cast("string").alias("truth"))
    out = Ev.answer_accuracy(cases, predicted, true, R.judge(lambda c: R.value(c) == R.value(c, 1)))
    return out.groupBy(Ev.bucket_of(F.col("case_id")).alias("bucket")).agg(F.count("*").alias("cases"), F.count_if("answer_accuracy").alias("good"))


@query("""SELECT o_orderkey, CAST(o_totalprice > 200000 AS VARCHAR) = CAST(o_orderstatus = 'F' AS VARCHAR) AS agree FROM orders""")
def scalar_agreement(t):
    p, truth = F.col("o_totalprice") > 200000, F.col("o_orderstatus") == "F"
    return t.orders.select("o_orderkey", Ev.scalar_agreement(p, truth).alias("agree"))


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) = lower(p_type) AS agree FROM part""")
def judged_agreement(t):
    model = R.judge(lambda c: R.value(c).split()[0] == R.value(c, 1).lower())
    return Ev.judged_agreement(t.part, "p_name", "p_type", model).select("p_partkey", "agree")


@query("""WITH p AS (SELECT user_id AS c, event_type AS op, count(*) AS n FROM events WHERE value > 5 GROUP BY 1, 2),
               g AS (SELECT user_id AS c, event_type AS op, count(*) AS n FROM events WHERE value < 15 GROUP BY 1, 2),
               b AS (SELECT coalesce(p.c, g.c) AS c, coalesce(p.n, 0) AS p, coalesce(g.n, 0) AS g
                     FROM p FULL JOIN g ON p.c = g.c AND p.op = g.op)
          SELECT c AS "case", round(CASE WHEN sum(p) > 0 THEN sum(least(p, g)) / sum(p) ELSE 0 END, 6) AS precision,
                 round(CASE WHEN sum(g) > 0 THEN sum(least(p, g)) / sum(g) ELSE 0 END, 6) AS recall FROM b GROUP BY c""")
def op_precision_recall(t):
    side = lambda cond: t.events.where(cond).select(F.col("user_id").alias("case"), F.col("event_type").alias("op"))
    out = Ev.op_precision_recall(side("value > 5"), side("value < 15"))
    return out.select("case", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""SELECT user_id AS "case", count(*) AS operator_count, count(*) FILTER (event_type <> 'error') AS success_count
          FROM events GROUP BY user_id""")
def format_success(t):
    steps = t.events.select(F.col("user_id").alias("case"), (F.col("event_type") == "error").alias("has_failed"))
    return Ev.format_success(steps)


_DETAIL_SQL = """SELECT o_orderkey % 1000 + 1 AS case_id, o_totalprice > 250000 AS answer_accuracy,
                  (o_orderkey % 8) / 8.0 AS precision, (o_custkey % 4) / 4.0 AS recall,
                  o_custkey % 7 + 1 AS operator_count, least(o_custkey % 7 + 1, o_orderkey % 9) AS success_count FROM orders"""


def _detail(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        (key % 1000 + 1).alias("case_id"), (F.col("o_totalprice") > 250000).alias("answer_accuracy"),
        (key % 8 / 8).alias("precision"), (cust % 4 / 4).alias("recall"), (cust % 7 + 1).alias("operator_count"),
        F.least(cust % 7 + 1, key % 9).alias("success_count"),
    )


@query(f"""WITH b AS (SELECT (case_id - 1) // 143 + 1 AS bucket, round(avg(answer_accuracy::INT), 4) AS a, round(avg(precision), 4) AS p,
                 round(avg(recall), 4) AS r, round(avg(operator_count), 4) AS o,
                 round(sum(success_count) / sum(operator_count), 4) AS s FROM ({_DETAIL_SQL}) GROUP BY 1)
           SELECT round(sum(a) / 7, 4) AS accuracy, round(sum(p) / 7, 4) AS precision, round(sum(r) / 7, 4) AS recall,
                  round(sum(o) / 7, 2) AS op_count, round(sum(s) / 7, 4) AS success FROM b WHERE bucket BETWEEN 1 AND 7""")
def bucket_macro_avg(t):
    return Ev.bucket_macro_avg(_detail(t))


@query(f"""WITH b AS (SELECT (case_id - 1) // 143 + 1 AS bucket, count(*) AS n, count(*) FILTER (answer_accuracy) AS k
                      FROM ({_DETAIL_SQL}) GROUP BY 1)
           SELECT round(sum(n / CASE WHEN bucket = 7 THEN 142.0 ELSE 143.0 END) / 7, 4) AS success_rate,
                  round(sum(round(k / CASE WHEN bucket = 7 THEN 142.0 ELSE 143.0 END, 4)) / 7, 4) AS accuracy
           FROM b WHERE bucket BETWEEN 1 AND 7""")
def bucket_macro_avg_fixed(t):
    return Ev.bucket_macro_avg_fixed(_detail(t))


def _plan(t, other: bool):
    params = F.concat(F.lit("t;;"), F.col("l_returnflag"), F.lit(";;"), F.when(
        F.lit(other) & (F.col("l_quantity") > 45), F.lit("x")).otherwise(F.concat(F.lit("'"), F.col("l_linestatus"), F.lit("' "))))
    return t.lineitem.select(F.col("l_orderkey").alias("case"), F.lit("filter").alias("operator"), params.alias("params"))


@query("""WITH s AS (SELECT l_orderkey, l_returnflag || l_linestatus AS p,
                 l_returnflag || CASE WHEN l_quantity > 45 THEN 'x' ELSE l_linestatus END AS g FROM lineitem)
          SELECT l_orderkey AS "case", list_sort(list_distinct(list(p))) = list_sort(list_distinct(list(g))) AS same
          FROM s GROUP BY l_orderkey""")
def plan_set_equal(t):
    return Ev.plan_set_equal(_plan(t, False), _plan(t, True))


_OPS_SQL = """SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'filter' WHEN 'view' THEN 'sem_filter'
              WHEN 'error' THEN 'orderby' ELSE 'map' END AS op FROM events"""


def _ops(t):
    op = (F.when(F.col("event_type") == "click", "filter").when(F.col("event_type") == "view", "sem_filter")
          .when(F.col("event_type") == "error", "orderby").otherwise("map"))
    return t.events.select(F.col("user_id").alias("case"), F.col("event_id").alias("pos"), op.alias("operator"))


@query(f"""WITH o AS ({_OPS_SQL}), s AS (SELECT user_id, min(event_id) FILTER (op = 'orderby') AS s_at FROM o GROUP BY 1)
           SELECT o.user_id AS "case", CAST(count(*) FILTER (op IN ('filter', 'sem_filter')
                  AND (s_at IS NULL OR event_id < s_at)) AS INTEGER) AS filters, any_value(s_at) IS NOT NULL AS sorts
           FROM o JOIN s ON o.user_id = s.user_id GROUP BY 1""")
def filters_before_sort(t):
    return Ev.filters_before_sort(_ops(t))


@query(f"""WITH o AS (SELECT user_id, event_id, op FROM ({_OPS_SQL})),
               s AS (SELECT user_id, min(event_id) FILTER (op = 'orderby') AS a, min(event_id) FILTER (op = 'map') AS b FROM o GROUP BY 1),
               f AS (SELECT o.user_id AS u, any_value(a) AS a,
                     count(*) FILTER (op IN ('filter', 'sem_filter') AND (a IS NULL OR event_id < a)) AS m,
                     count(*) FILTER (op IN ('filter', 'sem_filter') AND (b IS NULL OR event_id < b)) AS g
                     FROM o JOIN s ON o.user_id = s.user_id GROUP BY 1)
           SELECT u AS "case", a IS NULL OR m = g AS valid FROM f""")
def order_valid(t):
    """The true plan is the same list with the sort standing where the projections are."""
    ops = _ops(t)
    truth = ops.withColumn("operator", F.when(F.col("operator") == "map", "sem_topk").when(
        F.col("operator") == "orderby", "head").otherwise(F.col("operator")))
    return Ev.order_valid(ops, truth)


@query("""WITH m AS (SELECT l_orderkey AS c, sum(l_tax) AS a, sum(l_linenumber) AS b FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
               g AS (SELECT l_orderkey AS c, sum(l_tax) AS a, sum(l_linenumber) AS b FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
          SELECT round(avg(CASE WHEN g.a > 0 THEN m.a / g.a ELSE 0 END), 6) AS total_cost,
                 round(avg(CASE WHEN g.b > 0 THEN m.b / g.b ELSE 0 END), 6) AS total_tokens FROM m JOIN g ON m.c = g.c""")
def cost_ratio(t):
    steps = t.lineitem.select(F.col("l_orderkey").alias("case"), F.col("l_tax").alias("total_cost"),
                              F.col("l_linenumber").alias("total_tokens"), "l_returnflag")
    out = Ev.cost_ratio(steps.where("l_returnflag <> 'R'"), steps.where("l_returnflag <> 'N'"),
                        fields=("total_cost", "total_tokens"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END) AS valid_rate FROM orders")
def valid_rate(t):
    return Ev.valid_rate(t.orders.select((F.col("o_orderstatus") != "P").alias("valid")))


@query("""SELECT 'part: {' AS opening, count(*) AS length, count(DISTINCT p_type) <= 6 AS few_types FROM part""")
def step_profile(t):
    """The result line of a step, taken apart: its name, the length it tells, and whether the profile names a type of the table."""
    line = P.step_profile("part", t.part)
    told = t.spark.createDataFrame([(line,)], "line string").crossJoin(F.broadcast(t.part.agg(F.min("p_type").alias("least"))))
    return told.select(F.substring("line", 1, 7).alias("opening"), F.regexp_extract("line", r"table_length: (\d+)$", 1).cast("long").alias("length"),
                       F.col("line").contains(F.col("least")).alias("few_types"))
