from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from semtab.functions.sql import qa_over, register_sql_functions
from semtab.models.base import HashEmbedder, RuleModel, parts_of
from semtab.models.prompts import PromptSpec
from semtab.plans import evaluate as Ev
from semtab.plans import prep as P
from semtab.plans.steps import Ref, Step, bind, derived_name, run_steps, typed_step
from semtab.plans.templates import TEMPLATES
from semtab.sources import readers, writers
from semtab.suite import rules as R
from tests.conftest import rows

# --- sources ---------------------------------------------------------------


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text,x\n1,"two\nlines, ""quoted""",nan\n2,,1.5\n')
    df = readers.scan_csv(spark, str(tmp_path / "t.csv"))
    assert rows(df) == [(1, 'two\nlines, "quoted"', None), (2, None, 1.5)]
    typed = readers.scan_csv(spark, str(tmp_path / "t.csv"), "id string, text string, x double")
    assert rows(typed, "id", "x") == [("1", None), ("2", 1.5)]
    writers.sink_tables_csv({"a b": df, "other": df.select("id")}, str(tmp_path / "out"))
    assert rows(readers.scan_csv(spark, str(tmp_path / "out" / "a b.csv"))) == rows(df)


def test_encoding_is_read_to_the_end(spark, tmp_path):
    (tmp_path / "late.csv").write_bytes(b"a" * 70_000 + "é".encode("iso-8859-1"))
    (tmp_path / "late8.csv").write_bytes(b"a" * 70_000 + "é".encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    found = {n: readers.detect_encoding(spark, str(tmp_path / f"{n}.csv")) for n in ("late", "late8", "empty")}
    assert found == {"late": "iso-8859-1", "late8": "utf-8", "empty": "utf-8"}


def test_failed_run_has_no_answer(spark):
    df = spark.range(3).select("id", F.lit("x").alias("s"))
    run = run_steps({"t": df}, [Step("filter", "t", ("id", (("ge", 1),))), Step("filter", "t_filter", ("nope", (("ge", 1),)))])
    assert run.error is not None and len(run.results) == 1 and run.answer is None


def test_cases_of_no_bucket_are_an_error(spark):
    detail = spark.createDataFrame([(1, True, 1.0, 1.0, 2, 2), (1002, True, 1.0, 1.0, 2, 2)],
                                   "case_id long, answer_accuracy boolean, precision double, recall double, operator_count long, success_count long")
    for mean in (Ev.bucket_macro_avg, Ev.bucket_macro_avg_fixed):
        assert mean(detail.limit(1)).count() == 1
        with pytest.raises(Exception, match="no bucket"):
            mean(detail).collect()


def test_descriptions(spark, tmp_path):
    text = "original_column_name,column_description,value_description\n name ,the café,\nn,\"a\nb\",\"1: x\"\n"
    for encoding, found in (("utf-8-sig", "utf-8"), ("windows-1252", "iso-8859-1")):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes(text.encode(encoding))
        assert readers.detect_encoding(spark, str(path)) == found
        assert rows(readers.scan_description_csv(spark, str(path))) == [
            ("n", "column_description=a b; value_description=1: x"),
            ("name", "column_description=the café; value_description=NULL"),
        ]


def test_process_documents(spark, tmp_path):
    doc = {
        "database": "club", "type": "flat", "query": "How many?",
        "process": [
            {"initial_table": [{"member": {"*": "all columns", "id": "dtype=int64"}}]},
            {"operator": "agg", "params": "member;;id;;count", "result": "result: 7", "current_table": ["member"], "execution_time": 0.1, "Thought": "t"},
            {"Thought": "done", "Final Answer": 7},
        ],
    }
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "1.json").write_text(json.dumps(doc, indent=1))
    df = readers.scan_process_json(spark, str(tmp_path))
    steps = readers.steps_of(df).orderBy("pos").collect()
    assert [s["operator"] for s in steps] == [None, "agg", None]
    assert steps[2]["Final Answer"] == "7" and steps[0]["file"].endswith("1.json")
    assert json.loads(steps[0]["initial_table"][0]["member"])["id"] == "dtype=int64"


def test_pending(spark):
    todo = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows(readers.pending(todo, todo.where("k = 1"), "k")) == [(2,), (None,)]


# --- preparation -----------------------------------------------------------


def test_profile(spark):
    df = spark.range(5000).select(
        "id", (F.col("id") % 3).alias("few"), F.concat(F.lit("long "), F.repeat(F.lit("x"), 60)).alias("text"),
        F.lit(None).cast("double").alias("none"))
    out = {r["column"]: r for r in P.profile_table(df, {c: f"about {c}" for c in df.columns}).collect()}
    assert out["id"]["n_examples"] == 6 and out["few"]["n_examples"] == 3 and out["none"]["n_examples"] == 0
    assert out["text"]["n_examples"] == 1 and out["text"]["dtype"] == "object" and out["none"]["dtype"] == "float64"
    assert out["few"]["profile"].startswith("description: about few dtype=int64 e.g. ")
    assert P.step_profile("t_filter", df.limit(10)).endswith("table_length: 10")


def test_paths(spark):
    edges = P.fk_edges(["a", "b", "c"], [(0, "a_id"), (1, "b_id"), (1, "a_ref"), (2, "b_ref"), (0, "c_ref"), (2, "c_id")],
                       [(2, 0), (3, 1), (4, 5)], spark)
    assert rows(P.fk_paths(edges, 2)) == [(["a", "c"],), (["b", "a"],), (["c", "b"],)]
    assert rows(P.fk_paths(edges, 3)) == [(["a", "c", "b"],), (["b", "a", "c"],), (["c", "b", "a"],)]


def test_samples(spark):
    parents = spark.range(50).select("id", F.lit("p").alias("x"))
    children = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("ref"))
    edges = [("children", "parents", "ref", "id")]
    out = P.sample_path(["children", "parents"], {"children": children, "parents": parents}, edges, 20)
    refs = {r["ref"] for r in out["children"].collect()}
    got = {r["id"] for r in out["parents"].collect()}
    assert out["children"].count() == 20 and len(got) == 20 and refs <= got
    added = P.sample_added("children", {"children": children}, {"parents": parents.where("id < 10")}, edges, 40)
    kept = added.collect()
    assert len(kept) == 40 and {r["ref"] for r in kept} == set(range(10))  # one per key first, whatever its share
    assert P.sample_related(parents, 500, {}).count() == 50
    few = P.sample_related(parents, 5, {"id": spark.createDataFrame([(3,), (None,)], "v long")})
    assert 3 in {r["id"] for r in few.collect()} and few.count() == 5


def test_estimates(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", None)], "s string, t string")
    assert P.filter_calls(df, "{s} {t}").first()["calls"] == 2
    assert P.input_calls(df, "{s} {t}").first()["calls"] == 2
    assert P.join_calls(df, df.select(F.col("s").alias("u")), "{s} {u}").first()["calls"] == 4
    assert P.topk_calls(df, "{s}", 2, "naive").first()["calls"] == 3.0
    assert P.prompt_tokens(df, F.lit("12345"), PromptSpec("judge", "x")).first()["tokens"] % 3 == 0
    steps = spark.createDataFrame([(["[a_x, b]", "{c:left} is {d}"],), (["count", "b"],)], "params array<string>")
    assert rows(P.referenced_columns(steps)) == [("a",), ("b",), ("c",), ("count",), ("d",)]


# --- evaluation ------------------------------------------------------------


def test_table_agreement(spark):
    a = spark.createDataFrame([(i, None if i == 3 else i) for i in range(10)], "`k:left` long, v long")
    b = spark.createDataFrame([(i, None if i == 3 else i, 1) for i in range(11)], "k long, v long, other long")
    assert tuple(Ev.table_agreement(a, b).first()) == (10, 11, 10, True)
    assert not Ev.table_agreement(a.limit(5), b).first()["agree"]
    assert not Ev.table_agreement(a.limit(0), b.limit(0)).first()["agree"]
    assert not Ev.table_agreement(a.select("v").withColumnRenamed("v", "z"), b).first()["agree"]


def test_operator_scores(spark):
    p = spark.createDataFrame([(1, "filter"), (1, "filter"), (1, "agg"), (3, "map")], "case long, op string")
    t = spark.createDataFrame([(1, "filter"), (1, "agg"), (1, "join"), (1, "head"), (2, "agg")], "case long, op string")
    assert rows(Ev.op_precision_recall(p, t)) == [(1, 2 / 3, 0.5), (2, 0.0, 0.0), (3, 0.0, 0.0)]


def test_plan_equality(spark):
    schema = "case long, operator string, params string, pos long"
    truth = spark.createDataFrame([(1, "join", "a;;b;;x;;y", 0), (1, "filter", 't;;"c";;[(eq, 1)]', 1), (2, "agg", "t;;c;;sum", 0), (3, "head", "t;;3", 0)], schema)
    said = spark.createDataFrame([(1, "filter", "u;;c ;;[(eq, 1)]", 0), (1, "join", "b;;a;;y;;x", 1), (2, "agg", "t;;c;;max", 0)], schema)
    assert rows(Ev.plan_set_equal(said, truth)) == [(1, True), (2, False), (3, False)]
    order = spark.createDataFrame([(1, "filter", "", 0), (1, "orderby", "", 1), (1, "filter", "", 2), (2, "map", "", 0)], schema)
    base = spark.createDataFrame([(1, "filter", "", 0), (1, "sem_filter", "", 1), (1, "sem_topk", "", 2), (2, "filter", "", 0)], schema)
    assert rows(Ev.filters_before_sort(order)) == [(1, 1, True), (2, 0, False)]
    assert rows(Ev.order_valid(order, base)) == [(1, False), (2, True)]


def test_buckets(spark):
    detail = spark.createDataFrame([(1, True, 1.0, 0.5, 4, 3), (143, False, 0.0, 0.5, 2, 2), (144, True, 1.0, 1.0, 0, 0)],
                                   "case_id long, answer_accuracy boolean, precision double, recall double, operator_count long, success_count long")
    per = {r["bucket"]: r for r in Ev.bucket_averages(detail).collect()}
    assert per[1]["accuracy"] == 0.5 and per[1]["success"] == round(5 / 6, 4) and per[2]["success"] == 0.0
    macro = Ev.bucket_macro_avg(detail).first()
    assert macro["accuracy"] == round(1.5 / 7, 4) and macro["op_count"] == round(3 / 7, 2)
    fixed = Ev.bucket_macro_avg_fixed(detail).first()
    assert fixed["success_rate"] == round(3 / 143 / 7, 4) and fixed["accuracy"] == round(2 * 0.007 / 7, 4)


def test_costs(spark):
    m = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0), (3, 1.0)], "case long, total_cost double")
    b = spark.createDataFrame([(1, 2.0), (2, 0.0)], "case long, total_cost double")
    assert Ev.cost_ratio(m, b, fields=("total_cost",)).first()[0] == 0.75
    judged = Ev.judged_agreement(spark.createDataFrame([("7", "7"), ("7", "8"), (None, "8")], "p string, t string"), "p", "t",
                                 R.judge(lambda c: R.value(c) == R.value(c, 1)))
    assert [r["agree"] for r in judged.orderBy("p", "t").collect()] == [False, True, False]


# --- SQL -------------------------------------------------------------------


def test_sql_functions(spark):
    model = RuleModel(lambda s, c: f"{s.instruction}:{R.value(c)}" if s.task == "map" else str(R.value(c) == R.value(c, 1))
                      if s.task == "judge" else str(len(parts_of(c))))
    register_sql_functions(spark, model)
    df = spark.createDataFrame([("a", 1), ("b", 1), (None, 2)], "s string, g int")
    assert rows(spark.sql("SELECT llm_map('q', s) AS m FROM {df} WHERE llm_map('q', s) = 'q:a'", df=df)) == [("q:a",)]
    assert rows(spark.sql("SELECT x.s FROM {a} x JOIN {b} y ON llm_join('same', x.s, y.s)", a=df, b=df)) == [("a",), ("b",), (None,)]
    assert rows(spark.sql("SELECT g, llm_qa('q', s) AS n FROM {df} GROUP BY g", df=df)) == [(1, "2"), (2, "0")]
    assert qa_over(df.where("g = 1"), "how many", model).first()["Answer"] == "2"


# --- steps -----------------------------------------------------------------


def test_names_and_binding(spark):
    assert derived_name("t", "filter", {"t": 1}) == "t_filter"
    taken = {"t_filter": 1, **{f"t_filter_{i}": 1 for i in range(2, 12)}}
    assert derived_name("t", "filter", taken) == "t_filter_12"
    scalars = [spark.range(1).select(F.lit(3.5))]
    assert bind("above @step0 and <placeholder>", scalars, [0]) == "above 3.5 and 3.5"


def test_typed_steps():
    assert typed_step("filter", "client;;gender;;[(eq, M), (ne, nan)]") == Step("filter", "client", ("gender", (("eq", "M"), ("ne", "nan"))))
    assert typed_step("map", "t;;[a, b c]") == Step("map", "t", (["a", "b c"],))
    assert typed_step("value_calculate", "sub;;9031.67;;8994") == Step("value_calculate", None, ("sub", 9031.67, 8994))
    assert typed_step("join", "a;;b;;x;;y") == Step("join", "a", ("b", "x", "y"))
    assert typed_step("orderby", "t;;[a];;desc") == Step("orderby", "t", (["a"], "desc"))
    assert typed_step("sem_topk", "t;;best {x}?;;3") == Step("sem_topk", "t", ("best {x}?", 3))
    assert typed_step('"agg"', "t;;c;;count").op == "agg"


def test_stored_process_runs(spark):
    """A stored process of three steps: join, judge, count."""
    member = spark.createDataFrame([(i, f"m{i % 3}") for i in range(9)], "member_id long, link_to_major string")
    major = spark.createDataFrame([("m0", "Computer Science"), ("m1", "Music"), ("m2", "Software")], "major_id string, major_name string")
    stored = [("join", "member;;major;;link_to_major;;major_id"),
              ("sem_filter", "member_join;;{major_name} is associated with the Technology industry"),
              ("agg", "member_join_sem_filter;;member_id;;count")]
    model = R.judge(lambda c: R.value(c) != "Music")
    run = run_steps({"member": member, "major": major}, [typed_step(*s) for s in stored], model)
    assert run.error is None and run.answer.first()[0] == 6
    assert list(run.tables) == ["member", "major", "member_join", "member_join_sem_filter"]
    assert [h["table"] for h in run.history] == ["member_join", "member_join_sem_filter", None]


def test_scalars_feed_later_steps(spark):
    t = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 60.0)], "id long, v double")
    steps = [Step("agg", "t", ("v", "mean")), Step("agg", "t", ("v", "max")), Step("value_calculate", None, ("sub", Ref(1), Ref(0))),
             typed_step("filter", "t;;v;;[(lt, <placeholder>)]"), Step("agg", "t_filter", ("id", "count"))]
    run = run_steps({"t": t}, steps)
    assert [run.results[i].first()[0] for i in (0, 1, 2, 4)] == [30.0, 60.0, 30.0, 2]


def test_run_stops(spark):
    t = spark.createDataFrame([(1, "a")], "id long, s string")
    assert "step 0 (fly)" in run_steps({"t": t}, [Step("fly", "t")]).error
    assert "not found" in run_steps({"t": t}, [Step("head", "u", (1,))]).error
    assert "needs a model" in run_steps({"t": t}, [Step("sem_map", "t", ("x {s}",))]).error
    empty = run_steps({"t": t}, [Step("filter", "t", ("id", (("gt", 5),))), Step("head", "t_filter", (1,))], stop_when_empty=True)
    assert "empty table" in empty.error and len(empty.results) == 1


# --- templates -------------------------------------------------------------

EVERY = RuleModel(
    lambda s, c: R.earlier(c) if s.task == "compare"
    else "True" if s.task == "judge"
    else max(R.whole(p) if s.task == "fold" else p for p in parts_of(c)) if s.task.startswith("fold")
    else R.value(c)[:3])


def build(sequence) -> list[Step]:
    """A concrete process for an operator sequence over two small tables."""
    steps: list[Step] = []
    name, text, number, taken = "a", "text", "n", {"a"}

    def add(op, *args, **options):
        nonlocal name
        steps.append(Step(op, name, args, options))
        if op != "agg":
            name = derived_name(name, op, dict.fromkeys(taken))
            taken.add(name)

    for element in sequence:
        if element == "Join":
            add("join", "b", "k", "kb")
        elif element == "Sem_Join":
            add("sem_join", "b", "{text:left} goes with {label:right}")
        elif element == "Sem_Filter":
            add("sem_filter", f"{{{text}}} is fine")
        elif element == "Filter":
            add("filter", number, (("ge", 1),))
        elif element == "Aggregate":
            add("agg", number, "count")
        elif element == "Sem_Aggregate":
            add("sem_agg", f"sum up {{{text}}}")
        elif element == "Map":
            add("map", [text, number])
        elif element == "Sem_Map":
            add("sem_map", f"shorten {{{text}}}")
        elif element == "Group":
            add("groupby", [text], number, "max")
            number = f"{number}_max"
        elif element == "Sem_Group":
            add("sem_cluster_by", text, 2, number, "sum")
            text, number = "summary", f"{number}_sum"
        elif element == "Value_Sort":
            add("orderby", [number], "desc", tie_break=text)
        elif element == "Head":
            add("head", 2)
        elif element == "Semantic_Sort":
            add("sem_topk", f"best {{{text}}}?", 2)
    return steps


SEQUENCES = sorted({s for group in TEMPLATES.values() for s in group})


def test_template_counts():
    assert [len(v) for v in TEMPLATES.values()] == [11, 4, 6, 2, 11, 3, 3, 3] and len(SEQUENCES) == 37


@pytest.mark.parametrize("sequence", SEQUENCES, ids="-".join)
def test_template(spark, sequence):
    a = spark.createDataFrame([(i, i % 3, f"text {i % 5}", i % 4) for i in range(24)], "id long, k long, text string, n long")
    b = spark.createDataFrame([(i, f"label {i}") for i in range(3)], "kb long, label string")
    run = run_steps({"a": a, "b": b}, build(sequence), EVERY, HashEmbedder(16))
    assert run.error is None
    answer = run.answer.collect()
    assert 1 <= len(answer) <= 72
    if "Head" in sequence and sequence[-1] in ("Map", "Sem_Map"):
        assert len(answer) == 2
    if sequence[-1] in ("Aggregate", "Sem_Aggregate"):
        assert len(answer) == 1


def test_answers_of_many_cases(spark):
    row = "case_id int, row map<string,string>"
    many = [{"a:left": str(k), "b": None, "x": "1"} for k in range(20)]
    predicted = [(1, r) for r in many] + [(2, {"q": "1"}), (3, {"a": "1"}), (5, {"a": "1"}), (6, {"n": "4"}), (7, {"n": "4"}), (9, {"a": None, "b": "1"}), (10, {"a": "1", "b": "2"})]
    true = [(1, {"a": str(k), "b": None}) for k in range(19)] * 2 + [(2, {"a": "1"}), (4, {"a": "1"}), (5, {"a": "2"}), (6, {"n": "4"}), (7, {"n": "5"}), (9, {"a": "1", "b": None}), (10, {"b": "2"})]
    cases = [(1, "map", "", ""), (2, "map", "", ""), (3, "map", "", ""), (4, "filter", "", ""), (5, "join", "x", "x"), (6, "agg", "4", "5"), (7, "agg", "four", "four"),
             (8, "sem_agg", "yes", "yes"), (9, "map", "", ""), (10, "map", "", ""), (11, "sem_agg", "yes", "no"), (12, "value_calculate", None, "1"), (13, None, "a", "a")]
    model = R.judge(lambda c: R.value(c) == R.value(c, 1))
    got = Ev.answer_accuracy(spark.createDataFrame(cases, "case_id int, operator string, prediction string, truth string"), spark.createDataFrame(predicted, row), spark.createDataFrame(true, row), model)
    assert {r["case_id"] for r in got.collect() if r["answer_accuracy"]} == {1, 6, 7, 8, 10} and got.count() == 13


def test_tables_agree_as_one_by_one(spark):
    rows_of = lambda df, case: df.select(F.lit(case).alias("case_id"), F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]).alias("row"))
    truth = spark.range(100).selectExpr("id AS a", "id % 7 AS b")
    sides = {k: truth.where(f"a >= {k}").selectExpr("a AS `a:left`", "b", "1 AS c") for k in (0, 5, 10, 11, 100)}
    predicted = [rows_of(df, k) for k, df in sides.items()]
    both = predicted[0]
    for p in predicted[1:]:
        both = both.unionByName(p)
    true = rows_of(truth, 0)
    for k in list(sides)[1:]:
        true = true.unionByName(rows_of(truth, k))
    got = {r["case_id"]: r["agree"] for r in Ev.tables_agree(both, true).collect()}
    want = {k: Ev.table_agreement(df, truth).first()["agree"] for k, df in sides.items()}
    assert {k: got.get(k, False) for k in sides} == want and want[10] and not want[11]
