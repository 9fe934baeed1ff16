from __future__ import annotations

import glob
import json
import tempfile
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from semtab.functions import claims as C
from semtab.models.answering import usage
from semtab.models.base import ConfidenceCascade, HashEmbedder, Reply, RuleModel, TokenChance, labelled_values, parts_of
from semtab.models.prompts import PromptSpec, shots_from
from semtab.operators.semantic import sem_extract, sem_filter, sem_filter_batch, sem_map
from semtab.suite import rules as R
from tests.conftest import rows


class Counting:
    """A model that leaves one file per prompt, so that calls in all processes are seen."""

    name, batch_size, context_tokens, reply_tokens = "counting", 4, 1000, 100

    def __init__(self, rule) -> None:
        self.rule, self.folder = rule, tempfile.mkdtemp(prefix="semtab-calls-")

    def answer(self, spec, contexts, logprobs=False):
        for _ in contexts:
            open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        return [Reply(self.rule(c)) for c in contexts]

    @property
    def calls(self) -> int:
        return len(glob.glob(f"{self.folder}/*"))


@pytest.fixture(scope="module")
def things(spark):
    names = ["red gear", "red bolt", "old gear", None]
    return spark.createDataFrame([(i, names[i % 4], f"b{i % 2}") for i in range(40)], "id long, name string, brand string")


GEAR = R.judge(lambda c: "gear" in R.value(c))


def test_holes_and_labels():
    text = "This is a {test} string with {Other Name:left} and {{escaped}}."
    assert C.holes(text) == ["test", "Other Name:left"]
    assert C.fill_claim("{Course Name} in {{x}}") == "Course name in {x}"


def test_row_text(spark):
    df = spark.createDataFrame([("a", 1, None)], "`Course Name` string, n long, z string")
    assert df.select(C.row_text(df, ["Course Name", "n", "z"])).first()[0] == "[Course name]: «a»\n[N]: «1»\n[Z]: «nan»\n"


def test_reply_parsers(spark):
    texts = ["Reasoning:\n\nbecause\n\nAnswer: True", "no reason Answer: False or so", "True", "Document 2 is better than Document 1", "I pick 2"]
    df = spark.createDataFrame([(t,) for t in texts], "r string")
    got = df.select(C.explanation_of(F.col("r")), C.answer_of(F.col("r")), C.bool_of(C.answer_of(F.col("r")), "default", True)).collect()
    assert tuple(got[0]) == ("because", " True", True)
    assert tuple(got[1]) == ("no reason ", " False or so", False)
    assert tuple(got[2]) == (None, "True", True)
    assert [r[0] for r in df.where("r LIKE '%2%'").select(C.choice_of(F.col("r"))).collect()] == [1, 2]
    with pytest.raises(Exception, match="cannot read"):
        df.select(C.bool_of(F.col("r"))).collect()


def test_list_of_bools(spark):
    df = spark.createDataFrame([("[True, False]", 2), ("['True']", 1), ("[True]", 2), ("yes", 1)], "r string, n int")
    got = [r[0] for r in df.select(C.list_of_bools(F.col("r"), F.col("n"), "default", False)).collect()]
    assert got == [[True, False], [True], [False, False], [False]]
    with pytest.raises(Exception, match="does not fit"):
        df.select(C.list_of_bools(F.col("r"), F.col("n"))).collect()


def test_filter_keeps_rows_and_drops_missing(things):
    out = sem_filter(things, "{name} is a gear", GEAR)
    assert out.columns == things.columns
    assert rows(out, "id") == rows(things.where("name LIKE '%gear'"), "id")


def test_filter_asks_once_per_distinct_input(things):
    model = Counting(lambda c: str("gear" in c))
    assert sem_filter(things, "{name} is a gear", model).count() == 20
    assert model.calls == 3
    two = Counting(lambda c: str("gear" in c))
    sem_filter(things, "{name} of {brand} is a gear", two).collect()
    assert two.calls == things.where("name IS NOT NULL").select("name", "brand").distinct().count()


def test_chained_steps_ask_nothing_twice(things):
    first, second = Counting(lambda c: str("gear" in c)), Counting(lambda c: "x")
    out = sem_map(sem_filter(things, "{name} is a gear", first), "shorten {name}", second)
    out.count()
    out.groupBy("_map").count().collect()
    assert (first.calls, second.calls) == (3, 2)


def test_filter_result_does_not_depend_on_partitions(things):
    want = rows(sem_filter(things, "{name} is a gear", GEAR))
    assert rows(sem_filter(things.repartition(7), "{name} is a gear", GEAR)) == want
    assert rows(sem_filter(things.coalesce(1), "{name} is a gear", GEAR, parallel=2)) == want


def test_filter_errors_and_default(things):
    odd = RuleModel(lambda s, c: "perhaps")
    with pytest.raises(Exception, match="cannot read"):
        sem_filter(things, "{name} is a gear", odd).collect()
    assert sem_filter(things, "{name} is a gear", odd, on_error="default").count() == 30
    assert sem_filter(things, "{name} is a gear", odd, on_error="default", default=False).count() == 0
    with pytest.raises(ValueError):
        sem_filter(things, "{nope} is a gear", odd)
    with pytest.raises(ValueError):
        sem_filter(things, "all is well", odd)


def test_filter_explains(things):
    out = sem_filter(things, "{name} is a gear", GEAR, strategy="zs-cot", explain=True, raw=True)
    row = out.first()
    assert row["explanation_filter"] == "read from the text"
    assert row["raw_output_filter"].endswith("Answer: True")


def test_examples(things, spark):
    pdf = pd.DataFrame({"name": ["red gear"], "Answer": [True], "Reasoning": ["round"]})
    shots = shots_from(pdf, ["name"], "cot")
    assert shots == shots_from(spark.createDataFrame(pdf), ["name"], "cot")
    spec = PromptSpec("judge", "Name is a gear", "cot", shots)
    said = [m["content"] for m in spec.messages("[Name]: «x»\n") if m["role"] == "assistant"]
    assert said == ["Reasoning:\nround\n\nAnswer: True"]
    with pytest.raises(ValueError):
        shots_from(pdf[["name"]], ["name"], None)
    with pytest.raises(ValueError):
        shots_from(pdf[["name", "Answer"]], ["name"], "cot")
    out = sem_filter(things, "{name} is a gear", GEAR, examples=pdf, strategy="cot")
    assert "explanation_filter" in out.columns


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_filter_batch(things, n):
    model = R.batch_judge(lambda v: "gear" in v)
    assert rows(sem_filter_batch(things, "{name} is a gear", model, rows_per_prompt=n), "id") == rows(
        things.where("name LIKE '%gear'"), "id")


def test_filter_batch_rejects_short_reply(things):
    with pytest.raises(Exception, match="does not fit"):
        sem_filter_batch(things, "{name} is a gear", RuleModel(lambda s, c: "[True, True, True, True]"), rows_per_prompt=2).collect()


def test_map(things):
    model = R.mapper(lambda c: R.value(c).split()[0])
    out = sem_map(things, "quality of {name}", model)
    assert out.columns == [*things.columns, "_map"] and out.count() == 30
    kept = sem_map(things, "quality of {name}", model, keep_nulls=True)
    assert kept.count() == 40 and kept.where("_map IS NULL").count() == 10
    twice = sem_map(out, "kind of {name}", R.mapper(lambda c: R.value(c).split()[1]))
    assert twice.columns == [*things.columns, "_map_x", "_map_y"]
    loud = sem_map(things, "quality of {name}", model, postprocess=F.upper, raw=True, out="_q")
    assert loud.first()["_q"].isupper() and "raw_output_q" in loud.columns


def test_extract(things):
    model = RuleModel(lambda s, c: json.dumps({"kind": R.value(c).split()[-1], "n": 3, "extra": 1}))
    out = sem_extract(things, ["name"], {"kind": "noun", "n": None}, model, quotes=True)
    assert out.columns == [*things.columns, "kind", "n", "kind_quote", "n_quote"]
    assert out.count() == 40  # rows with a missing input are asked too
    assert rows(out.where("id = 0"), "kind", "n", "kind_quote") == [("gear", "3", None)]
    bad = RuleModel(lambda s, c: "no json")
    with pytest.raises(Exception, match="not a JSON object"):
        sem_extract(things, ["name"], ["kind"], bad).collect()
    assert sem_extract(things, ["name"], ["kind"], bad, on_error="null").where("kind IS NULL").count() == 40


def test_memo_answers_once(things):
    memo = tempfile.mkdtemp(prefix="semtab-memo-") + "/m"
    model = Counting(lambda c: str("gear" in c))
    first, used = sem_filter(things, "{name} is a gear", model, memo=memo, stats=True)
    again, reused = sem_filter(things, "{name} is a gear", model, memo=memo, stats=True)
    assert rows(first) == rows(again) and model.calls == 3
    assert used.first()["calls"] == 3 and used.first()["cache_hits"] == 0
    assert reused.first()["calls"] == 0 and reused.first()["cache_hits"] == 3
    sem_filter(things, "{name} is not a gear", model, memo=memo).collect()
    assert model.calls == 6


def test_usage_by_step(spark):
    from semtab.models.answering import with_replies

    model = RuleModel(lambda s, c: "True", price_per_token=0.5)
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "t string, step int")
    used = usage(with_replies(df, F.col("t"), model, PromptSpec("judge", "x")), by=["step"]).orderBy("step").collect()
    assert [r["calls"] for r in used] == [1, 2]
    assert used[1]["total_cost"] == pytest.approx(0.5 * used[1]["total_tokens"])


def test_confidence_cascade():
    spec = PromptSpec("compare", "q")
    def small(p, name):
        class M:
            batch_size, context_tokens, reply_tokens = 8, 10, 10
            def answer(self, spec, contexts, logprobs=False):
                return [Reply("Document 1", 1, 1, 0.0, [TokenChance("Document", -0.1, []), TokenChance(" 1", p, [])]) for _ in contexts]
        m = M(); m.name = name
        return m
    large = RuleModel(lambda s, c: "Document 2")
    assert ConfidenceCascade(small(-0.01, "s"), large, 0.9).answer(spec, ["x"])[0].text == "Document 1"
    unsure = ConfidenceCascade(small(-1.0, "s"), large, 0.9).answer(spec, ["x"])[0]
    assert unsure.text == "Document 2" and unsure.prompt_tokens > 1


def test_context_readers():
    assert labelled_values("[A]: «x\ny»\n[B c]: «»\n") == [("A", "x\ny"), ("B c", "")]
    assert parts_of("\n\tDocument 1: a\n\tDocument 2: b") == ["a", "b"]
    assert HashEmbedder(8).embed(["a b", ""]).shape == (2, 8)
