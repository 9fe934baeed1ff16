from __future__ import annotations

import os

import pytest

from semtab.models import memo as M
from semtab.models.base import Reply, RuleModel, TokenChance
from semtab.models.prompts import PromptSpec
from semtab.operators.matching import sem_join
from semtab.operators.semantic import sem_filter
from semtab.plans.steps import Step, run_steps
from tests.conftest import rows

SPEC = PromptSpec("map", "shout")


def used(spark, model):
    return {r["step"]: (r["calls"], r["hits"]) for r in M.usage_of(spark, model.folder, model.run).collect()}


def test_replies_are_kept_with_all_they_hold(spark, tmp_path):
    class Chatty:
        name, batch_size, context_tokens, reply_tokens = "chatty", 4, 100, 10

        def answer(self, spec, contexts, logprobs=False):
            chances = [TokenChance("a", -0.5, [("a", -0.5), ("b", -1.0)])] if logprobs else None
            return [Reply(c.upper(), 3, 2, 0.5, chances) for c in contexts]

    first = M.recorded(spark, Chatty(), str(tmp_path))
    wanted = first.answer(SPEC, ["a", "b", "a", "é"], True)
    assert [r.text for r in wanted] == ["A", "B", "A", "É"] and used(spark, first) == {"": (3, 1)}
    again = M.recorded(spark, Chatty(), str(tmp_path))
    assert again.answer(SPEC, ["é", "a"], True) == [wanted[3], wanted[0]] and used(spark, again) == {"": (0, 2)}
    again.answer(SPEC, ["a"], False)  # without probabilities it is another prompt
    again.answer(PromptSpec("map", "whisper"), ["a"], True)
    assert used(spark, again)[""] == (2, 2)
    total = M.usage_of(spark, str(tmp_path), first.run).first()
    assert (total["prompt_tokens"], total["completion_tokens"], total["total_tokens"], total["cost"]) == (9, 6, 15, 1.5)


def test_generations_are_compacted_and_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "GENERATIONS", 3)
    monkeypatch.setattr(M, "BUCKET_REPLIES", 5)
    monkeypatch.setattr(M, "BUCKETS_HELD", 2)
    asked = []
    shout = RuleModel(lambda spec, c: asked.append(c) or c.upper())
    for turn in range(6):
        model = M.recorded(spark, shout, str(tmp_path))
        assert len(model.generations) <= 3 and not os.listdir(tmp_path / "log")
        texts = [f"t{k}" for k in range(20 * (turn + 1))]
        assert [r.text for r in model.answer(SPEC, texts)] == [t.upper() for t in texts]
    assert len(asked) == len(set(asked)) == 120
    assert max(b for _, b in M.recorded(spark, shout, str(tmp_path)).generations) > 1


def test_a_repeated_task_finds_its_replies(spark, tmp_path):
    asked = []
    model = M.recorded(spark, RuleModel(lambda spec, c: asked.append(c) or c), str(tmp_path))
    model.answer(SPEC, ["x", "y"])
    model.answer(SPEC, ["x", "y"])  # before anything is compacted
    assert asked == ["x", "y"]


def test_a_join_that_failed_half_way_goes_on(spark, tmp_path):
    flag = str(tmp_path / "broken")
    open(flag, "w").close()

    def rule(spec, c):
        if "l7" in c and os.path.exists(flag):
            raise RuntimeError("service is gone")
        return str(c.count("7") != 1)

    left = spark.createDataFrame([(f"l{k}",) for k in range(10)], "a string").repartition(1)
    right = spark.createDataFrame([(f"r{k}",) for k in range(10)], "b string")
    folder = str(tmp_path / "memo")
    wrap = lambda: M.recorded(spark, RuleModel(rule, batch_size=5), folder, "join")
    with pytest.raises(Exception, match="service is gone"):
        sem_join(left, right, "{a:left} goes with {b:right}", wrap())
    os.remove(flag)
    model = wrap()
    got = sem_join(left, right, "{a:left} goes with {b:right}", model)
    assert rows(got, "a", "b") == sorted((f"l{i}", f"r{j}") for i in range(10) for j in range(10) if (i == 7) == (j == 7))
    calls, hits = used(spark, model)["join"]
    assert calls + hits == 100 and 0 < calls < 100


def test_steps_are_counted_apart(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "s string, n int")
    model = M.recorded(spark, RuleModel(lambda spec, c: "True"), str(tmp_path), remember=False)
    run = run_steps({"t": df}, [Step("sem_filter", "t", ("{s} is a letter",)), Step("sem_map", "t_sem_filter", ("{n} doubled",))], model)
    assert run.error is None and used(spark, model) == {"0 sem_filter": (2, 0), "1 sem_map": (3, 0)}
    assert not os.listdir(tmp_path / "log")


def test_folders_by_uri(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "s string")
    for _ in range(2):
        model = M.recorded(spark, RuleModel(lambda spec, c: "True"), f"file://{tmp_path}/memo")
        assert sem_filter(df, "{s} is a letter", model).count() == 1
    assert used(spark, model) == {"": (0, 1)}
