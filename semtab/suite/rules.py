"""Offline models for the suite: each answers from the prompt text by a plain rule."""

from __future__ import annotations

import json
import re

from semtab.models.base import RuleModel, labelled_values, parts_of


def value(context: str, at: int = 0) -> str:
    return labelled_values(context)[at][1]


def whole(context: str) -> str:
    """The value of a one-column context, whatever it holds."""
    return context.partition("«")[2].rpartition("»")[0]


def said(truth: bool, spec) -> str:
    text = str(bool(truth))
    return f"Reasoning:\nread from the text\n\nAnswer: {text}" if spec.reasons else text


def judge(test, chance=None) -> RuleModel:
    return RuleModel(lambda spec, c: said(test(c), spec), chance=chance)


def mapper(f) -> RuleModel:
    return RuleModel(lambda spec, c: f"Reasoning:\nread\n\nAnswer: {f(c)}" if spec.reasons else str(f(c)))


def batch_judge(test) -> RuleModel:
    return RuleModel(lambda spec, c: str([test(v) for _, v in labelled_values(c)]))


def extractor(f) -> RuleModel:
    return RuleModel(lambda spec, c: json.dumps(f(c)))


def earlier(c: str) -> str:
    """The document whose text comes first in the alphabet."""
    a, b = value(c, 0), value(c, 1)
    return "Document 1" if a <= b else "Document 2"


ALPHABET = RuleModel(lambda spec, c: earlier(c), chance=lambda spec, c: 0.9 if value(c)[0] != value(c, 1)[0] else 0.4)


def fold_with(pick) -> RuleModel:
    """Answers a folding prompt by choosing among the values of its documents or sources."""

    def rule(spec, c: str) -> str:
        values = [whole(p) if spec.task == "fold" else p for p in parts_of(c)]
        return pick(values)

    return RuleModel(rule, context_tokens=4_000, reply_tokens=512)


LARGEST = fold_with(max)
LAST = fold_with(lambda values: values[-1])


LONGEST = RuleModel(
    lambda spec, c: str(max(len(whole(p)) if spec.task == "fold" else int(p) for p in parts_of(c))),
    context_tokens=4_000,
)


def trailing_number(text: str) -> int:
    return int(re.search(r"(\d+)$", text).group(1))
