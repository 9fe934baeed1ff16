"""What a model is asked: the constant part of a prompt, apart from the row text."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

STRATEGIES = (None, "cot", "zs-cot")

_GUIDE = {
    "judge": "You get context and a claim. Decide whether the claim holds in that context.",
    "judge_list": (
        "You get several contexts, each opened by a [Context N] tag, and one claim. Decide for every "
        "context on its own whether the claim holds. Reply with a list such as [True, False], one entry "
        "per context, in order, and nothing else."
    ),
    "map": "You get context and an instruction. Carry out the instruction using the context.",
    "extract": "You get context. Read the requested fields from it and reply with one JSON object.",
    "compare": (
        "You get a question and two documents. Pick the document that answers the question better. "
        "You always have to pick one of the two."
    ),
    "fold": (
        "You get an instruction and several documents. Answer the instruction in one short, coherent "
        "text that brings together what the documents say."
    ),
    "fold_again": (
        "You get an instruction and several sources, each of which already sums up some documents. "
        "Answer the instruction in one short, coherent text that draws on every source, also where "
        "they disagree."
    ),
    "agree": (
        "You get a prediction and a reference answer. The prediction is right unless it contradicts "
        "the facts of the reference. Answer with True or False."
    ),
}

_CLOSING = {
    "judge": 'Reply with the single word "True" or "False".',
    "compare": 'Reply with "Document 1" or "Document 2" only.',
}

_CLOSING_COT = {
    "judge": 'Give your reasoning first and end with "Answer: True" or "Answer: False".',
    "map": 'Give your reasoning first and end with "Answer: " and your answer.',
    "compare": 'Give your reasoning first and end with "Answer: Document 1" or "Answer: Document 2".',
}

_LEAD = {"judge": "Claim", "judge_list": "Claim", "map": "Instruction", "compare": "Question",
         "fold": "Instruction", "fold_again": "Instruction", "agree": "Claim"}


@dataclass(frozen=True)
class Shot:
    """One worked example: a context, the right answer and, for cot, the reasoning."""

    context: str
    answer: str
    reasoning: str | None = None


@dataclass(frozen=True)
class PromptSpec:
    """The part of a prompt that is the same for every row of one operator call."""

    task: str
    instruction: str = ""
    strategy: str | None = None
    shots: tuple[Shot, ...] = ()
    fields: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {STRATEGIES}")
        if self.strategy == "cot" and any(s.reasoning is None for s in self.shots):
            raise ValueError("strategy 'cot' needs a Reasoning for every example")

    @property
    def reasons(self) -> bool:
        """Whether replies carry reasoning before the answer."""
        return self.strategy == "zs-cot" or (self.strategy == "cot" and bool(self.shots))

    def system(self) -> str:
        lines = [_GUIDE[self.task]]
        if self.fields:
            lines.append("Fields: " + json.dumps(dict(self.fields), ensure_ascii=False))
        closing = (_CLOSING_COT if self.reasons else _CLOSING).get(self.task)
        if closing:
            lines.append(closing)
        return "\n".join(lines)

    def _user(self, context: str) -> dict[str, str]:
        lead = _LEAD.get(self.task)
        tail = f"\n\n{lead}: {self.instruction}" if lead else ""
        return {"role": "user", "content": f"Context:\n{context}{tail}"}

    def prefix(self) -> list[dict[str, str]]:
        """System message and worked examples."""
        messages = [{"role": "system", "content": self.system()}]
        for s in self.shots:
            said = f"Reasoning:\n{s.reasoning}\n\nAnswer: {s.answer}" if self.strategy == "cot" else s.answer
            messages += [self._user(s.context), {"role": "assistant", "content": said}]
        return messages

    def messages(self, context: str) -> list[dict[str, str]]:
        """The whole chat for one row, as a chat service takes it."""
        return [*self.prefix(), self._user(context)]

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.messages("\x00"), ensure_ascii=False).encode()).hexdigest()


def shots_from(
    examples, names: Sequence[str], strategy: str | None, labels: Sequence[str] | None = None
) -> tuple[Shot, ...]:
    """Worked examples from a small Spark or pandas frame with an ``Answer`` column."""
    if examples is None:
        return ()
    from semtab.functions.claims import row_text

    if hasattr(examples, "sparkSession"):
        if "Answer" not in examples.columns:
            raise ValueError("examples need an Answer column")
        rows = examples.withColumn("_context", row_text(examples, list(names), list(labels or names))).collect()
        records = [r.asDict() for r in rows]
    else:
        if "Answer" not in examples.columns:
            raise ValueError("examples need an Answer column")
        records = examples.to_dict("records")
        for r in records:
            r["_context"] = "".join(
                f"[{label.capitalize()}]: «{r[name]}»\n" for name, label in zip(names, labels or names)
            )
    if strategy == "cot" and any("Reasoning" not in r for r in records):
        raise ValueError("strategy 'cot' needs a Reasoning column in the examples")
    return tuple(
        Shot(r["_context"], str(r["Answer"]), str(r["Reasoning"]) if strategy == "cot" else None) for r in records
    )
