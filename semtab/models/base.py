"""Model protocols and the offline stand-ins used by tests and oracles.

A model is a picklable object. It is shipped to Python workers and called there
with batches of row texts; clients with sockets should open them lazily in
``answer``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from typing import NamedTuple, Protocol

import numpy as np

from semtab.models.prompts import PromptSpec


class TokenChance(NamedTuple):
    token: str
    logprob: float
    top: list[tuple[str, float]]


class Reply(NamedTuple):
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    cost: float = 0.0
    logprobs: list[TokenChance] | None = None


class AnswerModel(Protocol):
    """Anything that answers prompts."""

    name: str
    batch_size: int
    context_tokens: int
    reply_tokens: int

    def answer(self, spec: PromptSpec, contexts: Sequence[str], logprobs: bool = False) -> list[Reply]: ...


class Embedder(Protocol):
    dim: int
    batch_size: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, query: str, texts: Sequence[str]) -> np.ndarray: ...


def count_tokens(text: str) -> int:
    """Token length when no tokenizer is plugged in: a quarter of the characters."""
    return -(-len(text) // 4)


_LINE = re.compile(r"\[([^\]\n]*)\]: «(.*?)»\n", re.S)
_PART = re.compile(r"\n\t(?:Document|Source) \d+: ")


def labelled_values(context: str) -> list[tuple[str, str]]:
    """The ``[Label]: «value»`` lines of a row text, in order."""
    return _LINE.findall(context)


def parts_of(context: str) -> list[str]:
    """The documents or sources of a folding prompt."""
    return _PART.split(context)[1:]


class RuleModel:
    """Answers by a plain function ``rule(spec, context) -> str``; deterministic and offline.

    ``chance(spec, context)`` may give the probability of the reply's last word, so
    that cascades can be exercised without a model that reports log-probabilities.
    """

    def __init__(
        self,
        rule: Callable[[PromptSpec, str], str],
        *,
        name: str = "rule",
        chance: Callable[[PromptSpec, str], float] | None = None,
        batch_size: int = 64,
        context_tokens: int = 128_000,
        reply_tokens: int = 512,
        price_per_token: float = 0.0,
    ) -> None:
        self.rule, self.name, self.chance = rule, name, chance
        self.batch_size, self.context_tokens, self.reply_tokens = batch_size, context_tokens, reply_tokens
        self.price_per_token = price_per_token

    def answer(self, spec: PromptSpec, contexts: Sequence[str], logprobs: bool = False) -> list[Reply]:
        fixed = sum(count_tokens(m["content"]) for m in spec.messages(""))
        replies = []
        for context in contexts:
            text = self.rule(spec, context)
            asked, said = fixed + count_tokens(context), count_tokens(text)
            tokens = self._chances(spec, context, text) if logprobs else None
            replies.append(Reply(text, asked, said, self.price_per_token * (asked + said), tokens))
        return replies

    def _chances(self, spec: PromptSpec, context: str, text: str) -> list[TokenChance]:
        p = min(max(self.chance(spec, context) if self.chance else 1.0, 1e-12), 1.0 - 1e-12)
        word = text.split()[-1] if text.split() else text
        if word in ("True", "False"):
            true_p = p if word == "True" else 1.0 - p
            top = [("True", float(np.log(true_p))), ("False", float(np.log1p(-true_p)))]
        else:
            top = [(word, float(np.log(p)))]
        return [TokenChance(word, float(np.log(p)), top)]


class ConfidenceCascade:
    """Two models as one: the large one answers where the small one is unsure.

    Both are called inside the same task, batch by batch, so a cascade costs no
    extra pass over the data. Sureness is the probability the small model gave to
    the token that ``decides(token)`` accepts.
    """

    def __init__(self, small: AnswerModel, large: AnswerModel, threshold: float,
                 decides: Callable[[str], bool] = lambda t: t.strip(" \n").isnumeric()) -> None:
        self.small, self.large, self.threshold, self.decides = small, large, threshold, decides
        self.name = f"{small.name}|{large.name}@{threshold}"
        self.batch_size = small.batch_size
        self.context_tokens = min(small.context_tokens, large.context_tokens)
        self.reply_tokens = max(small.reply_tokens, large.reply_tokens)

    def answer(self, spec: PromptSpec, contexts: Sequence[str], logprobs: bool = False) -> list[Reply]:
        replies = list(self.small.answer(spec, contexts, True))
        unsure = [i for i, r in enumerate(replies) if not self._sure(r)]
        if unsure:
            again = self.large.answer(spec, [contexts[i] for i in unsure], logprobs)
            for i, second in zip(unsure, again):
                first = replies[i]
                replies[i] = Reply(second.text, first.prompt_tokens + second.prompt_tokens,
                                   first.completion_tokens + second.completion_tokens,
                                   first.cost + second.cost, second.logprobs)
        return replies

    def _sure(self, reply: Reply) -> bool:
        floor = float(np.log(self.threshold)) if self.threshold > 0 else -np.inf
        return any(self.decides(t.token) and t.logprob >= floor for t in reply.logprobs or [])


class HashEmbedder:
    """Hashed word counts, L2-normalised: a deterministic offline encoder.

    The first eight hexadecimal digits of a word's MD5 say which coordinate it counts in, the next two, odd or even, its sign.
    """

    #: Words whose hashes are remembered, by each copy of the encoder.
    held_words = 200_000

    def __init__(self, dim: int = 64, batch_size: int = 64) -> None:
        self.dim, self.batch_size = dim, batch_size
        self._places: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_places": {}}

    def _place(self, word: str) -> int:
        """Twice the word's coordinate, and one more where its sign is positive."""
        h = hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        place = 2 * (int.from_bytes(h[:4], "big") % self.dim) + (h[4] & 1)
        if len(self._places) >= self.held_words:
            self._places.clear()
        # of long words there may be many, and each would take much room
        if len(word) <= 64:
            self._places[word] = place
        return place

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        places, place = self._places, self._place
        for i, text in enumerate(texts):
            found = [p if (p := places.get(word)) is not None else place(word) for word in text.lower().split()]
            counts = np.bincount(np.array(found, np.int64), minlength=2 * self.dim)
            out[i] = counts[1::2] - counts[::2]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)


class OverlapScorer:
    """Share of query words found in the text: an offline pair scorer."""

    def score(self, query: str, texts: Sequence[str]) -> np.ndarray:
        wanted = set(query.lower().split())
        return np.array([len(wanted & set(t.lower().split())) / max(len(wanted), 1) for t in texts])
