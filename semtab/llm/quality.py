"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.llm.common import whole_text
from semtab.runtime import col, require_columns, stage

SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
#: Values of a line by itself; those of the lines before and behind it follow.
OWN = 15


def line_values(line: str, seen: set[str]) -> list[float]:
    """What a line looks like by itself: length, repetition, symbols, shouting, digits, end."""
    words = line.split()
    n = len(words)
    repeats = 1 - len(set(words)) / n
    stutter = sum(map(eq, words, words[1:])) / n
    symbols = sum(map(line.count, SYMBOLS)) / n
    shouts = line.count("!") / n
    upper = sum(map(str.isupper, words)) / n
    digits = sum(map(line.count, DIGITS)) / len(line)
    known = line in seen
    seen.add(line)
    return [
        min(n, 400) ** 0.5 / 20,
        float(n < 4),
        repeats,
        float(repeats > 0.5),
        stutter,
        float(stutter > 0.2),
        min(symbols, 2.0) / 2,
        float(symbols > 0.1),
        min(shouts, 1.0),
        float(shouts > 0.1),
        upper,
        float(upper > 0.5),
        min(len(line) / n / 15, 2.0),
        digits,
        float(known) + 0.5 * (line[-1] in ".!?"),
    ]


def text_values(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lines of a text that have a word, and their lengths."""
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    seen: set[str] = set()
    values = np.array([line_values(line, seen) for line in lines], np.float32).reshape(-1, OWN)
    return values, np.array([len(line) for line in lines], np.float64)


def with_neighbours(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values of each line, the line before and the line behind it in its document; a constant; first and last line marked."""
    ends = np.cumsum(counts)
    first, last = np.zeros(len(values), bool), np.zeros(len(values), bool)
    first[(ends - counts)[counts > 0]] = True
    last[ends[counts > 0] - 1] = True
    before, behind = np.roll(values, 1, axis=0), np.roll(values, -1, axis=0)
    before[first], behind[last] = 0, 0
    return np.concatenate([values, before, behind, np.ones((len(values), 1)), first[:, None], last[:, None]], axis=1)


@dataclass
class Chain:
    """Weights of good lines against bad ones, and of pairs of neighbouring labels (bad 0, good 1)."""

    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, x: np.ndarray, counts: np.ndarray, with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Chance of good for each line, by forward-backward over all documents side by side."""
        emit = np.stack([np.zeros(len(x)), x @ self.weights], axis=1)
        forward, backward = emit.copy(), np.zeros_like(emit)
        order = np.argsort(-counts, kind="stable")
        begin = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest + 1), side="left")  # documents with more than t lines
        for t in range(1, longest):
            at = begin[: active[t]] + t
            p = forward[at - 1]
            forward[at] += np.logaddexp(p[:, :1] + self.pairs[0], p[:, 1:] + self.pairs[1])
        for t in range(longest - 2, -1, -1):
            at = begin[: active[t + 1]] + t
            b = backward[at + 1] + emit[at + 1]
            backward[at] = np.logaddexp(b[:, :1] + self.pairs[:, 0], b[:, 1:] + self.pairs[:, 1])
        both = forward + backward
        total = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - total)
        if not with_pairs:
            return good, None
        inner = np.ones(len(x), bool)
        inner[(np.cumsum(counts) - counts)[counts > 0]] = False
        at = np.flatnonzero(inner)
        joint = forward[at - 1][:, :, None] + self.pairs + (emit[at] + backward[at])[:, None, :] - total[at][:, None, None]
        return good, np.exp(joint).sum(axis=0)


def fit_chain(values: list[np.ndarray], labels: list[int], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Chain:
    """Likelihood of the labels, each line bearing its document's, climbed by Adam on the whole sample."""
    counts = np.array([len(v) for v in values])
    x = with_neighbours(np.concatenate(values).astype(np.float64), counts)
    y = np.repeat(np.array(labels, float), counts)
    kept = np.array([[0.0, 0.0], [0.0, 0.0]])
    same = np.maximum(counts - 1, 0)
    kept[1, 1], kept[0, 0] = (same * np.array(labels)).sum(), (same * (1 - np.array(labels))).sum()
    chain = Chain(np.zeros(x.shape[1]), np.zeros((2, 2)))
    state = [np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)]
    for step in range(1, rounds + 1):
        good, joint = chain.marginals(x, counts, True)
        at = np.concatenate([chain.weights, chain.pairs.ravel()])
        slope = np.concatenate([x.T @ (y - good), (kept - joint).ravel()]) / len(counts) - ridge * at
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.99 * state[1] + 0.01 * slope**2
        at = at + rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        chain = Chain(at[:-4], at[-4:].reshape(2, 2))
    return chain


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    train_docs: int = 6_000,
    train_lines: int = 2_000,
    train_lines_total: int = 400_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Chain | None:
    """A chain fitted to about ``train_docs`` labelled documents of up to ``train_lines`` lines, ``train_lines_total`` lines at most in all.

    ``learn_from`` is a condition on the rows of ``labels``. The sample is taken by a hash of
    the id, so reruns learn the same; all labelled documents are used if there are fewer. An id with labels that
    disagree is left out, as are missing labels and texts without words. Lines are measured in
    tasks; the driver gets ``OWN`` numbers per line of the sample, whose documents are taken in the order of a hash until their
    lines, or twice ``train_docs`` rows, are reached: an id with very many rows makes the sample no larger. None if nothing can be learnt.
    """
    grain = 1 << 30
    known = labels.where(learn_from).select(col(id_col).alias("_id"), col(label_col).cast("int").alias("_label"))
    known = known.where("_id IS NOT NULL AND _label IN (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most")
    share = min(grain, grain * train_docs // max(known.count(), 1) + 1)
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(grain)) < share).select("_id", "_label")
    # about train_docs rows of an id and a label
    sample = docs.select(col(id_col).alias("_id"), whole_text(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, found, lines = [], [], [], []
            for ident, label, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                values = text_values(text.as_py())[0]
                if 0 < len(values) <= train_lines:
                    ids.append(ident.as_py())
                    found.append(label.as_py())
                    out.append(values.tobytes())
                    lines.append(len(values))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(found, pa.int32()), pa.array(out, pa.binary()), pa.array(lines, pa.int64())], names=["_id", "_label", "_values", "_lines"]
            )

    measured = sample.select(F.col("_id").cast("string").alias("_id"), "_label", "_text").mapInArrow(measure, "_id string, _label int, _values binary, _lines long")
    ordered = stage(measured, "quality-sample").orderBy(F.xxhash64("_id"), "_id", "_values")
    # sizes first: only rows within the bound are fetched
    sizes = [r["_lines"] for r in ordered.select("_id", "_values", "_lines").limit(2 * train_docs).select("_lines").collect()]
    fitting = int(np.searchsorted(np.cumsum(sizes), train_lines_total, side="right"))
    rows = ordered.limit(fitting).collect() if fitting else []
    if len({r["_label"] for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r["_id"], bytes(r["_values"])))
    return fit_chain([np.frombuffer(bytes(r["_values"]), np.float32).reshape(-1, OWN) for r in rows], [r["_label"] for r in rows])


def quality_scores(texts: list[str], chain: Chain) -> list[float]:
    """Mean chance of a good line, each line weighing its length; 0 for a text without words."""
    measured = [text_values(t) for t in texts]
    counts = np.array([len(v) for v, _ in measured], np.int64)
    if not counts.sum():
        return [0.0] * len(texts)
    good, _ = chain.marginals(with_neighbours(np.concatenate([v for v, _ in measured]).astype(np.float64), counts), counts)
    ends = np.cumsum(counts)
    return [float(np.clip(good[e - n : e] @ sizes / sizes.sum(), 0, 1)) if n else 0.0 for (_, sizes), n, e in zip(measured, counts, ends)]


def _scored(texts: pa.Array, chain: Chain) -> list[float]:
    out, group, size = [], [], 0
    for t in texts:
        text = t.as_py()
        group.append(text)
        size += len(text)
        if size > 4 << 20:
            out += quality_scores(group, chain)
            group, size = [], 0
    return out + quality_scores(group, chain)


def score_quality(docs: DataFrame, chain: Chain | None, limit: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id score predicted`` for every row: the length-weighted mean of its lines' chances of being good.

    Missing and empty texts, and those without a word, score 0. Without a chain (no labels to learn from) all
    others score 1. Repeated rows each give a row.
    """
    require_columns(docs, [id_col, text_col])
    plain = docs.select(col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = T.StructType([T.StructField("_id", plain.schema["_id"].dataType), T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if chain is None:
                scores = [0.0 if not t.as_py().strip() else 1.0 for t in batch.column(1)]
            else:
                scores = _scored(batch.column(1), chain)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["_id", "_score"])

    return plain.mapInArrow(run, schema).select(F.col("_id").alias(id_col), F.col("_score").alias("score"), (F.col("_score") >= limit).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, chain: Chain | None, limit: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``limit`` or more, all columns kept; the filter runs where the rows are."""
    require_columns(docs, [text_col])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([t.as_py() or "" for t in batch.column(at)], pa.string())
            good = [bool(t.strip()) for t in texts.to_pylist()] if chain is None else [s >= limit for s in _scored(texts, chain)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
