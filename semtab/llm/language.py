"""Language of a text by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.llm.common import whole_text
from semtab.runtime import col, require_columns, stage

UNKNOWN = "und"
#: A gram packs up to three code points of 21 bits.
BITS = 21
CHUNK = 1 << 19

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Grams of one to three characters of a whole text and how often each occurs.

    The text is lower-cased; each run of other characters than letters is one space, also
    at both ends. Single spaces are no grams. Long texts are counted piece by piece, so
    memory follows the piece and the number of distinct grams.
    """
    table = _letter_table()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = table[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of others stands for the space
    chars = np.where(letter, points, 32)[keep].astype(np.int64)
    chars = np.concatenate([[32], chars[1:] if chars[0] == 32 else chars, [] if chars[-1] == 32 else [32]]).astype(np.int64)
    grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for a in range(0, len(chars), CHUNK):
        c = chars[a : a + CHUNK + 2]
        n = min(CHUNK, len(chars) - a)
        one = c[:n][c[:n] != 32]
        two = (c[:n][: len(c) - 1] << BITS) | c[1 : n + 1]
        three = (two[: len(c) - 2] << BITS) | c[2 : n + 2]
        g, k = np.unique(np.concatenate([one, two, three]), return_counts=True)
        if len(grams):
            g, at = np.unique(np.concatenate([grams, g]), return_inverse=True)
            k = np.bincount(at, np.concatenate([counts, k])).astype(np.int64)
        grams, counts = g, k
    return grams, counts


def ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent grams, most frequent first, ties by gram."""
    if len(grams) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        some = counts >= least
        grams, counts = grams[some], counts[some]
    return grams[np.lexsort((grams, -counts))][:top]


def text_profile(text: str, top: int) -> np.ndarray:
    return ranked(*gram_counts(text), top)


class Profiles:
    """Ranks of the languages' grams as one table: languages by code, grams sorted."""

    def __init__(self, ranks: dict[str, list[int]], top: int) -> None:
        self.languages = sorted(ranks)
        self.top = top
        self.grams = np.unique(np.concatenate([np.asarray(v, np.int64) for v in ranks.values()])) if ranks else np.empty(0, np.int64)
        # a gram that a profile lacks is out of place by the length of a profile
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int32)
        for k, name in enumerate(self.languages):
            grams = np.asarray(ranks[name], np.int64)
            self.ranks[np.searchsorted(self.grams, grams), k] = np.arange(len(grams))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        """Sum of how far each gram of a document stands from its place in each language."""
        at = np.searchsorted(self.grams, profile)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != profile)] = len(self.grams)
        there = self.ranks[at]
        apart = np.abs(there - np.arange(len(profile), dtype=np.int32)[:, None])
        return np.where(there < 0, self.top, np.minimum(apart, self.top)).sum(axis=0)

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language, ties by code, and how much nearer it is than the next one."""
        profile = text_profile(text, self.top)
        if not len(profile) or not self.languages:
            return UNKNOWN, 0.0
        d = self.distances(profile)
        best = int(d.argmin())
        if len(d) == 1:
            return self.languages[best], 1.0 - float(d[best]) / (self.top * len(profile))
        other = int(np.delete(d, best).min())
        return self.languages[best], 1.0 - float(d[best]) / (float(d[best]) + other) if other else 0.5


def held_out(id_col: str, fold: int, folds: int) -> Column:
    """True for documents of the fold that is never learnt from; a missing id is learnt from."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % folds == fold, F.lit(False))


def learn_profiles(
    docs: DataFrame,
    learn_from: Column,
    top: int = 400,
    sample_docs: int = 20_000,
    max_languages: int = 2_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Profiles:
    """Rank profiles of all languages from labelled documents.

    About ``sample_docs`` documents per language are learnt from (all if there are fewer),
    taken by a hash of id and text, so reruns learn the same. Grams are counted per task
    and language before they are shuffled. More than ``max_languages`` labels are refused:
    that bounds what is sent to the tasks to ``top * max_languages`` grams.
    """
    lang = F.when(learn_from, col(lang_col).cast("string"))
    shares = docs.select(lang.alias("_lang")).where("_lang IS NOT NULL").groupBy("_lang").count().limit(max_languages + 1).collect()
    if len(shares) > max_languages:
        raise ValueError(f"more than {max_languages} languages among the labels")
    if not shares:
        return Profiles({}, top)
    grain = 1 << 30
    limit = F.create_map(*[F.lit(x) for r in shares for x in (r["_lang"], min(grain, grain * sample_docs // r["count"] + 1))])
    place = F.pmod(F.xxhash64(col(id_col), col(text_col)), F.lit(grain))
    sample = docs.select(lang.alias("_lang"), whole_text(text_col).alias("_text"), place.alias("_place")).where("_lang IS NOT NULL").where(F.col("_place") < limit[F.col("_lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                parts = [gram_counts(t) for l, t in zip(langs, texts) if l == lang]
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["_lang", "_gram", "_n"])

    counted = sample.select("_lang", "_text").mapInArrow(count, "_lang string, _gram long, _n long")
    total = counted.groupBy("_lang", "_gram").agg(F.sum("_n").alias("_n"))
    order = Window.partitionBy("_lang").orderBy(F.desc("_n"), "_gram")
    best = total.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top)
    ranks: dict[str, list[int]] = {}
    for r in stage(best.select("_lang", "_gram", "_rank"), "language-profiles").orderBy("_lang", "_rank").collect():
        ranks.setdefault(r["_lang"], []).append(r["_gram"])
    return Profiles(ranks, top)


def identify_languages(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id lang_pred score`` for every row; the label, if there is one, is not read.

    The score is 0.5 where the two nearest languages are equally far and nears 1 where the
    nearest fits and no other does. A text that is missing or has no letter, and any text
    when no profile was learnt, gives ``und`` with score 0. Repeated rows each give a row.
    """
    require_columns(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["_id", "_lang", "_score"]
            )

    plain = docs.select(col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = T.StructType([T.StructField("_id", plain.schema["_id"].dataType), T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])
    return plain.mapInArrow(run, schema).select(F.col("_id").alias(id_col), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
