"""Replies and usage of every model call, kept in a folder that all workers reach.

``recorded(spark, model, folder)`` wraps a model. The wrapper goes where the model goes, so filters, joins,
rankings, foldings, cascades and SQL functions remember and count alike, and a job that failed half-way
asks nothing again that was answered before.

* Each batch of new replies is written at once, as one file below ``log``. Its name follows from the prompts, so a
  repeated task finds the file of its earlier attempt.
* Wrapping a model compacts: logged replies become a generation below ``kept``, bucketed by prompt hash.
  A worker reads only the buckets its prompts fall into. Eight generations are merged into one.
* Each batch leaves a line below ``usage``, named by stage, task and prompts, so that repeated tasks
  are counted once. ``usage_of`` sums it up.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import OrderedDict
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semtab.models.base import AnswerModel, Reply, TokenChance
from semtab.models.prompts import PromptSpec

#: Replies of one bucket, about; buckets a worker holds; generations before they are merged.
BUCKET_REPLIES, BUCKETS_HELD, GENERATIONS = 5_000, 64, 8
_REPLIES = pa.schema([("prompt", pa.string()), ("text", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("cost", pa.float64()), ("logprobs", pa.string())])
_USAGE = pa.schema([(n, pa.string()) for n in ("run", "step")] + [(n, pa.int64()) for n in ("calls", "hits", "prompt_tokens", "completion_tokens")] + [("cost", pa.float64())])
_REPLY_DDL = "prompt string, text string, prompt_tokens long, completion_tokens long, cost double, logprobs string"
_USAGE_DDL = "run string, step string, calls long, hits long, prompt_tokens long, completion_tokens long, cost double"

_held: OrderedDict[str, dict] = OrderedDict()


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    return pafs.LocalFileSystem(), folder


def _write(fs: pafs.FileSystem, path: str, table: pa.Table) -> None:
    """A whole file or none: readers never see half of one."""
    draft = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        pq.write_table(table, out)
    fs.move(draft, path)


def _pack(reply: Reply) -> str | None:
    return None if reply.logprobs is None else json.dumps([[t.token, t.logprob, t.top] for t in reply.logprobs])


def _unpack(row: dict) -> Reply:
    chances = row["logprobs"] and [TokenChance(t, p, [tuple(x) for x in top]) for t, p, top in json.loads(row["logprobs"])]
    return Reply(row["text"], row["prompt_tokens"], row["completion_tokens"], row["cost"], chances)


def bucket_of(prompt: str, buckets: int) -> int:
    return int(prompt[:8], 16) * buckets >> 32


class Recorded:
    """A model that remembers (unless ``remember`` is off) and counts. Made by :func:`recorded`."""

    def __init__(self, model: AnswerModel, folder: str, generations: list[tuple[str, int]], step: str, remember: bool) -> None:
        self.model, self.folder, self.generations, self.step, self.remember = model, folder.rstrip("/"), generations, step, remember
        self.run = uuid.uuid4().hex
        self.name, self.batch_size = model.name, model.batch_size
        self.context_tokens, self.reply_tokens = model.context_tokens, model.reply_tokens
        if hasattr(model, "count_tokens"):
            self.count_tokens = model.count_tokens

    def at(self, step: str) -> Recorded:
        """The same memo and run, counted under another step."""
        other = Recorded(self.model, self.folder, self.generations, step, self.remember)
        other.run = self.run
        return other

    def answer(self, spec: PromptSpec, contexts: Sequence[str], logprobs: bool = False) -> list[Reply]:
        settings = hashlib.sha256(f"{self.name}|{spec.fingerprint()}|{logprobs}".encode()).hexdigest()
        prompts = [hashlib.sha256((settings + c).encode("utf-8", "surrogatepass")).hexdigest() for c in contexts]
        fs, root = _open(self.folder)
        known = self._kept(fs, root, prompts) if self.remember else {}
        fresh = {p: c for p, c in zip(prompts, contexts) if p not in known}
        asked: dict[str, Reply] = {}
        if fresh:
            path = f"{root}/log/{hashlib.sha256(''.join(sorted(fresh)).encode()).hexdigest()}.parquet"
            earlier = self._read(fs, path) if self.remember and fs.get_file_info(path).type == pafs.FileType.File else {}
            if earlier:
                known |= earlier
            else:
                order = list(fresh)
                replies = self.model.answer(spec, [fresh[p] for p in order], logprobs)
                if len(replies) != len(order):
                    raise ValueError(f"model {self.name} gave {len(replies)} replies to {len(order)} prompts")
                asked = dict(zip(order, replies))
                if self.remember:
                    rows = [{"prompt": p, "text": r.text, "prompt_tokens": r.prompt_tokens, "completion_tokens": r.completion_tokens, "cost": r.cost, "logprobs": _pack(r)} for p, r in asked.items()]
                    _write(fs, path, pa.Table.from_pylist(rows, _REPLIES))
        self._count(fs, root, prompts, asked)
        return [asked[p] if p in asked else known[p] for p in prompts]

    def _read(self, fs: pafs.FileSystem, path: str) -> dict[str, Reply]:
        with fs.open_input_file(path) as f:
            return {r["prompt"]: _unpack(r) for r in pq.read_table(f).to_pylist()}

    def _kept(self, fs: pafs.FileSystem, root: str, prompts: list[str]) -> dict[str, Reply]:
        found = {}
        for generation, buckets in self.generations:
            by_bucket: dict[int, list[str]] = {}
            for p in prompts:
                by_bucket.setdefault(bucket_of(p, buckets), []).append(p)
            for bucket, some in by_bucket.items():
                path = f"{root}/kept/{generation}/bucket={bucket}"
                if path not in _held:
                    files = [f.path for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
                    _held[path] = {p: r for f in files for p, r in self._read(fs, f).items()}
                    while len(_held) > BUCKETS_HELD:
                        _held.popitem(last=False)
                else:
                    _held.move_to_end(path)
                found.update((p, _held[path][p]) for p in some if p in _held[path])
        return found

    def _count(self, fs: pafs.FileSystem, root: str, prompts: list[str], asked: dict[str, Reply]) -> None:
        task = TaskContext.get()
        place = f"{task.stageId()}-{task.partitionId()}" if task else uuid.uuid4().hex
        name = hashlib.sha256(f"{self.run}|{self.step}|{place}|{''.join(prompts)}".encode()).hexdigest()
        row = {"run": self.run, "step": self.step, "calls": len(asked), "hits": len(prompts) - len(asked), "prompt_tokens": sum(r.prompt_tokens for r in asked.values()),
               "completion_tokens": sum(r.completion_tokens for r in asked.values()), "cost": float(sum(r.cost for r in asked.values()))}
        path = f"{root}/usage/{name}.parquet"
        # a repeated task finds its replies in the log and must not turn its calls into hits
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            _write(fs, path, pa.Table.from_pylist([row], _USAGE))


def recorded(spark: SparkSession, model: AnswerModel, folder: str, step: str = "", remember: bool = True) -> Recorded:
    """``model`` with a memory and a count in ``folder``, which the driver and all Python workers must reach.

    Replies logged by earlier runs are compacted first, so this one sees them. ``remember=False`` counts only. Prompts are known by model name,
    prompt settings and context; a folder may serve any number of models and operators.
    """
    fs, root = _open(folder.rstrip("/"))
    for part in ("log", "kept", "usage"):
        fs.create_dir(f"{root}/{part}", recursive=True)
    return Recorded(model, folder, _compact(spark, fs, root, folder.rstrip("/")) if remember else [], step, remember)


def _compact(spark: SparkSession, fs: pafs.FileSystem, root: str, folder: str) -> list[tuple[str, int]]:
    """The live generations as ``(name, buckets)``, after the logged replies have become one."""
    at = f"{root}/kept/live.json"
    live: list[tuple[str, int]] = []
    if fs.get_file_info(at).type == pafs.FileType.File:
        with fs.open_input_stream(at) as f:
            live = [tuple(g) for g in json.loads(f.read())]
    logs = [f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{root}/log")) if f.base_name.endswith(".parquet")]
    if not logs:
        return live
    merge = len(live) + 1 > GENERATIONS
    rows = spark.read.schema(_REPLY_DDL).parquet(f"{folder}/log")
    if merge:
        for name, _ in live:
            rows = rows.unionByName(spark.read.schema(_REPLY_DDL).parquet(f"{folder}/kept/{name}").drop("bucket"))
    buckets = 1 << max(0, (rows.count() // BUCKET_REPLIES).bit_length())
    name = f"gen-{uuid.uuid4().hex}"
    once = rows.dropDuplicates(["prompt"])
    place = F.shiftright(F.conv(F.substring("prompt", 1, 8), 16, 10).cast("long") * buckets, 32).cast("int")
    once.withColumn("bucket", place).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/kept/{name}")
    live = [(name, buckets)] if merge else [*live, (name, buckets)]
    draft = f"{root}/kept/.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(json.dumps(live).encode())
    fs.move(draft, at)
    for n in logs:  # their replies are in the generation now
        fs.delete_file(f"{root}/log/{n}")
    return live


def usage_of(spark: SparkSession, folder: str, run: str | None = None) -> DataFrame:
    """``step calls hits prompt_tokens completion_tokens total_tokens cost`` of a run, or of all runs of a folder."""
    rows = spark.read.schema(_USAGE_DDL).parquet(f"{folder.rstrip('/')}/usage")
    if run is not None:
        rows = rows.where(F.col("run") == run)
    sums = [F.sum(c).alias(c) for c in ("calls", "hits", "prompt_tokens", "completion_tokens")]
    return rows.groupBy("step").agg(*sums, F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.sum("cost").alias("cost"))
