"""Chat-model clients. Rows call them in Arrow batches; which one is used is a parameter."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..fixed import EMOTIONS, TAG_ANSWER, TAG_QUESTION, TAG_THOUGHT

Messages = list[dict[str, str]]


class CallFailed(Exception):
    """A call that gave no reply."""


class Client(Protocol):
    """Answers a list of messages; raises ``CallFailed``. Must be picklable: it travels to the executors."""

    def complete(self, task: str, messages: Messages, temperature: float = 0.0, schema: dict | None = None) -> str: ...


def request_key(task: str, messages: Messages) -> str:
    """What tells requests apart: the digest of the task and of each message's role and content, each after its length."""
    parts = [task, *(p or "" for m in messages for p in (m["role"], m["content"]))]
    return hashlib.sha256("".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()


def request_column(task: str, messages: Column) -> Column:
    """``request_key`` of an array of messages, as a column."""
    piece = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    part = lambda m, name: piece(F.coalesce(m[name], F.lit("")))
    said = F.transform(messages, lambda m: F.concat(part(m, "role"), part(m, "content")))
    return F.sha2(F.concat(piece(F.lit(task)), F.array_join(said, "")), 256)


def made_reply(task: str, n: int, finish_in: int) -> str:
    """A reply of each task's form, made from a number; a tutor ends a dialogue where n // 16 is divisible by ``finish_in``."""
    if task == "translate":
        return f"{TAG_THOUGHT} step {n % 7} {TAG_QUESTION} question {n % 1000} {TAG_ANSWER} answer {n % 100}"
    if task == "similar":
        return json.dumps({"similar_question": f"question {n % 1000}", "similar_solution": f"solution {n % 100}"})
    if task == "judge":
        return json.dumps({"is_correct": n % 3 != 0, "judge_reason": f"reason {n % 10}"})
    if task in ("teacher", "teacher_free"):
        reply = {
            "thought_process": f"thought {n % 50}",
            "student_emotion": EMOTIONS[n % len(EMOTIONS)],
            "roadmap_breakdown": f"roadmap {n % 9}",
            "next_step_plan": f"plan {n % 11}",
            "is_completed": n // 16 % finish_in == 0,
            "teacher_utterance": f"utterance {n % 1000}.",
        }
        text = json.dumps(reply, ensure_ascii=False)
        return f"Here it is: {text}" if task == "teacher_free" and n % 2 else text
    return f" words {n % 1000} "


@dataclass(frozen=True)
class StubClient:
    """Replies made from the request's digest: the same request always gets the same reply, without a network.

    ``finish_in``: a tutor ends a dialogue in about one of so many turns. ``fail_in``:
    one of so many calls fails, 0 none."""

    finish_in: int = 4
    fail_in: int = 0

    def number(self, task: str, messages: Messages) -> int:
        return int(request_key(task, messages)[:12], 16)

    def complete(self, task: str, messages: Messages, temperature: float = 0.0, schema: dict | None = None) -> str:
        n = self.number(task, messages)
        if self.fail_in and n % self.fail_in == 0:
            raise CallFailed(f"stub failure {n % 1000}")
        return made_reply(task, n, self.finish_in)


@dataclass(frozen=True)
class LengthClient(StubClient):
    """Replies made from the number of characters of all messages, which SQL can count too."""

    def number(self, task: str, messages: Messages) -> int:
        return sum(len(m["content"]) for m in messages)


@dataclass(frozen=True)
class ReplayClient:
    """Recorded replies by ``request_key``; None stands for a failure, and so does a request that was not recorded."""

    replies: dict[str, str | None] = field(default_factory=dict)

    def complete(self, task: str, messages: Messages, temperature: float = 0.0, schema: dict | None = None) -> str:
        reply = self.replies.get(request_key(task, messages))
        if reply is None:
            raise CallFailed("no recorded reply")
        return reply


@dataclass(frozen=True)
class ReplayTable:
    """Recorded replies as a table (request, reply), found by a join on the request's key, which the JVM makes: no reply
    is held by the driver or sent with a task, so there may be as many as a table can hold.

    A request that was not recorded, or only without a reply, is a failed call. Of several replies to one request the
    smallest counts."""

    replies: DataFrame

    def answer(self, rows: DataFrame, task: str, messages: Column) -> DataFrame:
        known = self.replies.groupBy(F.col("request").alias("_request")).agg(F.min("reply").alias("reply"))
        found = rows.withColumn("_request", request_column(task, messages)).join(known, "_request", "left").drop("_request")
        return found.withColumn("error", F.when(F.col("reply").isNull(), "no recorded reply"))


def ask(
    rows: DataFrame, client: Client | ReplayTable, task: str, messages: Column, temperature: float, schema: dict | None = None, in_flight: int = 8
) -> DataFrame:
    """Adds ``reply`` and ``error`` for one request a row, whose ``messages`` are a column: by calls, or from recorded replies."""
    if isinstance(client, ReplayTable):
        return client.answer(rows, task, messages)
    asked = call(rows.withColumn("_messages", messages), client, task, lambda r: r["_messages"], temperature, schema=schema, in_flight=in_flight)
    return asked.drop("_messages")


def call(
    df: DataFrame,
    client: Client,
    task: str,
    build: Callable[[dict], Messages],
    temperature: float,
    partitions: int | None = None,
    schema: dict | None = None,
    in_flight: int = 8,
) -> DataFrame:
    """Adds ``reply`` and ``error`` to each row; a failed call has an error and a null reply.

    Filter rows first: nothing is pushed below this step. ``partitions`` and
    ``in_flight``, the calls that a task has open at a time, bound how many calls run
    at once. ``schema`` is the form of the reply that the client is told. Write the
    result before using it twice.
    """
    kinds = StructType([*df.schema.fields, StructField("reply", StringType()), StructField("error", StringType())])

    def ask(row: dict) -> tuple[str | None, str | None]:
        try:
            return client.complete(task, build(row), temperature, schema), None
        except CallFailed as error:
            return None, str(error) or "failed"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                got = list(pool.map(ask, batch.to_pylist()))
                added = [pa.array([g[k] for g in got], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "reply", "error"])

    return (df.repartition(partitions) if partitions else df).mapInArrow(run, kinds)
