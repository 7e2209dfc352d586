"""Simulated dialogues: learner and tutor take turns until the tutor ends the session or the turns run out.

A session is one row; all its calls run in one Arrow-batched map, and a task has several
sessions at work at a time. The state rules:
a failed learner's call leaves an even log; a failed tutor's call leaves the
learner's words unanswered; a session counts as completed only if the last tutor
reply that could be read said so.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..fixed import FAILED_ANSWER, FAILED_JUDGE, MAX_TURNS
from ..functions.text import as_text, parse_embedded
from ..schemas import DIALOGUE_TURN, JUDGE_REPLY, MESSAGES, TEACHER_REPLY
from .client import CallFailed, Client, Messages

TEACHER_FIELDS = ("thought_process", "student_emotion", "roadmap_breakdown", "next_step_plan")


def _message(role: str, content: str) -> dict[str, str]:
    return {"role": role, "content": content}


class Session:
    """Both sides' views of one dialogue. Each side sees its own words as the assistant's."""

    def __init__(self, student: Messages, teacher: Messages) -> None:
        self.student, self.teacher = list(student), list(teacher)

    def student_says(self, words: str) -> None:
        self.student.append(_message("assistant", words))
        self.teacher.append(_message("user", words))

    def teacher_says(self, words: str, as_written: str) -> None:
        self.student.append(_message("user", words))
        self.teacher.append(_message("assistant", as_written))


def corpus_dialogue(
    client: Client, problem: str, student_prompt: str, teacher_prompt: str, opening: str, teacher_opening: str, max_turns: int = MAX_TURNS
) -> tuple[list[dict], bool]:
    """(turns, completed) of a dialogue with structured tutor replies. The opening is said once and not kept."""
    session = Session([_message("system", student_prompt)], [_message("system", teacher_prompt), _message("user", teacher_opening.format(problem=problem))])
    log: list[dict] = []
    done = False
    for turn in range(max_turns):
        try:
            seen = session.student if turn else [*session.student, _message("user", opening)]
            words = client.complete("student", seen, 0.8).strip()
        except CallFailed:
            break
        log.append({"turn": turn, "role": "student", "content": words})
        session.student_says(words)
        try:
            reply = json.loads(client.complete("teacher", session.teacher, 0.2, TEACHER_REPLY))
            fields = {f: as_text(reply.get(f, "")) for f in TEACHER_FIELDS}
            said, done = as_text(reply.get("teacher_utterance", "")), reply.get("is_completed", False)
        except (CallFailed, ValueError, AttributeError):
            break
        log.append({"turn": turn, "role": "teacher", "content": said, **fields})
        if done:
            break
        session.teacher_says(said, said)
    return log, bool(done)


def evaluation_dialogue(client: Client, student: Messages, teacher: Messages, max_turns: int = MAX_TURNS) -> tuple[list[dict], bool]:
    """(log, completed) of a dialogue with a tutor under test, who answers in free text and sees its own raw replies."""
    session, log, done = Session(student, teacher), [], False
    for _ in range(max_turns):
        try:
            words = client.complete("student", session.student, 0.8).strip()
        except CallFailed:
            break
        log.append(_message("student", words))
        session.student_says(words)
        try:
            raw = client.complete("teacher_free", session.teacher, 0.2)
            said, done = parse_embedded(raw)
            said = as_text(said)
        except (CallFailed, AttributeError):
            break
        log.append(_message("teacher", said))
        session.teacher_says(said, raw)
        if done:
            break
    return log, bool(done)


def answer_similar(client: Client, system: str, prompt: str) -> str:
    """The learner's answer to the similar problem; a failed call is an answer too, and is judged."""
    try:
        return client.complete("answer", [_message("system", system), _message("user", prompt)], 0.2).strip()
    except CallFailed:
        return FAILED_ANSWER


def judged(reply: str | None, failure: str | None) -> tuple[bool, str]:
    """(correct, reason) of a judge's reply; a failed call, or a reply of another form, is not correct."""
    try:
        if reply is None:
            raise CallFailed(failure)
        verdict = json.loads(reply)
        return verdict["is_correct"], as_text(verdict["judge_reason"])
    except (CallFailed, ValueError, KeyError, TypeError) as error:
        return False, f"{FAILED_JUDGE}{error}"


def judge_answer(client: Client, system: str, prompt: str) -> tuple[bool, str]:
    try:
        return judged(client.complete("judge", [_message("system", system), _message("user", prompt)], 0.0, JUDGE_REPLY), None)
    except CallFailed as error:
        return judged(None, str(error))


@F.pandas_udf(StructType([StructField("phase2_is_correct", BooleanType()), StructField("judge_reason", StringType())]))
def verdicts(replies: pd.Series, failures: pd.Series) -> pd.DataFrame:
    """``judged`` for a column, in Arrow batches: what is wrong with a reply is said in Python's words."""
    none = lambda x: x if isinstance(x, str) else None
    rows = [judged(none(r), none(e)) for r, e in zip(replies, failures)]
    return pd.DataFrame({"phase2_is_correct": [bool(r[0]) for r in rows], "judge_reason": [r[1] for r in rows]})


def map_rows(df: DataFrame, added: StructType, run, in_flight: int = 8) -> DataFrame:
    """Adds the columns that ``run(row)`` returns for each row, in Arrow batches; a task has ``in_flight`` rows at work at a time."""
    schema = StructType([*df.schema.fields, *added.fields])
    kinds = to_arrow_schema(added)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                new = pa.Table.from_pylist(list(pool.map(run, batch.to_pylist())), schema=kinds).combine_chunks()
                columns = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in new.columns]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *kinds.names])

    return df.mapInArrow(batches_of, schema)


def simulate_corpus(df: DataFrame, client: Client, teacher_prompt: str, opening: str, teacher_opening: str, max_turns: int = MAX_TURNS, in_flight: int = 8) -> DataFrame:
    """Adds ``conversation`` and ``is_completed`` to rows with ``problem`` and ``student_prompt``."""
    def run(row: dict) -> dict:
        log, done = corpus_dialogue(client, row["problem"], row["student_prompt"], teacher_prompt, opening, teacher_opening, max_turns)
        return {"conversation": log, "is_completed": done}

    return map_rows(df, StructType([StructField("conversation", ArrayType(DIALOGUE_TURN)), StructField("is_completed", BooleanType())]), run, in_flight)


def simulate_evaluation(df: DataFrame, client: Client, max_turns: int = MAX_TURNS, in_flight: int = 8) -> DataFrame:
    """Phase 1: adds ``dialogue_log`` and ``phase1_is_completed`` to rows with the messages ``student`` and ``teacher``."""
    def run(row: dict) -> dict:
        log, done = evaluation_dialogue(client, row["student"], row["teacher"], max_turns)
        return {"dialogue_log": log, "phase1_is_completed": done}

    return map_rows(df, StructType([StructField("dialogue_log", MESSAGES), StructField("phase1_is_completed", BooleanType())]), run, in_flight)
