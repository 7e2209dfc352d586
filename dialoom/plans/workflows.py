"""The three workflows: build a corpus, prepare fine-tuning records, evaluate a tutor.

Prompts, presets, paths and clients are parameters. Every step that calls a model is
written before it is used, so that no later action repeats its calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..fixed import (
    DIALOGUE_LIMIT,
    FAILED_ANSWER,
    MAX_TURNS,
    MODE_LEARNING,
    MODE_TRANSFER,
    NO_ID,
    PROBLEM_COLUMNS,
    SIMILAR_FORM,
    SLOT_CONDITION,
    SLOT_MODE,
    SLOT_PROBLEM,
    SLOT_PROFILE,
    TEST_ID,
    TEST_LIMIT,
    TEST_START,
    TRAIN_ID,
    TRAIN_LIMIT,
    TRANSLATE_FORM,
)
from ..functions import chat
from ..functions.text import first_filled, source_id, strict_reply, strip, tagged_blocks
from ..operators import assign, filters
from ..schemas import JUDGE_REPLY, SIMILAR_REPLY, SIMILAR_RESPONSE
from ..sources.progress import Progress
from ..sources.readers import path_exists
from ..sources.scratch import Scratch, remove
from ..sources.spread import Spread
from ..sources.writers import append_missing, first_successes, write_jsonl
from . import dialogue
from .client import Client, ReplayTable, ask, request_column

#: What the model is told; templates take the named fields. Two forms are fixed, the rest is our own wording.
WORDS = {
    "translate": f"Translate this problem and its solution.\n\n{TRANSLATE_FORM}",
    "similar": SIMILAR_FORM,
    "teacher_opening": "Problem: {problem}\n\nThe learner has been given this problem. Wait for what they say and answer it.",
    "student_opening": "Please begin with the problem.",
    "evaluation_opening": "[Problem]\n{problem}\n\nRead the problem and begin to think aloud.",
    "transfer": "[What was said before]\n{history}\n\n[New problem]\n{question}",
    "judge": "[The learner's answer]\n{answer}\n\n[Model solution]\n{solution}",
}


def _worded(name: str, **fields: Column) -> Column:
    return chat.fill_once(WORDS[name], {"{" + k + "}": v for k, v in fields.items()})


def failed_path(path: str) -> str:
    """Where the failed calls of the table at ``path`` are kept."""
    return f"{path.rstrip('/')}_failed"


def _messages(system: Column | str, prompt: Column) -> Column:
    return F.array(chat.message("system", F.lit(system) if isinstance(system, str) else system), chat.message("user", prompt))


def _dealt(client: Client | ReplayTable, spread: Spread) -> Spread | None:
    """Only calls are dealt over tasks; what is looked up in a table stays where it is."""
    return None if isinstance(client, ReplayTable) else spread


def request_of(task: str, system: str, prompt: Column) -> Column:
    """The key of the request that a workflow makes for a prompt, by which recorded replies are found."""
    return request_column(task, _messages(system, prompt))


def similar_prompt(question: Column, solution: Column) -> Column:
    return _worded("similar", question=question, solution=solution)


def _asked(
    rows: DataFrame,
    client: Client | ReplayTable,
    task: str,
    system: str,
    prompt: Column,
    temperature: float,
    path: str,
    spread: Spread,
    schema: dict | None = None,
    form: StructType | None = None,
) -> DataFrame:
    """Asks for a reply to each row's prompt, once: replies are written before they are used. Failed calls, and
    replies that are not of the ``form`` asked for, go to a table of their own (task, pos, prompt, error); a reply of the
    form is parsed once, to ``made``."""
    asked = ask(rows, client, task, _messages(system, prompt), temperature, schema, spread.plan(rows.sparkSession)[1])
    if form:
        asked = asked.withColumn("made", strict_reply(F.col("reply"), form))
    done = Scratch(rows.sparkSession, task).write(asked, "replies")
    if form:
        done = done.withColumn("error", F.coalesce("error", F.when(F.col("made").isNull(), "the reply is not of the form asked for")))
    failed = done.where("error is not null").select(F.lit(task).alias("task"), "pos", prompt.alias("prompt"), "error")
    failed.write.mode("append").parquet(failed_path(path))
    return done.where("error is null")


def translate(
    spark: SparkSession,
    problems: DataFrame,
    client: Client | ReplayTable,
    system: str,
    path: str,
    limit: int = TRAIN_LIMIT,
    start: int = 0,
    prefix: str = TRAIN_ID,
    spread: Spread | None = None,
    **options,
) -> DataFrame:
    """The first ``limit`` text-only problems from position ``start`` on whose translation succeeds.

    A reply without tags counts as a success with empty fields, as it does in the data
    this is meant for; such rows go when dialogues are made. Failed calls are kept at
    ``failed_path(path)``. ``options`` are those of ``first_successes``: ahead, resume, report."""
    spread = spread or Spread()
    if not options.get("resume") and path_exists(spark, failed_path(path)):
        remove(spark, failed_path(path))

    def run(rows: DataFrame) -> DataFrame:
        told = _worded("translate", problem=F.col("problem"), solution=F.col("solution"))
        done = _asked(rows, client, "translate", system, told, 0.3, path, spread)
        blocks = tagged_blocks(F.col("reply"))
        return done.select(
            "pos",
            source_id(prefix, F.col("pos")).alias("id"),
            "type",
            "level",
            F.col("problem").alias("original_problem"),
            blocks["thought_process"].alias("thought_process"),
            blocks["translated_question"].alias("translated_question"),
            F.col("solution").alias("original_solution"),
            blocks["translated_solution"].alias("translated_solution"),
        )

    return first_successes(spark, problems, filters.is_text_only(F.col("problem")), path, limit, run, start=start, spread=_dealt(client, spread), **options)


def translate_test(
    spark: SparkSession, problems: DataFrame, client: Client | ReplayTable, system: str, path: str, limit: int = TEST_LIMIT, spread: Spread | None = None, **options
) -> DataFrame:
    return translate(spark, problems, client, system, path, limit, TEST_START, TEST_ID, spread, **options)


def clean(records: DataFrame) -> DataFrame:
    """Records without references to figures, in either language."""
    return records.where(filters.is_text_only_record(PROBLEM_COLUMNS, records.columns))


def clean_to(records: DataFrame, path: str, progress: Progress | None = None) -> dict[str, int]:
    """Writes the records without references to figures as Parquet; returns how many were read, kept and removed, counted
    by the job that writes."""
    progress = progress or Progress(records.sparkSession)
    keep = filters.is_text_only_record(PROBLEM_COLUMNS, records.columns)
    seen = progress.watch(records.withColumn("_keep", keep), "clean", initial=F.count("*"), kept=F.count_if("_keep"))
    seen.where("_keep").drop("_keep").write.mode("overwrite").parquet(path)
    counts = progress.done("clean")
    return {**counts, "removed": counts["initial"] - counts["kept"]}


def dialogue_inputs(records: DataFrame, profiles: DataFrame, conditions: list[str], student_prompt: str, limit: int = DIALOGUE_LIMIT) -> DataFrame:
    """One row for each dialogue to make: problem, profile, prompt and id. Rows without a question use up a turn of the presets."""
    spark = records.sparkSession
    few = spark.createDataFrame([(k, c) for k, c in enumerate(conditions)], "ord long, text string")
    rows = assign.slice_rows(records, limit)
    rows = assign.round_robin(rows, profiles, prefix="profile_")
    rows = assign.round_robin(rows, few, prefix="condition_").where(filters.has_text(F.col("translated_question")))
    fields = [c for c in profiles.columns if c != "ord"]
    block = chat.profile_block({c: F.col(f"profile_{c}") for c in fields})
    prompt = chat.fill_once(student_prompt, {SLOT_PROBLEM: F.col("translated_question"), SLOT_PROFILE: block, SLOT_CONDITION: F.col("condition_text")})
    key = F.col("id") if "id" in records.columns else F.lit(None).cast("string")
    return rows.select(
        "pos",
        F.col("translated_question").alias("problem"),
        F.struct(*[F.col(f"profile_{c}").alias(c) for c in fields]).alias("student_profile"),
        prompt.alias("student_prompt"),
        F.coalesce(key, source_id(NO_ID, F.col("pos"))).alias("source_id"),
    )


def make_dialogues(spark: SparkSession, inputs: DataFrame, client: Client, teacher_prompt: str, path: str, max_turns: int = MAX_TURNS, wave: int = 64, spread: Spread | None = None) -> DataFrame:
    """Simulates the sessions that the table at ``path`` does not hold yet, and returns the table."""

    spread = spread or Spread()

    def run(rows: DataFrame) -> DataFrame:
        each = spread.plan(spark)[1]
        made = dialogue.simulate_corpus(rows, client, teacher_prompt, WORDS["student_opening"], WORDS["teacher_opening"], max_turns, each)
        return made.select("pos", "problem", "student_profile", "is_completed", "conversation", "source_id")

    return append_missing(spark, inputs, path, "source_id", run, wave, spread=spread)


def sft_records(sessions: DataFrame, system: str) -> DataFrame:
    """(pos, messages) of the completed sessions."""
    done = sessions.where(filters.is_completed(F.col("is_completed")))
    return done.select("pos", chat.chat_messages(system, F.col("problem"), F.col("conversation")).alias("messages"))


def prepare_sft(
    spark: SparkSession, sessions: DataFrame, system: str, train_path: str, val_path: str, exact: bool = False, progress: Progress | None = None
) -> dict[str, int]:
    """Writes the two files of fine-tuning records; returns their sizes, counted by the jobs that write.

    The order is that of salted digests, for corpora of any size. ``exact``: the permutation of the seeded generator,
    made on the driver, which refuses more than its bound."""
    progress = progress or Progress(spark)
    records = assign.renumber(sft_records(sessions, system), "pos", "n").drop("pos").withColumnRenamed("n", "pos")
    split = assign.seeded_split(spark, records) if exact else assign.hash_split(records, "pos")
    split = Scratch(spark, "sft").write(split.select("split", F.col("shuffled").alias("pos"), "messages"), "split")
    for name, path in (("train", train_path), ("val", val_path)):
        write_jsonl(split.where(F.col("split") == name).drop("split"), path, "pos", lambda d, step=name: progress.watch(d, step, n=F.count("*")))
    return {name: progress.done(name)["n"] for name in ("train", "val")}


def make_similar(
    spark: SparkSession, problems: DataFrame, client: Client | ReplayTable, system: str, path: str, wave: int = 64, spread: Spread | None = None
) -> DataFrame:
    """Look-alike problems; failed calls and questions that refer to a figure are left out. Failed calls are kept at
    ``failed_path(path)`` and are made again when this runs again."""
    question = first_filled(F.col("translated_question"), F.coalesce(F.col("original_problem"), F.lit("")))
    solution = first_filled(F.col("translated_solution"), F.coalesce(F.col("original_solution"), F.lit("")))
    rows = problems.select("pos", "id", "type", "level", "original_problem", question.alias("question"), solution.alias("solution"))
    spread = spread or Spread()
    def run(some: DataFrame) -> DataFrame:
        done = _asked(some, client, "similar", system, similar_prompt(F.col("question"), F.col("solution")), 0.5, path, spread, SIMILAR_REPLY, SIMILAR_RESPONSE)
        return done.select(
            "pos",
            F.col("id").alias("source_id"),
            "type",
            "level",
            F.coalesce("original_problem", F.lit("")).alias("original_problem"),
            F.col("question").alias("original_question"),
            F.coalesce("made.similar_question", F.lit("")).alias("similar_question"),
            F.coalesce("made.similar_solution", F.lit("")).alias("similar_solution"),
        ).where(filters.is_text_only(F.col("similar_question")))

    return append_missing(spark, rows.withColumn("source_id", F.col("id")), path, "source_id", lambda d: run(d.drop("source_id")), wave, spread=_dealt(client, spread))


def evaluation_inputs(originals: DataFrame, similar: DataFrame, profiles: DataFrame, student_prompt: str, teacher_prompt: str) -> DataFrame:
    """Pairs of original and similar problems with both sides' first messages. Pairs alone move the profiles on."""
    pairs = assign.pair(originals, similar)
    rows = assign.round_robin_matched(pairs, profiles, prefix="profile_")
    fields = [c for c in profiles.columns if c != "ord"]
    block = chat.profile_block({c: F.col(f"profile_{c}") for c in fields}, evaluation=True)
    system = lambda mode: chat.fill_in_turn(student_prompt, {SLOT_PROFILE: block, SLOT_MODE: F.lit(mode)})
    problem = F.col("translated_question")
    return rows.select(
        F.col("place").alias("pos"),
        F.col("key").alias("source_id"),
        F.struct(*[F.col(f"profile_{c}").alias(c) for c in fields]).alias("student_profile_used"),
        F.array(chat.message("system", system(MODE_LEARNING)), chat.message("user", _worded("evaluation_opening", problem=problem))).alias("student"),
        F.array(chat.message("system", F.lit(teacher_prompt)), chat.message("user", _worded("teacher_opening", problem=problem))).alias("teacher"),
        system(MODE_TRANSFER).alias("transfer_system"),
        F.col("other_similar_question").alias("similar_question"),
        F.col("other_similar_solution").alias("similar_solution"),
    )


def evaluate(
    spark: SparkSession,
    inputs: DataFrame,
    student: Client,
    teacher: Client,
    judge: Client | ReplayTable,
    judge_prompt: str,
    path: str,
    max_turns: int = MAX_TURNS,
    wave: int = 64,
    spread: Spread | None = None,
    answers: Client | ReplayTable | None = None,
) -> DataFrame:
    """Phase 1, phase 2 and the judge, each written before the next; returns the results' table at ``path``/results.

    ``answers`` answers the similar problems, by default the student."""
    spread, both = spread or Spread(), _Both(student, teacher)
    each = spread.plan(spark)[1]
    grow = lambda todo, name, run, by: append_missing(spark, todo, f"{path}/{name}", "source_id", run, wave, spread=_dealt(by, spread))
    first = grow(inputs, "phase1", lambda d: dialogue.simulate_evaluation(d, both, max_turns, each), both)
    told = first.withColumn("prompt", _worded("transfer", history=chat.history(F.col("dialogue_log")), question=F.col("similar_question")))

    def answer(rows: DataFrame) -> DataFrame:
        done = ask(rows, answers or student, "answer", _messages(F.col("transfer_system"), F.col("prompt")), 0.2, None, each)
        # a failed call is an answer too, and is judged
        return done.withColumn("phase2_student_answer", F.coalesce(strip(F.col("reply")), F.lit(FAILED_ANSWER))).drop("reply", "error")

    second = grow(told, "phase2", answer, answers or student)
    asked = second.withColumn("question", _worded("judge", answer=F.col("phase2_student_answer"), solution=F.col("similar_solution")))

    def grade(rows: DataFrame) -> DataFrame:
        done = ask(rows, judge, "judge", _messages(judge_prompt, F.col("question")), 0.0, JUDGE_REPLY, each)
        return done.withColumn("_v", dialogue.verdicts("reply", "error")).select(
            "pos",
            "source_id",
            "student_profile_used",
            chat.exchanges(F.col("dialogue_log")).alias("phase1_turns"),
            "phase1_is_completed",
            "phase2_student_answer",
            F.col("_v.phase2_is_correct").alias("phase2_is_correct"),
            F.col("_v.judge_reason").alias("judge_reason"),
            "dialogue_log",
        )

    return grow(asked, "results", grade, judge)


class _Both:
    """Sends a tutor's tasks to one client and all others to another."""

    def __init__(self, student: Client, teacher: Client) -> None:
        self.student, self.teacher = student, teacher

    def complete(self, task: str, messages, temperature: float = 0.0, schema=None) -> str:
        return (self.teacher if task == "teacher_free" else self.student).complete(task, messages, temperature, schema)
