"""Corpus statistics and evaluation metrics. Counts are long, shares double; shares of nothing are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import EMOTION_GROUPS, NO_EMOTION
from ..functions.text import fixed_precision
from .filters import is_completed


def teacher_turns(conversation: str = "conversation") -> Column:
    return F.coalesce(F.size(F.filter(conversation, lambda t: t["role"] == "teacher")), F.lit(0)).cast("long")


def session_summary(sessions: DataFrame) -> DataFrame:
    """One row: sessions, completed, completion_rate, teacher_turns, mean_turns. One pass, one row a task shuffled."""
    turns = F.when(F.col("conversation").isNull(), 0).otherwise(teacher_turns()).cast("long")
    got = sessions.agg(
        F.count("*").alias("sessions"),
        F.count_if(is_completed(F.col("is_completed"))).alias("completed"),
        F.coalesce(F.sum(turns), F.lit(0)).cast("long").alias("teacher_turns"),
    )
    return got.select(
        "sessions",
        "completed",
        F.try_divide(F.col("completed") * F.lit(100.0), F.col("sessions")).cast("double").alias("completion_rate"),
        "teacher_turns",
        F.try_divide(F.col("teacher_turns").cast("double"), F.col("sessions")).alias("mean_turns"),
    )


def emotion_frequency(turns: DataFrame, session: str = "session_pos", place: str = "turn_pos", label: str = "student_emotion") -> DataFrame:
    """(emotion, n, share, rank): the most frequent first, ties in the order of first appearance.

    ``turns`` are teacher turns. The last window runs over the labels, which are few.
    """
    counted = turns.groupBy(F.coalesce(F.col(label), F.lit(NO_EMOTION)).alias("emotion")).agg(
        F.count("*").alias("n"), F.min(F.struct(session, place)).alias("first_seen")
    )
    every = Window.partitionBy()
    order = Window.orderBy(F.col("n").desc(), F.col("first_seen"))
    share = F.try_divide(F.col("n") * F.lit(100.0), F.sum("n").over(every)).cast("double")
    return counted.withColumn("share", share).withColumn("rank", F.row_number().over(order).cast("long")).select("emotion", "n", "share", "rank")


def emotion_group(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for group, labels in EMOTION_GROUPS.items():
        out = F.when(label.isin(labels), group).otherwise(out)
    return out


def emotion_transitions(turns: DataFrame, session: str = "session", place: str = "turn", label: str = "student_emotion") -> DataFrame:
    """(from_emotion, to_emotion, n, probability) over the consecutive teacher turns of each session."""
    after = Window.partitionBy(session).orderBy(place)
    steps = turns.select(F.col(label).alias("from_emotion"), F.lead(label).over(after).alias("to_emotion")).where("to_emotion is not null")
    counted = steps.groupBy("from_emotion", "to_emotion").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("from_emotion"))
    return counted.withColumn("probability", F.col("n") / total)


def sentence_count(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), "[。．.!?！？]+")
    return F.size(F.filter(parts, lambda p: F.regexp_replace(p, "\\s", "") != "")).cast("long")


def length_control(text: Column) -> Column:
    """``Pass`` for at most two sentences."""
    return F.when(sentence_count(text) <= 2, "Pass").otherwise("Fail")


def rubric_counts(judged: DataFrame, *axes: str) -> DataFrame:
    """(axis, category, n) of the rubric's columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("category")) for a in axes]))
    return judged.select(pairs.alias("p")).select("p.*").groupBy("axis", "category").agg(F.count("*").alias("n"))


def evaluation_rates(results: DataFrame, by: str = "model") -> DataFrame:
    """Retention and near transfer of each group."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return results.groupBy(by).agg(
        F.count("*").alias("n"), share("phase1_is_completed").alias("retention"), share("phase2_is_correct").alias("transfer")
    )


def compare_models(results: DataFrame, before: str, after: str, by: str = "model") -> DataFrame:
    """One row: both models' rates and what the second has gained."""
    rates = evaluation_rates(results, by).groupBy().pivot(by, [before, after]).agg(F.first("retention").alias("retention"), F.first("transfer").alias("transfer"))
    columns = [F.col(f"{m}_{k}").alias(f"{w}_{k}") for m, w in ((before, "before"), (after, "after")) for k in ("retention", "transfer")]
    return rates.select(*columns, *[(F.col(f"{after}_{k}") - F.col(f"{before}_{k}")).alias(f"{k}_gain") for k in ("retention", "transfer")])


def cleaning_counts(df: DataFrame, keep: Column) -> DataFrame:
    """One row: initial, kept, removed."""
    got = df.agg(F.count("*").alias("initial"), F.count_if(keep).alias("kept"))
    return got.withColumn("removed", F.col("initial") - F.col("kept"))


def report_text(summary: DataFrame, emotions: DataFrame) -> str:
    """The report for people; both tables are a few rows."""
    s = summary.select("sessions", fixed_precision(F.col("completion_rate"), 1).alias("rate"), fixed_precision(F.col("mean_turns"), 2).alias("mean")).first()
    lines = [f"sessions: {s.sessions}", f"completed: {s.rate or '-'} %", f"teacher turns a session: {s['mean'] or '-'}", "", "emotions:"]
    for r in emotions.orderBy("rank").select("emotion", "n", fixed_precision(F.col("share"), 1).alias("share")).collect():
        lines.append(f" - {r.emotion}: {r.n} ({r.share} %)")
    return "\n".join(lines)
