"""Our own small presets for demonstrations: learner profiles, first states and prompts. Real runs pass their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..fixed import SLOT_CONDITION, SLOT_MODE, SLOT_PROBLEM, SLOT_PROFILE

PROFILES = [(k, f"P{k:02d}", f"grade {7 + k % 3}", f"chapters 1 to {k + 2}", f"topic {k % 4}" if k % 5 else None) for k in range(10)]
CONDITIONS = ["impatient at first", "a little lost", "ready to work"]
STUDENT_PROMPT = f"You are a learner.\n{SLOT_PROFILE}\nProblem: {SLOT_PROBLEM}\nYou are {SLOT_CONDITION}."
EVALUATION_PROMPT = f"You are a learner.\n{SLOT_PROFILE}\nNow: {SLOT_MODE}"
TEACHER_PROMPT = "You are a patient tutor. Never give the answer away."
TRANSLATOR_PROMPT = "You translate problems."
JUDGE_PROMPT = "You compare an answer with a model solution."
SFT_PROMPT = "You are a tutor."


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "ord long, id string, grade string, learned_scope string, weak_area string")
