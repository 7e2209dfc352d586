"""Profiles, prompts, histories and chat records."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import (
    CHAT_ROLES,
    EVALUATION_PROFILE_LABELS,
    NO_FIELD,
    PROFILE_LABELS,
    REASONING_BEGIN,
    REASONING_END,
    REASONING_LABELS,
    SFT_PROBLEM_HEADER,
)


def profile_block(fields: dict[str, Column], evaluation: bool = False) -> Column:
    """A profile's labelled lines; missing fields show the default."""
    labels = EVALUATION_PROFILE_LABELS if evaluation else PROFILE_LABELS
    lines = [F.concat(F.lit(f"【{label}】: "), F.coalesce(fields.get(name, F.lit(None).cast("string")), F.lit(NO_FIELD))) for label, name in labels]
    return F.concat_ws("\n", *lines)


def fill_once(template: str, slots: dict[str, Column]) -> Column:
    """Fills a template's slots in one pass: text that is filled in is never searched for slots."""
    parts = re.split("(" + "|".join(map(re.escape, slots)) + ")", template)
    return F.concat(*[slots[p] if p in slots else F.lit(p) for p in parts])


def fill_in_turn(template: str, slots: dict[str, Column]) -> Column:
    """Fills slot after slot: a later slot is found in text that an earlier one brought."""
    out = F.lit(template)
    for slot, value in slots.items():
        out = F.replace(out, F.lit(slot), value)
    return out


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def reasoning_block(turn: Column) -> Column:
    """The reasoning before a tutor's words; missing fields are empty."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(turn[name], F.lit(""))) for label, name in REASONING_LABELS]
    return F.concat(F.concat_ws("\n", F.lit(REASONING_BEGIN), *lines, F.lit(REASONING_END)), F.lit("\n"))


def chat_messages(system_prompt: str, problem: Column, conversation: Column, reasoning: bool = True) -> Column:
    """A fine-tuning record: the system message, then the turns in order, in the roles of chats. Other roles are left out."""
    system = F.concat(F.lit(f"{system_prompt}\n\n{SFT_PROBLEM_HEADER}\n"), F.coalesce(problem, F.lit("")))
    known = F.filter(conversation, lambda t: t["role"].isin(list(CHAT_ROLES)))

    def said(turn: Column) -> Column:
        words = F.concat(reasoning_block(turn), turn["content"]) if reasoning else turn["content"]
        tutor = turn["role"] == "teacher"
        return message(F.when(tutor, CHAT_ROLES["teacher"]).otherwise(CHAT_ROLES["student"]), F.when(tutor, words).otherwise(turn["content"]))

    none = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(F.array(message("system", system)), F.coalesce(F.transform(known, said), none))


def history(log: Column) -> Column:
    """``role: content`` lines in the order of the log."""
    return F.array_join(F.transform(log, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")


def exchanges(log: Column) -> Column:
    """Pairs of turns; an unanswered last one does not count."""
    return F.floor(F.size(log) / 2).cast("int")
