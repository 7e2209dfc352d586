"""Record schemas. They are always declared, never inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .fixed import EMOTIONS


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


RAW_PROBLEM = _strings("problem", "solution", "type", "level")
TRANSLATED_PROBLEM = _strings(
    "id", "type", "level", "original_problem", "thought_process", "translated_question", "original_solution", "translated_solution"
)
STUDENT_PROFILE = _strings("id", "grade", "learned_scope", "weak_area", "error_tendency")
SIMILAR_PROBLEM = _strings("source_id", "type", "level", "original_problem", "original_question", "similar_question", "similar_solution")
MESSAGE = _strings("role", "content")
MESSAGES = ArrayType(MESSAGE)
DIALOGUE_TURN = StructType(
    [StructField("turn", IntegerType()), *_strings("role", "content", "thought_process", "student_emotion", "roadmap_breakdown", "next_step_plan").fields]
)
DIALOGUE_SESSION = StructType(
    [
        StructField("problem", StringType()),
        StructField("student_profile", STUDENT_PROFILE),
        StructField("is_completed", BooleanType()),
        StructField("conversation", ArrayType(DIALOGUE_TURN)),
        StructField("source_id", StringType()),
    ]
)
TEACHER_RESPONSE = StructType(
    [
        *_strings("thought_process", "student_emotion", "roadmap_breakdown", "next_step_plan").fields,
        StructField("is_completed", BooleanType()),
        StructField("teacher_utterance", StringType()),
    ]
)
JUDGE_RESPONSE = StructType([StructField("is_correct", BooleanType()), StructField("judge_reason", StringType())])
EVAL_RESULT = StructType(
    [
        StructField("source_id", StringType()),
        StructField("student_profile_used", STUDENT_PROFILE),
        StructField("phase1_turns", IntegerType()),
        StructField("phase1_is_completed", BooleanType()),
        StructField("phase2_student_answer", StringType()),
        StructField("phase2_is_correct", BooleanType()),
        StructField("judge_reason", StringType()),
        StructField("dialogue_log", MESSAGES),
    ]
)
SFT_RECORD = StructType([StructField("messages", MESSAGES)])
SIMILAR_RESPONSE = _strings("similar_question", "similar_solution")


def strict_reply(name: str, fields: StructType, **choices: list[str]) -> dict:
    """What a client is told about a reply: an object with exactly these fields; some have a list of values."""
    kinds = {f.name: {"type": "boolean" if isinstance(f.dataType, BooleanType) else "string"} for f in fields}
    for field, values in choices.items():
        kinds[field]["enum"] = list(values)
    schema = {"type": "object", "properties": kinds, "required": fields.names, "additionalProperties": False}
    return {"type": "json_schema", "json_schema": {"name": name, "strict": True, "schema": schema}}


#: The names of the reply forms.
TEACHER_REPLY = strict_reply("teacher_response", TEACHER_RESPONSE, student_emotion=EMOTIONS)
SIMILAR_REPLY = strict_reply("similar_question_response", SIMILAR_RESPONSE)
JUDGE_REPLY = strict_reply("judge_response", JUDGE_RESPONSE)
