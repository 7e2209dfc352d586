"""Text functions whose results match Python's string functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..fixed import TAG_ANSWER, TAG_QUESTION, TAG_THOUGHT


def strip(text: Column) -> Column:
    """Removes white space at both ends as Python does, beyond the space that ``trim`` knows."""
    return F.regexp_replace(text, "(?U)^[\\s\\x{1c}-\\x{1f}]+|[\\s\\x{1c}-\\x{1f}]+$", "")


def is_blank(text: Column) -> Column:
    """Whether ``strip`` would leave nothing; ends at the first other character."""
    return ~text.rlike("(?U)[^\\s\\x{1c}-\\x{1f}]")


def with_default(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def first_filled(a: Column, b: Column) -> Column:
    """``a`` unless it is null or empty."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def source_id(prefix: str, pos: Column) -> Column:
    """An id from the source position; make it before rows are filtered."""
    return F.concat(F.lit(prefix), pos.cast("string"))


def tagged_blocks(reply: Column) -> dict[str, Column]:
    """thought, question and answer of a reply: from the first tag to the next one; "" where a tag is missing.

    A tag inside the thought shifts the search, which starts at the text's begin."""
    q = re.escape
    whole = strip(reply)
    return {
        "thought_process": strip(F.regexp_extract(whole, f"(?s){q(TAG_THOUGHT)}(.*?){q(TAG_QUESTION)}", 1)),
        "translated_question": strip(F.regexp_extract(whole, f"(?s){q(TAG_QUESTION)}(.*?){q(TAG_ANSWER)}", 1)),
        "translated_solution": strip(F.regexp_extract(whole, f"(?s){q(TAG_ANSWER)}(.*)", 1)),
    }


def fixed_precision(number: Column, digits: int) -> Column:
    """A decimal text rounded from the exact binary value, half to even; null stays null."""
    return F.call_function("format_number", number, F.lit("0." + "0" * digits))


def strict_reply(reply: Column, schema: StructType) -> Column:
    """A structured reply as a struct; null if it is no JSON object, has text around it, or a field of another kind.

    Missing fields are null; a number counts as its text where a text is asked for."""
    marked = StructType([*schema.fields, StructField("_broken", StringType())])
    parsed = F.from_json(reply, marked, {"allowSingleQuotes": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    # the parser stops at the object's end, so text after it shows only where the reply is put inside an object and a list
    strict = {"allowSingleQuotes": "false"}
    inside = F.from_json(F.concat(F.lit('{"reply":'), reply, F.lit(',"end":true}')), StructType([StructField("end", BooleanType())]), strict)
    listed = F.from_json(F.concat(F.lit("["), reply, F.lit("]")), ArrayType(schema), strict)
    good = parsed["_broken"].isNull() & inside["end"] & (F.size(listed) == 1)
    return F.when(good, F.struct(*[parsed[f.name].alias(f.name) for f in schema.fields]))


LONE = re.compile("[\ud800-\udfff]")


def as_text(value: object) -> str | None:
    """A value of a parsed reply as text: lone surrogates, which no file can hold, become U+FFFD; what is no text becomes JSON."""
    if value is None:
        return None
    return LONE.sub("\ufffd", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def parse_embedded(reply: str) -> tuple[str, bool]:
    """(words, completed) of a reply that may hold one JSON object among other text.

    Without a brace, or where the part from the first to the last brace is no JSON,
    the reply itself is what was said. Raises what Python raises for JSON that is no
    object, which callers treat as a failed call."""
    begin = reply.find("{")
    if begin < 0:
        return reply, False
    try:
        value = json.loads(reply[begin : reply.rfind("}") + 1])
    except json.JSONDecodeError:
        return reply, False
    return value.get("teacher_utterance", ""), value.get("is_completed", False)


@F.pandas_udf(StructType([StructField("teacher_utterance", StringType()), StructField("is_completed", BooleanType())]))
def _by_python(replies: pd.Series) -> pd.DataFrame:
    """``parse_embedded`` for a column, in Arrow batches. Null gives null words and false."""
    rows = [parse_embedded(r) if isinstance(r, str) else (None, False) for r in replies]
    return pd.DataFrame({"teacher_utterance": [as_text(w) for w, _ in rows], "is_completed": [bool(d) for _, d in rows]})


def embedded_steps(reply: Column) -> tuple[Column, Column]:
    """(native, hard): what ``parse_embedded`` says of a reply, by the JVM's parser, and whether only Python can say it.

    Hard are replies whose part between braces the JVM refuses, since Python takes NaN and keys that occur twice; parts
    with a lone surrogate's escape; and values of a kind other than text and truth. The part is read as the only entry
    of a list, so nothing can follow the object; one that holds a bracket is also read as an object's field, since
    the JVM stops where a list ends. A reply without braces in order is never hard."""
    begin, after = F.instr(reply, F.lit("{")), F.length(reply) + 1 - F.instr(F.reverse(reply), F.lit("}"))
    has = (begin > 0) & F.contains(reply, F.lit("}")) & (after >= begin)
    part = F.substring(reply, begin, after - begin + 1)
    listed = F.try_parse_json(F.concat(F.lit("["), part, F.lit("]")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    inside = ~F.contains(part, F.lit("]")) | F.try_parse_json(F.concat(F.lit('{"reply":'), part, F.lit("}"))).isNotNull()
    said, done = (F.try_variant_get(listed, f"$[0].{name}", "variant") for name in ("teacher_utterance", "is_completed"))
    kind = lambda v, want: v.isNull() | (F.schema_of_variant(v) == want)
    plain = listed.isNotNull() & alone & inside & kind(said, "STRING") & kind(done, "BOOLEAN") & ~F.contains(F.lower(part), F.lit("\\ud"))
    words = F.when(has, F.coalesce(F.try_variant_get(listed, "$[0].teacher_utterance", "string"), F.lit(""))).otherwise(reply)
    flag = F.when(has, F.coalesce(F.try_variant_get(listed, "$[0].is_completed", "boolean"), F.lit(False))).otherwise(False)
    native = F.struct(words.alias("teacher_utterance"), flag.alias("is_completed"))
    # a brace that opens after the last one that closes: what is between is empty, no JSON, and the reply was said
    return native, F.coalesce(has & ~plain, F.lit(False))


def embedded_reply(reply: Column | str) -> Column:
    """``parse_embedded`` for a column as a struct (teacher_utterance, is_completed). The JVM parses; Python sees the text of
    the replies that only it can parse. Null gives null words and false."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    native, hard = embedded_steps(reply)
    return F.when(hard, _by_python(F.when(hard, reply))).otherwise(native)
