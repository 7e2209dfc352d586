"""Queries that show each operator on the test tables, and SQL that says the same.

The test tables hold no figure phrases, tags or dialogues with learner states. Each
query makes variants of their rows with one expression that Spark and the SQL share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..fixed import EMOTION_GROUPS, EMOTIONS, EVALUATION_PROFILE_LABELS, FAILED_ANSWER, FAILED_JUDGE, FIGURE_PATTERNS_EN, FIGURE_PATTERNS_JA, MODE_LEARNING, MODE_TRANSFER, NO_FIELD, PROBLEM_COLUMNS, PROFILE_LABELS, REASONING_BEGIN, REASONING_END, REASONING_LABELS, SFT_PROBLEM_HEADER
from ..functions import chat
from ..functions.text import embedded_reply, first_filled, fixed_precision, source_id, strict_reply, strip, tagged_blocks, with_default
from ..operators import assign, filters, metrics
from ..operators.positions import renumber
from ..schemas import SIMILAR_RESPONSE
from ..sources.readers import read_json_array, read_jsonl, read_keyed, read_problems
from ..sources.scratch import Scratch, fresh_path
from . import presets, workflows
from .client import LengthClient, ReplayTable, StubClient, made_reply

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- expressions that Spark and the SQL share -------------------------------

PROBLEM = """CASE doc_id % 9 WHEN 0 THEN concat(text, ' [asy] draw [/asy]') WHEN 1 THEN concat('As SHOWN in the', chr(10), 'Figure: ', text)
 WHEN 2 THEN concat(text, ' [ASY]') WHEN 3 THEN concat('Please REFER to the', chr(10), 'Diagram. ', text) WHEN 4 THEN concat(text, ' shown', chr(10), 'in the graph')
 WHEN 7 THEN concat('The base is shown. ', text) ELSE text END"""
#: Rows without a text, beside those of the table: ids from here on.
ADDED = 1_000_000_000
SQL_PROBLEMS = f"(SELECT doc_id, {PROBLEM} AS p FROM documents UNION ALL SELECT doc_id + {ADDED}, CASE doc_id % 9 WHEN 5 THEN '' END FROM documents WHERE doc_id % 9 IN (5, 6))"
FOUR = {
    "original_problem": "CASE doc_id % 11 WHEN 1 THEN concat(text, ' as') WHEN 7 THEN NULL WHEN 8 THEN '' ELSE text END",
    "translated_question": "CASE doc_id % 11 WHEN 2 THEN '図に示すように' WHEN 3 THEN concat('下の', chr(10), '図') WHEN 4 THEN 'グラフで示された' WHEN 5 THEN '斜線の図の領域' WHEN 6 THEN '普通の問題' ELSE '' END",
    "problem": "CASE doc_id % 11 WHEN 1 THEN 'it is shown' WHEN 7 THEN text WHEN 8 THEN text ELSE NULL END",
    "question": "CASE doc_id % 11 WHEN 8 THEN '   ' WHEN 9 THEN 'Graph SHOWN below' WHEN 10 THEN '[asy]' ELSE NULL END",
}
REPLY = """CASE doc_id % 6 WHEN 0 THEN concat('  [Thought Process] ', text, chr(10), '[Q]', chr(12288), 'q', chr(10), '[A] a ', text, '  ') WHEN 1 THEN text
 WHEN 2 THEN concat('[Q] only ', text) WHEN 3 THEN concat('[A] before [Q] ', text, ' [A] after') WHEN 4 THEN concat('[Thought Process] one [Q] two [A] three [Q] four [A] ', text)
 ELSE concat('[Thought Process] with [A] and [Q] inside ', text, '[Q] x [A]') END"""
EMOTION_LIST = "[" + ", ".join(f"'{e}'" for e in EMOTIONS) + "]"
SPARK_EMOTION = f"element_at(array({', '.join(repr(e) for e in EMOTIONS)}), cast((conv_id * 7 + turn * 3) % 10 + 1 as int))"
DUCK_EMOTION = f"{EMOTION_LIST}[(conv_id * 7 + turn * 3) % 10 + 1]"
THOUGHT = "CASE WHEN turn % 3 = 0 THEN NULL ELSE concat('thought ', cast(turn AS VARCHAR(10))) END"

SQL_STRIP = r"regexp_replace({}, '^[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '', 'g')"
SQL_TURNS = f"""turns AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'student' ELSE 'teacher' END AS role, text AS content,
 CASE WHEN role = 'assistant' THEN {DUCK_EMOTION} END AS student_emotion, CASE WHEN role = 'assistant' THEN {THOUGHT} END AS thought_process
 FROM conversations WHERE role IN ('user', 'assistant')),
sessions AS (SELECT conv_id, conv_id % 5 <> 0 AS is_completed FROM conversations GROUP BY conv_id)"""


def figure_sql(text: str, patterns: list[str]) -> str:
    return f"coalesce(contains({text}, '[asy]') OR contains({text}, '[/asy]') OR regexp_matches({text}, '(?:{'|'.join(patterns)})', 'is'), false)"


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text as a problem, and rows whose text is empty or null."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    added = docs.where((n % 9).isin(5, 6)).select((n + ADDED).alias("doc_id"), F.when(n % 9 == 5, "").alias("problem"))
    rows = docs.select("doc_id", F.expr(PROBLEM).alias("problem")).union(added)
    return rows.select(F.col("doc_id").alias("pos"), "doc_id", "problem")


def _turn_columns() -> dict:
    tutor = F.col("role") == "assistant"
    return {
        "turn": F.col("turn"),
        "role": F.when(tutor, "teacher").otherwise("student"),
        "content": F.col("text"),
        "student_emotion": F.when(tutor, F.expr(SPARK_EMOTION)),
        "thought_process": F.when(tutor, F.expr(THOUGHT)),
    }


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as learner's and tutor's turns; system messages go."""
    rows = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    return rows.select("conv_id", *[c.alias(n) for n, c in _turn_columns().items()])


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their turns in order, by one shuffle; a session without such turns has an empty list."""
    turn = _turn_columns()
    full = F.struct(
        turn["turn"].cast("int").alias("turn"),
        *[turn[n].alias(n) for n in ("role", "content", "thought_process", "student_emotion")],
        F.lit(None).cast("string").alias("roadmap_breakdown"),
        F.concat(F.lit("plan "), turn["turn"].cast("string")).alias("next_step_plan"),
    )
    said = F.array_sort(F.collect_list(F.when(F.col("role").isin("user", "assistant"), full)))
    n = F.col("conv_id")
    got = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("conversation"))
    return got.select("conv_id", n.alias("pos"), F.concat(F.lit("problem "), n.cast("string")).alias("problem"), (n % 5 != 0).alias("is_completed"), "conversation")


# --- sources and sinks ------------------------------------------------------

DOCUMENT = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())])


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, md5(text) AS digest, lang FROM (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang FROM documents)")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.writers import write_jsonl

    path = fresh_path(spark, "jsonl")
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").alias("pos"), "doc_id", "text", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"))
    write_jsonl(docs, path, "pos")
    return read_jsonl(spark, path, DOCUMENT).select("pos", "doc_id", F.md5("text").alias("digest"), "lang")


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS ord, item_id, md5(text) AS digest FROM benchmark")
def json_array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.writers import write_json_array

    path = f"{fresh_path(spark, 'array')}/items.json"
    write_json_array(table(spark, sf_dir, "benchmark").select("item_id", "text", F.col("item_id").alias("o")), path, "o")
    schema = StructType([StructField("item_id", LongType()), StructField("text", StringType())])
    return read_json_array(spark, path, schema).select("ord", "item_id", F.md5("text").alias("digest"))


@query("SELECT doc_id AS pos, md5(text) AS problem, '' AS solution, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE source END AS type, coalesce(lang, 'unknown') AS level FROM documents")
def problems_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A problem corpus in JSON lines, read with positions and the defaults of null fields."""
    from ..sources.writers import write_jsonl

    path, n = fresh_path(spark, "problems"), F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(n.alias("pos"), F.col("text").alias("problem"), F.lit(None).cast("string").alias("solution"), F.when(n % 3 != 0, F.col("source")).alias("type"), F.col("lang").alias("level"))
    write_jsonl(rows, path, "pos")
    got = read_problems(spark, path)
    return got.select("pos", F.md5("problem").alias("problem"), "solution", "type", "level")


@query("""SELECT key, min(doc_id) AS place, arg_max(lang, doc_id) AS grade, arg_max(source, doc_id) AS weak_area FROM (SELECT *, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat('id', doc_id % 50) END, ''),
 concat('src', doc_id % 50)) AS key FROM documents) GROUP BY key""")
def keyed_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in JSON lines by id, else source id: the last one's values at the first one's place."""
    from ..sources.writers import write_jsonl

    path, n = fresh_path(spark, "keyed"), F.col("doc_id")
    name = F.when(n % 2 == 0, "").otherwise(F.concat(F.lit("id"), n % 50))
    rows = table(spark, sf_dir, "documents").select(n.alias("pos"), name.alias("id"), F.concat(F.lit("src"), n % 50).alias("source_id"), F.col("lang").alias("grade"), F.col("source").alias("weak_area"))
    write_jsonl(rows, path, "pos")
    kinds = StructType([StructField(c, StringType()) for c in ("id", "source_id", "grade", "weak_area")])
    return read_keyed(spark, path, kinds).select("key", "place", "grade", "weak_area")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 2) THEN md5(text) END AS question, CASE WHEN doc_id % 5 = 0 THEN source END AS solution, doc_id % 5 IN (0, 2) AS accepted FROM documents""")
def strict_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured replies: whole, no object, without a field, with words after the object, and none."""
    n, question = F.col("doc_id"), F.col("text").alias("similar_question")
    whole = F.to_json(F.struct(question, F.col("source").alias("similar_solution")))
    reply = F.when(n % 5 == 0, whole).when(n % 5 == 1, F.concat(F.lit("no object: "), F.col("text"))).when(n % 5 == 2, F.to_json(F.struct(question))).when(n % 5 == 3, F.concat(whole, F.lit(" words")))
    got = table(spark, sf_dir, "documents").select("doc_id", strict_reply(reply, SIMILAR_RESPONSE).alias("r"))
    return got.select("doc_id", F.md5("r.similar_question").alias("question"), F.col("r.similar_solution").alias("solution"), F.col("r").isNotNull().alias("accepted"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE text <> '') AS filled FROM documents")
def source_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("text") != "").alias("filled"))


@query("""SELECT key, min(doc_id) AS place, max(doc_id) AS doc_id, CAST(arg_max(n_chars, doc_id) AS BIGINT) AS n_chars
FROM (SELECT *, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat('id', doc_id % 50) END, ''), concat('src', doc_id % 50)) AS key FROM documents) GROUP BY key""")
def keyed_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"),
        "doc_id",
        "n_chars",
        F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("id"), F.col("doc_id") % 50)).alias("id"),
        F.concat(F.lit("src"), F.col("doc_id") % 50).alias("source_id"),
    )
    return assign.last_wins(docs, assign.record_key()).select("key", "place", "doc_id", "n_chars")


# --- projections ------------------------------------------------------------


@query("""SELECT doc_id, coalesce(lang, 'unknown') AS level, coalesce(nullif(a, ''), b) AS question, concat('math_train_', doc_id) AS id,
 coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, concat('unknown_', doc_id)) AS source_id
FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE source END AS a, lang AS b FROM documents)""")
def record_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    a = F.when(n % 3 == 0, "").when(n % 3 == 2, F.col("source"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        with_default(F.when(n % 3 != 0, F.col("lang")), "unknown").alias("level"),
        first_filled(a, F.col("lang")).alias("question"),
        source_id("math_train_", n).alias("id"),
        F.coalesce(F.when(n % 2 == 0, F.col("source")), source_id("unknown_", n)).alias("source_id"),
    )


@query(f"""WITH r AS (SELECT doc_id, {SQL_STRIP.format(f"({REPLY})")} AS r FROM documents)
SELECT doc_id, {SQL_STRIP.format(r"regexp_extract(r, '\[Thought Process\](.*?)\[Q\]', 1, 's')")} AS thought_process,
 {SQL_STRIP.format(r"regexp_extract(r, '\[Q\](.*?)\[A\]', 1, 's')")} AS translated_question, {SQL_STRIP.format(r"regexp_extract(r, '\[A\](.*)', 1, 's')")} AS translated_solution FROM r""")
def tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark's chr covers Latin-1 only
    reply = F.expr(REPLY.replace("chr(12288)", "'　'"))
    blocks = tagged_blocks(F.col("reply"))
    return table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply")).select("doc_id", *[c.alias(n) for n, c in blocks.items()])


@query(f"SELECT doc_id, {SQL_STRIP.format('concat(chr(12288), chr(10), text, chr(9), chr(160), chr(8232))')} AS text FROM documents")
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("　\n"), F.col("text"), F.lit("\t  "))
    return table(spark, sf_dir, "documents").select("doc_id", strip(padded).alias("text"))


@query("SELECT doc_id, format('{:.1f}', n_chars / 16.0::DOUBLE) AS one, format('{:.2f}', n_chars / 8.0::DOUBLE) AS two FROM documents")
def fixed_precision_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("double")
    return table(spark, sf_dir, "documents").select("doc_id", fixed_precision(n / 16, 1).alias("one"), fixed_precision(n / 8, 2).alias("two"))


@query(r"""WITH r AS (SELECT doc_id, text, doc_id % 5 AS k, CASE doc_id % 5 WHEN 2 THEN '{broken ' || text WHEN 3 THEN text || ' {"is_completed": true, "x": NaN}' ELSE text END AS reply FROM documents),
p AS (SELECT *, k IN (0, 1) AS whole, k = 3 AND NOT contains(text, '{') AS tail, regexp_extract(reply, '(?s)\{.*\}') AS part FROM r),
v AS (SELECT *, NOT whole AND NOT coalesce(tail, false) AND coalesce(json_valid(part), false) AS valid FROM p)
SELECT doc_id, CASE WHEN whole THEN coalesce(text, '') WHEN tail THEN '' WHEN valid THEN coalesce(json_extract_string(part, '$.teacher_utterance'), '') ELSE reply END AS teacher_utterance,
 CASE WHEN whole THEN doc_id % 2 = 0 WHEN tail THEN true WHEN valid THEN coalesce(json_extract_string(part, '$.is_completed') = 'true', false) ELSE false END AS is_completed FROM v""")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with an object among other text, broken objects and none; Python's parser decides on whole texts."""
    good = F.to_json(F.struct(F.col("text").alias("teacher_utterance"), (F.col("doc_id") % 2 == 0).alias("is_completed")))
    reply = (
        F.when(F.col("doc_id") % 5 == 0, good)
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("So: "), good, F.lit(" done.")))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("{broken "), F.col("text")))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.col("text"), F.lit(' {"is_completed": true, "x": NaN}')))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", embedded_reply(reply).alias("r")).select("doc_id", "r.*")


def _profile_sql(labels: list[tuple[str, str]]) -> str:
    return ", chr(10), ".join(f"'【{label}】: ', {value}" for label, value in labels)


@query(f"""SELECT doc_id, concat('You are a learner.', chr(10), {_profile_sql([("学年", "source"), ("学習済みの範囲", "lang"), ("ミスしやすい点", "'不明'"), ("苦手な範囲", "CASE WHEN doc_id % 2 = 0 THEN source ELSE '不明' END")])},
 chr(10), 'Problem: ', concat('{{STUDENT_PROFILE}} ', lang), chr(10), 'You are ', source, '.') AS prompt FROM documents""")
def student_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot's name inside text that was filled in stays as it is."""
    fields = {"grade": F.col("source"), "learned_scope": F.col("lang"), "weak_area": F.when(F.col("doc_id") % 2 == 0, F.col("source"))}
    slots = {"{STUDENT_PROFILE}": chat.profile_block(fields), "{TARGET_PROBLEM}": F.concat(F.lit("{STUDENT_PROFILE} "), F.col("lang")), "{INITIAL_CONDITION}": F.col("source")}
    return table(spark, sf_dir, "documents").select("doc_id", chat.fill_once(presets.STUDENT_PROMPT, slots).alias("prompt"))


@query(f"""SELECT doc_id, replace(replace(concat('You are a learner.', chr(10), '{{STUDENT_PROFILE}}', chr(10), 'Now: {{CURRENT_MODE}}'), '{{STUDENT_PROFILE}}',
 concat({_profile_sql([("学年", "source"), ("学習済みの範囲", "'{CURRENT_MODE}'"), ("苦手な範囲", "lang")])})), '{{CURRENT_MODE}}', source) AS prompt FROM documents""")
def evaluation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later slot is found in text that an earlier one brought."""
    fields = {"grade": F.col("source"), "learned_scope": F.lit("{CURRENT_MODE}"), "weak_area": F.col("lang")}
    slots = {"{STUDENT_PROFILE}": chat.profile_block(fields, evaluation=True), "{CURRENT_MODE}": F.col("source")}
    return table(spark, sf_dir, "documents").select("doc_id", chat.fill_in_turn(presets.EVALUATION_PROMPT, slots).alias("prompt"))


# --- filters ----------------------------------------------------------------


@query(f"SELECT doc_id, CAST(length(p) AS BIGINT) AS n FROM {SQL_PROBLEMS} WHERE NOT {figure_sql('p', FIGURE_PATTERNS_EN)}")
def filter_text_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problems(spark, sf_dir).where(filters.is_text_only(F.col("problem"))).select("doc_id", F.length("problem").cast("long").alias("n"))


SQL_FOUR = f"""SELECT doc_id, (regexp_full_match(j, '\\s*') OR NOT {figure_sql('j', FIGURE_PATTERNS_JA + FIGURE_PATTERNS_EN)}) AS keep
FROM (SELECT doc_id, concat({', chr(10), '.join(f"coalesce({FOUR[c]}, '')" for c in PROBLEM_COLUMNS)}) AS j FROM documents)"""


def _four(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[F.expr(FOUR[c]).alias(c) for c in PROBLEM_COLUMNS])


@query(f"SELECT doc_id FROM ({SQL_FOUR}) WHERE keep")
def filter_bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.clean(_four(spark, sf_dir)).select("doc_id")


@query(f"SELECT count(*) AS initial, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS removed FROM ({SQL_FOUR})")
def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cleaning_counts(_four(spark, sf_dir), filters.is_text_only_record(PROBLEM_COLUMNS))


@query(f"SELECT count(*) AS initial, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS removed, (SELECT count(*) FROM ({SQL_FOUR}) WHERE keep) AS written FROM ({SQL_FOUR})")
def clean_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned records written, with the counts of the job that wrote them beside the rows that the table holds."""
    path = fresh_path(spark, "clean")
    counts = workflows.clean_to(_four(spark, sf_dir), path)
    kept = spark.read.parquet(path).agg(F.count("*").alias("written"))
    return kept.select(*[F.lit(counts[c]).cast("long").alias(c) for c in ("initial", "kept", "removed")], "written")


@query(f"SELECT conv_id, turn, label, coalesce(label IN ({EMOTION_LIST[1:-1]}), false) AS known FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN {DUCK_EMOTION} WHEN 1 THEN 'Deep_Confusion' WHEN 2 THEN NULL ELSE 'engaged' END AS label FROM conversations)")
def known_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn") % 4
    label = F.when(t == 0, F.expr(SPARK_EMOTION)).when(t == 1, "Deep_Confusion").when(t == 3, "engaged")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", label.alias("label")).withColumn("known", filters.is_known_emotion(F.col("label")))


# --- selection and pairing --------------------------------------------------


def _first_sql(start: int, limit: int, prefix: str) -> str:
    return f"""SELECT concat('{prefix}', doc_id) AS id, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r
FROM {SQL_PROBLEMS} WHERE doc_id >= {start} AND NOT {figure_sql('p', FIGURE_PATTERNS_EN)}) WHERE r <= {limit}"""


def _first(spark: SparkSession, sf_dir: str, start: int, limit: int, prefix: str) -> DataFrame:
    named = problems(spark, sf_dir).withColumn("id", source_id(prefix, F.col("pos")))
    return assign.first_passing(named, filters.is_text_only(F.col("problem")), limit, start=start).select("id", "doc_id")


@query(_first_sql(0, 200, "math_train_"))
def first_n_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir, 0, 200, "math_train_")


@query(_first_sql(200, 40, "math_test_"))
def offset_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir, 200, 40, "math_test_")


#: Every item's whole text, and beside it rows without one: half as many, each place behind its item's.
SQL_ITEMS = "(SELECT 2 * item_id AS item_id, text AS q FROM benchmark UNION ALL SELECT 2 * item_id + 1, CASE item_id % 4 WHEN 0 THEN '' END FROM benchmark WHERE item_id % 4 IN (0, 1))"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = table(spark, sf_dir, "benchmark"), F.col("item_id")
    added = rows.where((n % 4).isin(0, 1)).select((2 * n + 1).alias("item_id"), F.when(n % 4 == 0, "").alias("q"))
    return rows.select((2 * n).alias("item_id"), F.col("text").alias("q")).union(added)


@query(f"SELECT item_id, md5(q) AS digest FROM {SQL_ITEMS} WHERE item_id < 30 AND coalesce(q, '') <> ''")
def slice_then_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("pos", F.col("item_id"))
    return assign.slice_rows(rows, 30).where(filters.has_text(F.col("q"))).select("item_id", F.md5("q").alias("digest"))


SQL_CONDITIONS = "[" + ", ".join(f"'{c}'" for c in presets.CONDITIONS) + "]"


@query(f"""SELECT item_id, concat('P0', item_id % 10) AS profile, {SQL_CONDITIONS}[item_id % 3 + 1] AS condition FROM {SQL_ITEMS} WHERE coalesce(q, '') <> ''""")
def profile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("pos", F.col("item_id"))
    few = spark.createDataFrame([(k, c) for k, c in enumerate(presets.CONDITIONS)], "ord long, text string")
    rows = assign.round_robin(rows, presets.profiles(spark), prefix="profile_")
    rows = assign.round_robin(rows, few, prefix="condition_").where(filters.has_text(F.col("q")))
    return rows.select("item_id", F.col("profile_id").alias("profile"), F.col("condition_text").alias("condition"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents take part; each third one has a key that no original has, which the SQL's condition says too."""
    n = F.col("doc_id")
    originals = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.col("item_id").alias("place"), F.length("text").cast("long").alias("n"))
    similar = table(spark, sf_dir, "documents").select(F.when(n % 3 != 0, n).otherwise(-1 - n).alias("key"), "source", "lang")
    return assign.pair(originals, similar)


SQL_PAIRS = "SELECT item_id AS key, CAST(length(b.text) AS BIGINT) AS n, d.source, d.lang FROM benchmark b JOIN documents d ON d.doc_id = b.item_id WHERE d.doc_id % 3 <> 0"


@query(SQL_PAIRS)
def pair_original_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("key", "n", F.col("other_source").alias("source"), F.col("other_lang").alias("lang"))


@query(f"SELECT key, concat('P0', (row_number() OVER (ORDER BY key) - 1) % 10) AS profile FROM ({SQL_PAIRS})")
def profile_assign_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.round_robin_matched(_pairs(spark, sf_dir), presets.profiles(spark)).select("key", F.col("preset_id").alias("profile"))


@query(f"""WITH keep AS (SELECT doc_id, p FROM {SQL_PROBLEMS} WHERE NOT {figure_sql('p', FIGURE_PATTERNS_EN)}),
train AS (SELECT p FROM (SELECT p, row_number() OVER (ORDER BY doc_id) AS r FROM keep) WHERE r <= 200), test AS (SELECT p FROM (SELECT p, row_number() OVER (ORDER BY doc_id) AS r FROM keep WHERE doc_id >= 200) WHERE r <= 40)
SELECT md5(p) AS digest FROM (SELECT p FROM train INTERSECT SELECT p FROM test)""")
def pool_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep, rows = filters.is_text_only(F.col("problem")), problems(spark, sf_dir)
    both = assign.pool_overlap(assign.first_passing(rows, keep, 200), assign.first_passing(rows, keep, 40, start=200), "problem")
    return both.select(F.md5("problem").alias("digest"))


# --- statistics -------------------------------------------------------------

SQL_SUMMARY = f"""WITH {SQL_TURNS}, s AS (SELECT count(*) AS sessions, count(*) FILTER (WHERE is_completed) AS completed FROM sessions),
t AS (SELECT count(*) AS teacher_turns FROM turns WHERE role = 'teacher')"""


@query(f"{SQL_SUMMARY} SELECT sessions, completed, completed * 100.0::DOUBLE / sessions AS completion_rate FROM s")
def session_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.session_summary(sessions(spark, sf_dir)).select("sessions", "completed", "completion_rate")


@query(f"{SQL_SUMMARY} SELECT sessions, teacher_turns, teacher_turns::DOUBLE / sessions AS mean_turns FROM s, t")
def mean_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.session_summary(sessions(spark, sf_dir)).select("sessions", "teacher_turns", "mean_turns")


LABEL = "CASE WHEN turn % 6 = 0 THEN NULL ELSE student_emotion END"


@query(f"""WITH {SQL_TURNS}, c AS (SELECT coalesce({LABEL}, 'Unknown') AS emotion, count(*) AS n, min((conv_id, turn)) AS seen FROM turns WHERE role = 'teacher' GROUP BY 1)
SELECT emotion, n, n * 100.0::DOUBLE / CAST(sum(n) OVER () AS BIGINT) AS share, row_number() OVER (ORDER BY n DESC, seen) AS rank FROM c""")
def emotion_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).where("role = 'teacher'").withColumn("student_emotion", F.expr(LABEL))
    return metrics.emotion_frequency(rows, "conv_id", "turn")


@query(f"""WITH {SQL_TURNS}, x AS (SELECT student_emotion AS from_emotion, lead(student_emotion) OVER (PARTITION BY conv_id ORDER BY turn) AS to_emotion FROM turns WHERE role = 'teacher'),
c AS (SELECT from_emotion, to_emotion, count(*) AS n FROM x WHERE to_emotion IS NOT NULL GROUP BY 1, 2)
SELECT from_emotion, to_emotion, n, n::DOUBLE / CAST(sum(n) OVER (PARTITION BY from_emotion) AS BIGINT) AS probability FROM c""")
def emotion_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.emotion_transitions(turns(spark, sf_dir).where("role = 'teacher'"), "conv_id", "turn")


def _group_case() -> str:
    return "CASE " + " ".join(f"WHEN student_emotion IN ({', '.join(repr(e) for e in v)}) THEN '{g}'" for g, v in EMOTION_GROUPS.items()) + " END"


@query(f"WITH {SQL_TURNS} SELECT {_group_case()} AS emotion_group, count(*) AS n FROM turns WHERE role = 'teacher' GROUP BY 1")
def emotion_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).where("role = 'teacher'")
    return rows.groupBy(metrics.emotion_group(F.col("student_emotion")).alias("emotion_group")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, n AS sentences, CASE WHEN n <= 2 THEN 'Pass' ELSE 'Fail' END AS length_control FROM (SELECT conv_id, turn,
 CAST(len(list_filter(regexp_split_to_array(text, '[。．.!?！？]+'), lambda p: regexp_replace(p, '\\s', '', 'g') <> '')) AS BIGINT) AS n FROM conversations WHERE role = 'assistant')""")
def length_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", metrics.sentence_count(F.col("text")).alias("sentences"), metrics.length_control(F.col("text")).alias("length_control"))


@query(f"""WITH {SQL_TURNS}, j AS (SELECT CASE WHEN (conv_id + turn) % 3 = 0 THEN 'Bad' ELSE 'Good' END AS a, ['Excellent', 'Acceptable', 'Reject'][(conv_id + turn) % 3 + 1] AS b, CASE WHEN len(content) <= 200 THEN 'Pass' ELSE 'Fail' END AS c FROM turns WHERE role = 'teacher')
SELECT 'emotion_alignment' AS axis, a AS category, count(*) AS n FROM j GROUP BY a UNION ALL SELECT 'pedagogical_empathy', b, count(*) FROM j GROUP BY b UNION ALL SELECT 'length_control', c, count(*) FROM j GROUP BY c""")
def rubric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 3
    judged = turns(spark, sf_dir).where("role = 'teacher'").select(
        F.when(k == 0, "Bad").otherwise("Good").alias("emotion_alignment"),
        F.when(k == 0, "Excellent").when(k == 1, "Acceptable").otherwise("Reject").alias("pedagogical_empathy"),
        F.when(F.length("content") <= 200, "Pass").otherwise("Fail").alias("length_control"),
    )
    return metrics.rubric_counts(judged, *judged.columns)


SQL_RESULTS = "results AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS model, conv_id % 5 <> 0 AS phase1_is_completed, conv_id % 3 = 0 AS phase2_is_correct FROM conversations)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        F.when(n % 2 == 0, "base").otherwise("tuned").alias("model"), (n % 5 != 0).alias("phase1_is_completed"), (n % 3 == 0).alias("phase2_is_correct")
    )


@query(f"WITH {SQL_RESULTS} SELECT model, count(*) AS n, avg(phase1_is_completed::INT) AS retention, avg(phase2_is_correct::INT) AS transfer FROM results GROUP BY model")
def retention_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluation_rates(_results(spark, sf_dir))


@query(f"""WITH {SQL_RESULTS}, r AS (SELECT avg(phase1_is_completed::INT) FILTER (WHERE model = 'base') AS a, avg(phase2_is_correct::INT) FILTER (WHERE model = 'base') AS b,
 avg(phase1_is_completed::INT) FILTER (WHERE model = 'tuned') AS c, avg(phase2_is_correct::INT) FILTER (WHERE model = 'tuned') AS d FROM results)
SELECT a AS before_retention, b AS before_transfer, c AS after_retention, d AS after_transfer, c - a AS retention_gain, d - b AS transfer_gain FROM r""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compare_models(_results(spark, sf_dir), "base", "tuned")


# --- chat records -----------------------------------------------------------

_REASON = {"thought_process": "coalesce(thought_process, '')", "student_emotion": "student_emotion", "roadmap_breakdown": "''", "next_step_plan": "concat('plan ', turn)"}
SQL_SAID = f"concat('{REASONING_BEGIN}', chr(10), " + ", chr(10), ".join(f"'{label}: ', {_REASON[name]}" for label, name in REASONING_LABELS) + f", chr(10), '{REASONING_END}', chr(10), content)"
SQL_SYSTEM = f"concat('{presets.SFT_PROMPT}', chr(10), chr(10), '{SFT_PROBLEM_HEADER}', chr(10), 'problem ', s.conv_id)"


@query(f"""WITH {SQL_TURNS}, m AS (SELECT conv_id, -1 AS turn, 'system' AS role, {SQL_SYSTEM} AS content FROM sessions s WHERE is_completed
UNION ALL SELECT conv_id, turn, CASE role WHEN 'student' THEN 'user' ELSE 'assistant' END, CASE role WHEN 'student' THEN content ELSE {SQL_SAID} END FROM turns WHERE conv_id % 5 <> 0)
SELECT conv_id, CAST(to_json(list({{'role': role, 'content': content}} ORDER BY turn)) AS VARCHAR) AS messages FROM m GROUP BY conv_id""")
def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = workflows.sft_records(sessions(spark, sf_dir), presets.SFT_PROMPT)
    return records.select(F.col("pos").alias("conv_id"), F.to_json("messages").alias("messages"))


@query("""WITH k AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 <> 0), o AS (SELECT conv_id, row_number() OVER (ORDER BY md5(concat('42:', conv_id)), conv_id) - 1 AS shuffled, count(*) OVER () AS n FROM k)
SELECT conv_id, shuffled, CASE WHEN shuffled < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM o""")
def sft_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sessions(spark, sf_dir).where(filters.is_completed(F.col("is_completed"))).select("conv_id")
    return assign.hash_split(done, "conv_id").select("conv_id", "shuffled", "split")


@query("""WITH k AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 <> 0), n AS (SELECT count(*) AS n FROM k)
SELECT 'train' AS split, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS n FROM n UNION ALL SELECT 'val', n - CAST(floor(n * 0.8::DOUBLE) AS BIGINT) FROM n""")
def sft_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sessions(spark, sf_dir).where(filters.is_completed(F.col("is_completed"))).select("conv_id")
    return assign.split_sizes(done)


@query()
def sft_seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permutation of a seeded generator; tests hold it against Python's own shuffle."""
    done = sessions(spark, sf_dir).where(filters.is_completed(F.col("is_completed"))).select("conv_id")
    return assign.seeded_split(spark, renumber(done, "conv_id", "pos")).select("conv_id", "pos", "shuffled", "split")


@query(f"WITH {SQL_TURNS} SELECT conv_id, string_agg(concat(role, ': ', content), chr(10) ORDER BY turn) AS history, CAST(count(*) // 2 AS BIGINT) AS exchanges FROM turns GROUP BY conv_id")
def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = sessions(spark, sf_dir).where("size(conversation) > 0")
    return log.select("conv_id", chat.history(F.col("conversation")).alias("history"), chat.exchanges(F.col("conversation")).cast("long").alias("exchanges"))


# --- model calls, with the stub client --------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    return rows.select(F.col("item_id").alias("pos"), source_id("math_test_", F.col("item_id")).alias("id"), F.col("q").alias("translated_question"))


def _said(name: str, *fields: str) -> int:
    """Characters of a template without its fields."""
    return len(workflows.WORDS[name]) - sum(len(f) + 2 for f in fields)


SQL_TRANSLATED = f"""SELECT pos, concat('math_train_', pos) AS id, concat('step ', n % 7) AS thought_process, concat('question ', n % 1000) AS translated_question, concat('answer ', n % 100) AS translated_solution
FROM (SELECT pos, n, row_number() OVER (ORDER BY pos) AS r FROM (SELECT doc_id AS pos, {len(presets.TRANSLATOR_PROMPT) + _said("translate", "problem", "solution") + 1} + length(p) AS n
 FROM (SELECT doc_id, coalesce(p, '') AS p FROM {SQL_PROBLEMS}) WHERE NOT {figure_sql('p', FIGURE_PATTERNS_EN)}) WHERE n % 7 <> 0) WHERE r <= 200"""


@query(SQL_TRANSLATED)
def translate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 translations that succeed; calls fail where the number of characters is divisible by seven."""
    rows = problems(spark, sf_dir).select("pos", F.coalesce("problem", F.lit("")).alias("problem"), F.lit("s").alias("solution"), F.lit("t").alias("type"), F.lit("l").alias("level"))
    got = workflows.translate(spark, rows, LengthClient(fail_in=7), presets.TRANSLATOR_PROMPT, fresh_path(spark, "translate"))
    return got.select("pos", "id", "thought_process", "translated_question", "translated_solution")


SIMILAR_SYSTEM = "Make a similar problem."


def _similar_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).withColumns({c: F.lit(c) for c in ("type", "level", "original_problem", "original_solution", "translated_solution")})


@query(f"""SELECT concat('math_test_', item_id) AS source_id, q AS original_question, concat('question ', n % 1000) AS similar_question, concat('solution ', n % 100) AS similar_solution
FROM (SELECT item_id, q, {len(SIMILAR_SYSTEM) + _said("similar", "question", "solution") + len("translated_solution")} + length(q) AS n
 FROM (SELECT item_id, coalesce(nullif(q, ''), 'original_problem') AS q FROM {SQL_ITEMS})) WHERE n % 9 <> 0""")
def similar_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-alike problems with strict replies; calls fail where the number of characters is divisible by nine."""
    got = workflows.make_similar(spark, _similar_inputs(spark, sf_dir), LengthClient(fail_in=9), SIMILAR_SYSTEM, fresh_path(spark, "similar"), wave=25)
    return got.select("source_id", "original_question", "similar_question", "similar_solution")


@query(f"""SELECT 'similar' AS task, item_id AS pos FROM (SELECT item_id, {len(SIMILAR_SYSTEM) + _said("similar", "question", "solution") + len("translated_solution")} + length(coalesce(nullif(q, ''), 'original_problem')) AS n FROM {SQL_ITEMS}) WHERE n % 9 = 0""")
def failed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead-letter table of the same calls."""
    path = fresh_path(spark, "similar")
    workflows.make_similar(spark, _similar_inputs(spark, sf_dir), LengthClient(fail_in=9), SIMILAR_SYSTEM, path)
    return spark.read.parquet(workflows.failed_path(path)).select("task", "pos")


def _sql_value(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_FIELDS = {"grade": "grade", "learned_scope": "learned_scope", "weak_area": "weak_area"}
SQL_PROFILES = "profiles(ord, id, grade, learned_scope, weak_area) AS (VALUES " + ", ".join(f"({p[0]}, {', '.join(map(_sql_value, p[1:]))})" for p in presets.PROFILES) + ")"
SQL_BLOCK = "concat(" + _profile_sql([(label, f"coalesce({_FIELDS[name]}, '{NO_FIELD}')" if name in _FIELDS else f"'{NO_FIELD}'") for label, name in PROFILE_LABELS]) + ")"
SQL_DIALOGUES = f"""WITH RECURSIVE {SQL_PROFILES},
start AS (SELECT item_id AS pos, length(concat('You are a learner.', chr(10), {SQL_BLOCK}, chr(10), 'Problem: ', q, chr(10), 'You are ', {SQL_CONDITIONS}[item_id % 3 + 1], '.')) AS s,
 {len(presets.TEACHER_PROMPT) + _said("teacher_opening", "problem")} + length(q) AS t FROM {SQL_ITEMS} JOIN profiles ON ord = item_id % 10 WHERE coalesce(q, '') <> '' AND item_id < 200),
r AS (SELECT pos, 0 AS k, s, t, '' AS log, 0 AS turns, false AS done, false AS ended FROM start
UNION ALL SELECT pos, k + 1, s + length(w) + length(u), t1 + length(u), concat(log, CASE WHEN sf THEN '' WHEN tf THEN concat('|', w) ELSE concat('|', w, '|', u) END),
 turns + CASE WHEN sf THEN 0 WHEN tf THEN 1 ELSE 2 END, NOT sf AND NOT tf AND d, sf OR tf OR d
 FROM (SELECT *, t1 % 23 = 0 AS tf, concat('utterance ', t1 % 1000, '.') AS u, (t1 // 16) % 4 = 0 AS d FROM (SELECT *, t + length(w) AS t1 FROM (SELECT *, sn % 23 = 0 AS sf, concat('words ', sn % 1000) AS w
  FROM (SELECT *, s + CASE WHEN k = 0 THEN {len(workflows.WORDS["student_opening"])} ELSE 0 END AS sn FROM r WHERE NOT ended AND k < 15)))))
SELECT pos, concat('math_test_', pos) AS source_id, done AS is_completed, CAST(turns AS BIGINT) AS turns, log AS said FROM r WHERE ended OR k = 15"""


@query(SQL_DIALOGUES)
def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues turn by turn: calls fail, tutors end a session, or the turns run out, by the number of characters so far."""
    inputs = workflows.dialogue_inputs(_records(spark, sf_dir), presets.profiles(spark), presets.CONDITIONS, presets.STUDENT_PROMPT)
    made = workflows.make_dialogues(spark, inputs, LengthClient(fail_in=23), presets.TEACHER_PROMPT, fresh_path(spark, "dialogues"))
    said = F.concat_ws("", F.transform("conversation", lambda t: F.concat(F.lit("|"), t["content"])))
    return made.select("pos", "source_id", "is_completed", F.size("conversation").cast("long").alias("turns"), said.alias("said"))


@query()
def translate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 translations that succeed; the stub fails one call in seven."""
    rows = problems(spark, sf_dir).select("pos", F.coalesce("problem", F.lit("")).alias("problem"), F.lit("s").alias("solution"), F.lit("t").alias("type"), F.lit("l").alias("level"))
    return workflows.translate(spark, rows, StubClient(fail_in=7), presets.TRANSLATOR_PROMPT, fresh_path(spark, "translate"))


@query()
def similar_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.make_similar(spark, _similar_inputs(spark, sf_dir), StubClient(fail_in=9), SIMILAR_SYSTEM, fresh_path(spark, "similar"))


@query()
def dialogue_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = workflows.dialogue_inputs(_records(spark, sf_dir), presets.profiles(spark), presets.CONDITIONS, presets.STUDENT_PROMPT)
    made = workflows.make_dialogues(spark, inputs, StubClient(fail_in=23), presets.TEACHER_PROMPT, fresh_path(spark, "dialogues"))
    return made.select("pos", "source_id", "is_completed", F.size("conversation").cast("long").alias("turns"), F.to_json("conversation").alias("conversation"))


def _evaluated(spark: SparkSession, sf_dir: str, client: StubClient) -> DataFrame:
    originals = _records(spark, sf_dir).where("translated_question <> ''").select(F.col("id").alias("key"), F.col("pos").alias("place"), "translated_question")
    n = 2 * F.col("item_id")
    name = F.when(n % 3 != 0, source_id("math_test_", n)).otherwise(source_id("unmatched_", n))
    similar = table(spark, sf_dir, "benchmark").select(name.alias("key"), F.lit("q").alias("similar_question"), F.lit("s").alias("similar_solution"))
    inputs = workflows.evaluation_inputs(originals, similar, presets.profiles(spark), presets.EVALUATION_PROMPT, presets.TEACHER_PROMPT)
    got = workflows.evaluate(spark, inputs, client, client, client, presets.JUDGE_PROMPT, fresh_path(spark, "evaluation"))
    return got.select("pos", "source_id", F.col("phase1_turns").cast("long").alias("phase1_turns"), "phase1_is_completed", "phase2_student_answer", "phase2_is_correct", "judge_reason")


@query()
def evaluation_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, StubClient(fail_in=29))


def _evaluation_sql() -> str:
    """Both phases and the judge by the numbers of characters, as ``LengthClient`` answers."""
    block = "concat(" + _profile_sql([(label, f"coalesce({name}, '{NO_FIELD}')") for label, name in EVALUATION_PROFILE_LABELS]) + ")"
    system = lambda mode: f"length(concat('You are a learner.', chr(10), {block}, chr(10), 'Now: {mode}'))"
    # a tutor's reply without what changes from one to the next
    sample = made_reply("teacher_free", 0, 1)
    skeleton = len(sample) - len(EMOTIONS[0]) - len("0") * 4 - len("true")
    raw = f"{skeleton} + length(cast(t1 % 50 AS VARCHAR)) + length({EMOTION_LIST}[t1 % 10 + 1]) + length(cast(t1 % 9 AS VARCHAR)) + length(cast(t1 % 11 AS VARCHAR)) + CASE WHEN d THEN 4 ELSE 5 END + length(cast(t1 % 1000 AS VARCHAR)) + CASE WHEN t1 % 2 = 1 THEN {len('Here it is: ')} ELSE 0 END"
    return f"""WITH RECURSIVE {SQL_PROFILES},
pairs AS (SELECT 2 * item_id AS pos, text AS q, row_number() OVER (ORDER BY item_id) - 1 AS turn FROM benchmark WHERE text <> '' AND 2 * item_id % 3 <> 0),
start AS (SELECT pos, {system(MODE_LEARNING)} + {_said("evaluation_opening", "problem")} + length(q) AS s, {len(presets.TEACHER_PROMPT) + _said("teacher_opening", "problem")} + length(q) AS t,
 {system(MODE_TRANSFER)} AS transfer FROM pairs JOIN profiles ON ord = turn % 10),
r AS (SELECT pos, 0 AS k, s, t, '' AS log, 0 AS turns, false AS done, false AS ended, transfer FROM start
UNION ALL SELECT pos, k + 1, s + length(w) + length(u), t1 + {raw}, concat(log, CASE WHEN sf THEN '' ELSE concat(CASE WHEN log = '' THEN '' ELSE chr(10) END, 'student: ', w, CASE WHEN tf THEN '' ELSE concat(chr(10), 'teacher: ', u) END) END),
 turns + CASE WHEN sf THEN 0 WHEN tf THEN 1 ELSE 2 END, NOT sf AND NOT tf AND d, sf OR tf OR d, transfer
 FROM (SELECT *, t1 % 29 = 0 AS tf, concat('utterance ', t1 % 1000, '.') AS u, (t1 // 16) % 4 = 0 AS d FROM (SELECT *, t + length(w) AS t1 FROM (SELECT *, s % 29 = 0 AS sf, concat('words ', s % 1000) AS w FROM r WHERE NOT ended AND k < 15)))),
first AS (SELECT *, transfer + {_said("transfer", "history", "question")} + length(log) + 1 AS n FROM r WHERE ended OR k = 15),
second AS (SELECT *, CASE WHEN n % 29 = 0 THEN '{FAILED_ANSWER}' ELSE concat('words ', n % 1000) END AS answer FROM first),
third AS (SELECT *, {len(presets.JUDGE_PROMPT) + _said("judge", "answer", "solution")} + length(answer) + 1 AS j FROM second)
SELECT row_number() OVER (ORDER BY pos) AS rank, concat('math_test_', pos) AS source_id, CAST(turns // 2 AS BIGINT) AS phase1_turns, done AS phase1_is_completed, answer AS phase2_student_answer,
 j % 29 <> 0 AND j % 3 <> 0 AS phase2_is_correct, CASE WHEN j % 29 = 0 THEN concat('{FAILED_JUDGE}stub failure ', j % 1000) ELSE concat('reason ', j % 10) END AS judge_reason FROM third"""


@query(_evaluation_sql())
def evaluation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase 1, phase 2 and the judge; calls fail, and dialogues end, by the number of characters so far."""
    got = renumber(_evaluated(spark, sf_dir, LengthClient(fail_in=29)), "pos", "rank")
    return got.withColumn("rank", F.col("rank") + 1).drop("pos")


@query(SQL_TRANSLATED.replace("math_train_", "math_test_").replace(" WHERE n % 7 <> 0", " WHERE pos >= 200 AND n % 7 <> 0").replace("r <= 200", "r <= 40"))
def translate_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test pool: the first 40 translations that succeed, from the place where it begins."""
    rows = problems(spark, sf_dir).select("pos", F.coalesce("problem", F.lit("")).alias("problem"), F.lit("s").alias("solution"), F.lit("t").alias("type"), F.lit("l").alias("level"))
    got = workflows.translate_test(spark, rows, LengthClient(fail_in=7), presets.TRANSLATOR_PROMPT, fresh_path(spark, "translate"))
    return got.select("pos", "id", "thought_process", "translated_question", "translated_solution")


# --- recorded replies -------------------------------------------------------

#: What was recorded for a document: nothing, no JSON, a question that refers to a figure, and two good replies.
RECORDED = """CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no object' WHEN 2 THEN concat('{"similar_question": "As shown in the figure, ', doc_id, '", "similar_solution": "s"}')
 ELSE concat('{"similar_question": "like ', doc_id, '", "similar_solution": "', lang, '"}') END"""


@query(f"""WITH r AS (SELECT doc_id, coalesce(text, '') AS q, coalesce(source, '') AS s, {RECORDED} AS reply FROM documents),
k AS (SELECT doc_id, min(reply) OVER (PARTITION BY coalesce(nullif(q, ''), 'none'), s) AS reply FROM r)
SELECT concat('id', doc_id) AS source_id, json_extract_string(reply, '$.similar_question') AS similar_question, json_extract_string(reply, '$.similar_solution') AS similar_solution, CAST(NULL AS VARCHAR) AS error
FROM k WHERE reply LIKE '{{%' AND NOT regexp_matches(reply, 'As shown')
UNION ALL SELECT concat('id', doc_id), NULL, NULL, CASE WHEN reply IS NULL THEN 'no recorded reply' ELSE 'the reply is not of the form asked for' END FROM k WHERE reply IS NULL OR reply NOT LIKE '{{%'""")
def replayed_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar problems from a table of recorded replies, found by a join on the request; failed ones from the dead-letter table."""
    docs = table(spark, sf_dir, "documents")
    question, solution = first_filled(F.coalesce("text", F.lit("")), F.lit("none")), F.coalesce("source", F.lit(""))
    replies = docs.select(workflows.request_of("similar", SIMILAR_SYSTEM, workflows.similar_prompt(question, solution)).alias("request"), F.expr(RECORDED).alias("reply"))
    replies = Scratch(spark, "replies").write(replies.where("reply is not null"), "recorded")
    empty = F.lit("")
    rows = docs.select(
        F.col("doc_id").alias("pos"), source_id("id", F.col("doc_id")).alias("id"), empty.alias("type"), empty.alias("level"), F.lit("none").alias("original_problem"),
        F.coalesce("text", empty).alias("translated_question"), F.coalesce("source", empty).alias("original_solution"), empty.alias("translated_solution"),
    )
    path = fresh_path(spark, "replayed")
    got = workflows.make_similar(spark, rows, ReplayTable(replies), SIMILAR_SYSTEM, path, wave=1_000_000)
    failed = spark.read.parquet(workflows.failed_path(path)).select(source_id("id", F.col("pos")).alias("source_id"), "error")
    return got.select("source_id", "similar_question", "similar_solution").unionByName(failed, allowMissingColumns=True)


# --- more sources, and records that arrive in batches -----------------------


@query("SELECT row_number() OVER (ORDER BY doc_id % 3, doc_id) - 1 AS pos, md5(coalesce(text, '')) AS problem, '' AS solution, coalesce(source, 'unknown') AS type, 'unknown' AS level FROM documents")
def problems_from_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A problem corpus in several Parquet files without positions: files by path, rows by their place."""
    folder, docs = fresh_path(spark, "problems"), table(spark, sf_dir, "documents")
    for k in range(3):
        rows = docs.where(F.col("doc_id") % 3 == k).select(F.col("text").alias("problem"), F.col("source").alias("type"), "doc_id")
        rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").drop("doc_id")
        rows.write.option("parquet.block.size", 1 << 20).parquet(f"{folder}/part{k}")
    got = read_problems(spark, f"{folder}/*", kind="parquet")
    return got.select("pos", F.md5("problem").alias("problem"), "solution", "type", "level")


TURN = StructType([StructField("conv_id", LongType()), StructField("pos", LongType()), StructField("role", StringType()), StructField("text", StringType())])


@query("SELECT conv_id AS key, min(turn)::BIGINT AS place, max(turn)::BIGINT AS pos, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id")
def incremental_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that arrive in four parts: a stream takes two, stops, and goes on from its checkpoint with the rest."""
    from ..streaming.incremental import last_wins_stream, read_last_wins, record_stream

    root = fresh_path(spark, "stream")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("pos"), "role", "text")
    for part in (0, 1, None, 2, 3, None):  # None: what has arrived is taken
        if part is None:
            stream = last_wins_stream(record_stream(spark, f"{root}/in", TURN, max_files=4), F.col("conv_id"), f"{root}/out", f"{root}/checkpoint")
            stream.awaitTermination()
        else:
            turns.where(F.col("pos") % 4 == part).write.mode("append").json(f"{root}/in")
    return read_last_wins(spark, f"{root}/out").select("key", "place", "pos", "role", F.md5("text").alias("digest"))
