import json
import random
import re

import pytest
from pyspark.sql import functions as F

from dialoom.fixed import FIGURE_PATTERNS_EN, FIGURE_PATTERNS_JA, PROBLEM_COLUMNS
from dialoom.functions import chat
from dialoom.functions.text import embedded_reply, first_filled, fixed_precision, is_blank, parse_embedded, strict_reply, strip, tagged_blocks
from dialoom.operators.filters import is_text_only, is_text_only_record, needed_literals
from dialoom.schemas import DIALOGUE_TURN, JUDGE_RESPONSE


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], kinds).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, keep",
    [
        (None, True), ("", True), ("Add two and two.", True), ("see [asy] x [/asy]", False), ("x [/asy]", False), ("[ASY]", True),
        ("SHOWN here\n\n and BELOW", False), ("the base is shown", False), ("ſhown in a diagram", False), ("shown figure", False), ("figure shown", True),
    ],
)
def test_text_only(spark, text, keep):
    assert one(spark, is_text_only(F.col("t")), t=text) is keep


def test_figures_as_python_finds_them(spark):
    """Texts of parts of the patterns, whole and cut, in odd cases, against Python's search."""
    draw = random.Random(5)
    parts = [w for p in FIGURE_PATTERNS_EN + FIGURE_PATTERNS_JA for w in p.split(".*")] + ["x", " ", "\n", "\u2028", "asy]", "[asy]"]
    odd = {"s": "Sſ", "k": "\u212a", "i": "Iİı", "a": "A", "g": "G", "ß": "ẞ"}
    texts = ["", "\x1c \u3000", "\x85\x0b", "​", "ﬆhown as shown", "refer: dİagram", "refer dıagram", "shown fİgure"]
    for _ in range(3000):
        words = [w if draw.random() < 0.8 else w[: draw.randrange(len(w))] for w in draw.choices(parts, k=draw.randint(1, 5))]
        texts.append("".join(draw.choice(odd.get(c, c.upper())) if draw.random() < 0.3 else c for c in "".join(words)))
    found = lambda t, patterns: "[asy]" in t or "[/asy]" in t or any(re.search(p, t, re.IGNORECASE | re.DOTALL) for p in patterns)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, problem string").orderBy("k")
    got = rows.select(is_text_only(F.col("problem")), is_text_only_record(PROBLEM_COLUMNS, ["problem"]), is_blank(F.col("problem"))).collect()
    joined = ["\n\n" + t + "\n" for t in texts]
    want = [(not found(t, FIGURE_PATTERNS_EN), not j.strip() or not found(j, FIGURE_PATTERNS_JA + FIGURE_PATTERNS_EN), not t.strip()) for t, j in zip(texts, joined)]
    assert [(t, *g) for t, g in zip(texts, got)] == [(t, *w) for t, w in zip(texts, want)]
    assert len(set(want)) > 3
    assert needed_literals(FIGURE_PATTERNS_EN) == ["diagram", "shown"]
    for patterns in (FIGURE_PATTERNS_EN, FIGURE_PATTERNS_JA):
        assert all(set(p.split(".*")) & set(needed_literals(patterns)) for p in patterns)


@pytest.mark.parametrize(
    "row, keep",
    [
        ({}, True), ({"problem": "  \n"}, True), ({"original_problem": "as", "question": "shown"}, False), ({"question": "[asy]"}, False), ({"problem": "普通"}, True),
        *[({"translated_question": t}, False) for t in ("図に示す", "図のような", "下の図", "図を参照", "グラフに示す", "図の領域", "画面の領域")],
    ],
)
def test_bilingual(spark, row, keep):
    values = {c: row.get(c) for c in PROBLEM_COLUMNS}
    assert one(spark, is_text_only_record(PROBLEM_COLUMNS), **values) is keep
    # columns that a record does not have
    assert one(spark, is_text_only_record(PROBLEM_COLUMNS, list(row)), **(row or {"x": None})) is keep


def python_blocks(reply):
    reply = reply.strip()
    get = lambda p: m[1].strip() if (m := re.search(p, reply, re.DOTALL)) else ""
    return (get(r"\[Thought Process\](.*?)\[Q\]"), get(r"\[Q\](.*?)\[A\]"), get(r"\[A\](.*)"))


@pytest.mark.parametrize("reply", ["[Thought Process] a\nb [Q] c [A] d\ne ", "none", "[Q] only", "[A] x [Q] y", "[A] x [Q] y [A] z", "[Thought Process] [Q] [Q] [A] [A]", "　[Q]　q　[A]　a　"])
def test_tags(spark, reply):
    blocks = tagged_blocks(F.col("r"))
    row = spark.createDataFrame([(reply,)], "r string").select(*[c.alias(n) for n, c in blocks.items()]).first()
    assert tuple(row) == python_blocks(reply)


def test_strip_knows_all_white_space(spark):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert len(spaces) == 29
    assert one(spark, strip(F.col("t")), t=f"{spaces}a b{spaces}") == "a b"
    assert one(spark, strip(F.col("t")), t=spaces) == ""
    assert one(spark, strip(F.col("t")), t=None) is None


@pytest.mark.parametrize("number, digits, text", [(2.675, 2, "2.67"), (12.25, 1, "12.2"), (0.125, 2, "0.12"), (12345.65, 1, "12345.6"), (0.0, 1, "0.0")])
def test_precision(spark, number, digits, text):
    assert f"{number:.{digits}f}" == text == one(spark, fixed_precision(F.col("x"), digits), x=number)


REPLIES = [
    ("plain words", ("plain words", False)),
    ('so: {"teacher_utterance": "go", "is_completed": true} ok', ("go", True)),
    ("{'teacher_utterance': 'x'}", ("{'teacher_utterance': 'x'}", False)),
    ('{"teacher_utterance": "x",}', ('{"teacher_utterance": "x",}', False)),
    ("{ open", ("{ open", False)),
    ("} shut {", ("} shut {", False)),
    ('{"a": 1} {"b": 2}', ('{"a": 1} {"b": 2}', False)),
    ('{"teacher_utterance": "a", "teacher_utterance": "b"}', ("b", False)),
    ('{"x": NaN}', ("", False)),
    ("{}", ("", False)),
    ('{"teacher_utterance": "x", "is_completed": "no"}', ("x", "no")),
]


def test_embedded(spark):
    assert [parse_embedded(r) for r, _ in REPLIES] == [w for _, w in REPLIES]
    rows = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(REPLIES)] + [(99, None)], "k int, r string").select("k", embedded_reply("r").alias("v")).orderBy("k").collect()
    assert [(r.v.teacher_utterance, r.v.is_completed) for r in rows] == [(w, bool(d)) for _, (w, d) in REPLIES] + [(None, False)]


def test_strict(spark):
    parse = lambda t: one(spark, strict_reply(F.col("t"), JUDGE_RESPONSE), t=t)
    assert tuple(parse('{"is_correct": true, "judge_reason": "r"}')) == (True, "r")
    assert tuple(parse(' {"is_correct": false}\n')) == (False, None)
    for broken in ("{'is_correct': true}", "no json", '{"is_correct": true} tail', '{"is_correct": true', '{"is_correct": "yes"}', "[1]", "null", "", None, '{"is_correct": true}] x', '{"is_correct": true}, "x": 1', '{"is_correct": true}, {"is_correct": true}'):
        assert parse(broken) is None, broken


def test_fallbacks_and_templates(spark):
    assert one(spark, first_filled(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert one(spark, first_filled(F.col("a"), F.col("b")), a=None, b="x") == "x"
    slots = {"{A}": F.lit("{B}"), "{B}": F.lit("b")}
    assert one(spark, chat.fill_once("{A}-{B}", slots)) == "{B}-b"
    assert one(spark, chat.fill_in_turn("{A}-{B}", slots)) == "b-b"
    block = chat.profile_block({"grade": F.lit("g")})
    assert one(spark, block) == "【学年】: g\n【学習済みの範囲】: 不明\n【ミスしやすい点】: 不明\n【苦手な範囲】: 不明"
    assert one(spark, chat.profile_block({"grade": F.lit("g")}, evaluation=True)).count("\n") == 2


def test_chat_messages(spark):
    turns = [
        {"turn": 0, "role": "student", "content": "s"},
        {"turn": 0, "role": "teacher", "content": "t", "thought_process": "p", "student_emotion": "Bored"},
        {"turn": 1, "role": "other", "content": "x"},
        {"turn": 1, "role": "student", "content": "unanswered"},
    ]
    full = [tuple(t.get(f) for f in DIALOGUE_TURN.names) for t in turns]
    df = spark.createDataFrame([("q", full), (None, None), ("e", [])], f"problem string, c array<{DIALOGUE_TURN.simpleString()}>")
    got = [json.loads(r[0]) for r in df.select(F.to_json(chat.chat_messages("sys", F.col("problem"), F.col("c")))).collect()]
    block = "<analysis>\n【推論プロセス】: p\n【生徒の感情】: Bored\n&lt;ロードマップ&gt;: \n【次の一歩の計画】: \n</analysis>\n"
    assert got[0] == [
        {"role": "system", "content": "sys\n\n現在出題中の問題:\nq"},
        {"role": "user", "content": "s"},
        {"role": "assistant", "content": block + "t"},
        {"role": "user", "content": "unanswered"},
    ]
    assert [len(g) for g in got] == [4, 1, 1] and got[1][0]["content"].endswith(":\n")
    row = df.select(chat.history(F.col("c")).alias("h"), chat.exchanges(F.col("c")).alias("n")).first()
    assert row.h == "student: s\nteacher: t\nother: x\nstudent: unanswered" and row.n == 2
