import json
import random
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dialoom.functions.text import embedded_reply
from dialoom.plans import presets, workflows
from dialoom.plans.client import CallFailed, ReplayClient, StubClient, request_key
from dialoom.plans.dialogue import answer_similar, corpus_dialogue, evaluation_dialogue, judge_answer
from dialoom.schemas import RAW_PROBLEM, STUDENT_PROFILE
from dialoom.sources.progress import Progress
from dialoom.sources.readers import read_json_array, read_jsonl, read_keyed, read_problems, read_prompt
from dialoom.sources.writers import append_missing, write_json_array, write_jsonl
from dialoom.streaming.incremental import emotion_stream, session_stream, sft_stream


class Script:
    """Answers each task from its own list; an exception in it is raised."""

    def __init__(self, **replies):
        self.replies, self.seen, self.schemas = {k: list(v) for k, v in replies.items()}, [], {}

    def complete(self, task, messages, temperature=0.0, schema=None):
        self.seen.append((task, [dict(m) for m in messages]))
        self.schemas[task] = schema
        reply = self.replies[task].pop(0) if len(self.replies[task]) > 1 else self.replies[task][0]
        if isinstance(reply, Exception):
            raise reply
        return reply


def teacher(done, words="go on"):
    return json.dumps({"thought_process": "p", "student_emotion": "Bored", "is_completed": done, "teacher_utterance": words})


def corpus(client, **options):
    return corpus_dialogue(client, "1 + 1", "student prompt", "teacher prompt", "begin", "problem: {problem}", **options)


def test_dialogue_stops():
    log, done = corpus(Script(student=[" hi "], teacher=[teacher(True)]))
    assert done and [(t["turn"], t["role"], t["content"]) for t in log] == [(0, "student", "hi"), (0, "teacher", "go on")]
    assert log[1]["roadmap_breakdown"] == ""
    log, done = corpus(Script(student=["x"], teacher=[teacher(False)]))
    assert not done and len(log) == 30
    log, done = corpus(Script(student=["x", "y", CallFailed()], teacher=[teacher(False)]))
    assert not done and len(log) == 4
    log, done = corpus(Script(student=["x"], teacher=[teacher(False), CallFailed()]))
    assert not done and [t["role"] for t in log] == ["student", "teacher", "student"]
    log, done = corpus(Script(student=["x"], teacher=["no json"]))
    assert not done and len(log) == 1


def test_dialogue_contexts():
    client = Script(student=["one", "two"], teacher=[teacher(False), teacher(True)])
    corpus(client)
    students = [m for t, m in client.seen if t == "student"]
    teachers = [m for t, m in client.seen if t == "teacher"]
    assert [m["content"] for m in students[0]] == ["student prompt", "begin"]
    # the opening is not kept; the learner's own words are the assistant's
    assert [(m["role"], m["content"]) for m in students[1]] == [("system", "student prompt"), ("assistant", "one"), ("user", "go on")]
    assert [(m["role"], m["content"]) for m in teachers[1]][2:] == [("user", "one"), ("assistant", "go on"), ("user", "two")]


def test_evaluation_dialogue_keeps_raw_replies():
    client = Script(student=["a"], teacher_free=["free words", f"json: {teacher(True, 'end')}"])
    log, done = evaluation_dialogue(client, [{"role": "system", "content": "s"}], [{"role": "system", "content": "t"}])
    assert done and [m["content"] for m in log] == ["a", "free words", "a", "end"]
    client = Script(student=["a"], teacher_free=[f"json: {teacher(False, 'x')}", CallFailed()])
    log, done = evaluation_dialogue(client, [], [])
    assert not done and len(log) == 3
    assert client.seen[-1][1][1]["content"].startswith("json: {")


def test_failed_answers_are_judged():
    assert answer_similar(Script(answer=[CallFailed()]), "s", "p") == "Error during generation"
    assert judge_answer(Script(judge=[CallFailed("down")]), "s", "p") == (False, "API Error: down")
    assert judge_answer(Script(judge=['{"is_correct": true, "judge_reason": "r"}']), "s", "p") == (True, "r")
    messages = [{"role": "user", "content": "x"}]
    assert ReplayClient({request_key("t", messages): "y"}).complete("t", messages) == "y"
    with pytest.raises(CallFailed):
        ReplayClient().complete("t", messages)


def problems(spark, n=60):
    rows = [(k, "shown in the figure" if k % 6 == 0 else f"problem {k}", f"solution {k}", "algebra", "1") for k in range(n)]
    return spark.createDataFrame(rows, "pos long, problem string, solution string, type string, level string").repartition(4)


def test_translation_counts_successes(spark, tmp_path):
    client = StubClient(fail_in=4)
    got = workflows.translate(spark, problems(spark), client, "sys", str(tmp_path / "t"), limit=20).orderBy("pos").collect()

    def succeeds(k):
        try:
            client.complete("translate", [{"role": "system", "content": "sys"}, {"role": "user", "content": f"Translate this problem and its solution.\n\n[Original Q]\nproblem {k}\n\n[Original A]\nsolution {k}"}])
            return True
        except CallFailed:
            return False

    want = [k for k in range(60) if k % 6 and succeeds(k)][:20]
    assert [r.pos for r in got] == want and [r.id for r in got] == [f"math_train_{k}" for k in want]
    assert all(r.translated_question.startswith("question") and r.thought_process for r in got)
    assert workflows.translate_test(spark, problems(spark), client, "sys", str(tmp_path / "u")).count() == 0


def test_growing_table_goes_on_where_it_stopped(spark, tmp_path):
    todo = spark.range(25).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("key"))
    calls = spark.sparkContext.accumulator(0)

    def run(rows):
        def count(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return rows.mapInArrow(count, rows.schema)

    path = str(tmp_path / "grow")
    append_missing(spark, todo.where("pos < 12"), path, "key", run, wave=5)
    assert calls.value == 12
    assert append_missing(spark, todo, path, "key", run, wave=10).count() == 25 and calls.value == 25
    assert append_missing(spark, todo.limit(0), str(tmp_path / "none"), "key", run).count() == 0
    assert append_missing(spark, todo.where("pos = 1"), path, "key", run, restart=True).count() == 1


def test_whole_corpus_workflow(spark, tmp_path):
    translated = workflows.translate(spark, problems(spark), StubClient(), presets.TRANSLATOR_PROMPT, str(tmp_path / "t"), limit=30)
    cleaned = workflows.clean(translated)
    inputs = workflows.dialogue_inputs(cleaned, presets.profiles(spark), presets.CONDITIONS, presets.STUDENT_PROMPT)
    first = workflows.make_dialogues(spark, inputs, StubClient(fail_in=19), presets.TEACHER_PROMPT, str(tmp_path / "d"))
    again = workflows.make_dialogues(spark, inputs.repartition(9), StubClient(fail_in=19), presets.TEACHER_PROMPT, str(tmp_path / "e"), wave=7)
    rows = first.orderBy("pos").collect()
    assert rows == again.orderBy("pos").collect() and len(rows) == cleaned.count()
    profile = {r.pos: r.student_profile.id for r in rows}
    assert all(p == f"P{k % 10:02d}" for k, p in profile.items())
    sizes = workflows.prepare_sft(spark, first, presets.SFT_PROMPT, str(tmp_path / "train"), str(tmp_path / "val"))
    done = [r for r in rows if r.is_completed]
    assert sizes == {"train": int(len(done) * 0.8), "val": len(done) - int(len(done) * 0.8)}
    order = list(range(len(done)))
    random.Random(42).shuffle(order)
    lines = [json.loads(x.value) for name in ("train", "val") for x in spark.read.text(str(tmp_path / name)).collect()]
    want = {done[k].problem for k in order}
    assert {m["messages"][0]["content"].rsplit("\n", 1)[1] for m in lines} == want
    stream_in = str(tmp_path / "d_json")
    first.drop("pos").write.json(stream_in)
    progress = Progress(spark)
    query = sft_stream(session_stream(spark, stream_in), presets.SFT_PROMPT, str(tmp_path / "out"), str(tmp_path / "cp"), progress)
    query.awaitTermination(120)
    for _ in range(50):
        if progress.streamed("sft"):
            break
        time.sleep(0.1)
    assert progress.streamed("sft") == {"read": len(rows), "completed": len(done)}
    progress.close()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(done)
    query = emotion_stream(session_stream(spark, stream_in), "states", str(tmp_path / "cp2"))
    query.awaitTermination(120)
    assert spark.table("states").agg(F.sum("count")).first()[0] == sum(t.role == "teacher" for r in rows for t in r.conversation)


def test_evaluation(spark, tmp_path):
    originals = spark.createDataFrame([(f"k{p}", p, f"question {p}") for p in range(9)], "key string, place long, translated_question string")
    similar = spark.createDataFrame([(f"k{p}", "sq", "ss") for p in range(9) if p != 3], "key string, similar_question string, similar_solution string")
    inputs = workflows.evaluation_inputs(originals, similar, presets.profiles(spark), presets.EVALUATION_PROMPT, presets.TEACHER_PROMPT)
    c = StubClient(fail_in=5)
    got = workflows.evaluate(spark, inputs, c, c, c, presets.JUDGE_PROMPT, str(tmp_path / "e"), wave=3).orderBy("pos").collect()
    assert [r.source_id for r in got] == [f"k{p}" for p in range(9) if p != 3]
    assert [r.student_profile_used.id for r in got] == [f"P{k:02d}" for k in range(8)]
    assert all(r.phase1_turns == len(r.dialogue_log) // 2 for r in got)


def test_similar(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"id{k}", "t", "l", f"o{k}", "" if k else "tq", "s", "ts") for k in range(20)], "pos long, id string, type string, level string, original_problem string, translated_question string, original_solution string, translated_solution string")
    got = workflows.make_similar(spark, rows, StubClient(fail_in=3), "sys", str(tmp_path / "s")).collect()
    assert 0 < len(got) < 20 and all(r.similar_question.startswith("question") for r in got)
    assert {r.original_question for r in got} <= {"tq", *(f"o{k}" for k in range(20))}


def test_jsonl(spark, tmp_path):
    lines = [json.dumps({"problem": f"日本 {k}", "solution": None if k % 3 else "s"}, ensure_ascii=False) for k in range(500)]
    text = "".join(f"{x}{'\r\n' if k % 2 else '\n'}{'   \n' if k % 5 == 0 else ''}" for k, x in enumerate(lines))
    (tmp_path / "in.jsonl").write_text(text, encoding="utf-8", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = read_jsonl(spark, str(tmp_path / "in.jsonl"), RAW_PROBLEM)
        assert got.rdd.getNumPartitions() > 3
        assert [(r.pos, r.problem) for r in got.orderBy("pos").collect()] == [(k, f"日本 {k}") for k in range(500)]
        filled = read_problems(spark, str(tmp_path / "in.jsonl")).orderBy("pos").first()
        assert (filled.type, filled.solution) == ("unknown", "s")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    write_jsonl(got, str(tmp_path / "out"), "pos")
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {r["problem"] for r in back} == {f"日本 {k}" for k in range(500)} and all("level" in r for r in back)
    (tmp_path / "bad.jsonl").write_text('{"problem": "a"}\n{bad\n')
    with pytest.raises(Exception, match="MALFORMED"):
        read_jsonl(spark, str(tmp_path / "bad.jsonl"), RAW_PROBLEM).collect()
    with pytest.raises(PySparkException):
        read_jsonl(spark, str(tmp_path / "missing.jsonl"), RAW_PROBLEM).collect()
    with pytest.raises(FileNotFoundError):
        read_prompt(spark, str(tmp_path / "missing.txt"))


def test_json_array_and_keyed(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"S{k}", "中学") for k in range(4)], "ord long, id string, grade string")
    assert write_json_array(rows, str(tmp_path / "deep" / "p.json"), "ord") == 4
    assert "中学" in (tmp_path / "deep" / "p.json").read_text(encoding="utf-8")
    back = read_json_array(spark, str(tmp_path / "deep" / "p.json"), STUDENT_PROFILE).orderBy("ord").collect()
    assert [(r.ord, r.id, r.grade, r.weak_area) for r in back] == [(k, f"S{k}", "中学", None) for k in range(4)]
    with pytest.raises(ValueError):
        write_json_array(rows, str(tmp_path / "q.json"), "ord", limit=3)
    (tmp_path / "k.jsonl").write_text('{"id": "a", "grade": "1"}\n\n{"id": "b", "grade": "2"}\n{"id": "a", "grade": "3"}\n')
    got = read_keyed(spark, str(tmp_path / "k.jsonl"), StructType([*STUDENT_PROFILE.fields, StructField("source_id", StringType())]))
    assert sorted((r.key, r.place, r.grade) for r in got.collect()) == [("a", 0, "3"), ("b", 1, "2")]


def test_strict_replies_are_asked_for():
    client = Script(student=["x"], teacher=[teacher(True)], judge=['{"is_correct": true, "judge_reason": "r"}'])
    corpus(client)
    judge_answer(client, "s", "p")
    form = client.schemas["teacher"]["json_schema"]
    assert form["strict"] and form["schema"]["additionalProperties"] is False and client.schemas["student"] is None
    assert form["schema"]["required"] == ["thought_process", "student_emotion", "roadmap_breakdown", "next_step_plan", "is_completed", "teacher_utterance"]
    assert len(form["schema"]["properties"]["student_emotion"]["enum"]) == 10 and form["schema"]["properties"]["is_completed"] == {"type": "boolean"}
    assert client.schemas["judge"]["json_schema"]["schema"]["required"] == ["is_correct", "judge_reason"]


def test_lone_surrogates(spark):
    reply = r'{"teacher_utterance": "a\ud800b", "student_emotion": 3, "is_completed": true}'
    log, done = corpus(Script(student=["x"], teacher=[reply]))
    assert done and log[1]["content"] == "a\ufffdb" and log[1]["student_emotion"] == "3"
    log, _ = evaluation_dialogue(Script(student=["a"], teacher_free=[reply]), [], [])
    assert log[1]["content"] == "a\ufffdb"
    rows = spark.createDataFrame([(reply,), (r'{"teacher_utterance": "\ud83d\ude00"}',)], "r string").select(embedded_reply("r").alias("x")).select("x.*")
    assert [r.teacher_utterance for r in rows.collect()] == ["a\ufffdb", "\U0001f600"]


def test_failed_calls_are_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    client = StubClient(fail_in=4)
    got = workflows.translate(spark, problems(spark), client, "sys", path, limit=20)
    last = got.agg(F.max("pos")).first()[0]
    tried = {k for k in range(last + 1) if k % 6}
    failed = spark.read.parquet(workflows.failed_path(path))
    assert {r.pos for r in failed.collect()} == tried - {r.pos for r in got.collect()} and failed.count() > 0
    assert all(r.task == "translate" and r.error and r.prompt for r in failed.collect())


def test_waves(spark, tmp_path):
    """Sparse positions make no empty waves; counts are reported."""
    todo = spark.range(23).select((F.col("id") * 1_000_000).alias("pos"), F.col("id").cast("string").alias("key")).repartition(3)
    seen = []
    assert append_missing(spark, todo, str(tmp_path / "w"), "key", lambda d: d.where("pos % 2000000 = 0"), wave=10, report=seen.append).count() == 12
    assert [(r["wave"], r["waves"], r["rows"], r["written"]) for r in seen] == [(1, 3, 10, 5), (2, 3, 10, 5), (3, 3, 3, 2)]
    seen.clear()
    append_missing(spark, todo, str(tmp_path / "w"), "key", lambda d: d, wave=6, report=seen.append)
    assert [r["rows"] for r in seen] == [6, 5]


def test_permutation_is_bounded(spark, monkeypatch):
    from dialoom.operators import assign

    monkeypatch.setattr(assign, "PERMUTED_ROWS", 5)
    with pytest.raises(ValueError):
        assign.seeded_split(spark, spark.range(6).withColumnRenamed("id", "pos"))
    for n in (0, 1, 4, 184):
        got = {r.split: r.n for r in assign.split_sizes(spark.range(n)).collect()}
        assert got == {k: v for k, v in (("train", int(n * 0.8)), ("val", n - int(n * 0.8))) if v}


def test_figure_search_is_linear(spark):
    from dialoom.operators.filters import is_text_only

    long = ["as " * 300_000, "shown " * 200_000, "x" * 1_000_000 + " as it is shown", "shown" + " y" * 500_000 + "as"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(long)], "k int, t string")
    began = time.time()
    assert [r[0] for r in rows.orderBy("k").select(is_text_only(F.col("t"))).collect()] == [True, True, False, True]
    assert time.time() - began < 60


def test_replies_of_another_form_are_failures(spark, tmp_path):
    class Sometimes:
        def complete(self, task, messages, temperature=0.0, schema=None):
            k = int(messages[1]["content"].rsplit("s", 1)[1])
            return ('{"similar_question": "q", "similar_solution": "s"}', "no json", '{"similar_question": "q"} tail', '{"similar_question": "as shown in the figure"}')[k % 4]

    rows = spark.createDataFrame([(k, f"id{k}", "t", "l", "o", "tq", "x", f"s{k}") for k in range(8)], "pos long, id string, type string, level string, original_problem string, translated_question string, original_solution string, translated_solution string")
    path = str(tmp_path / "s")
    assert sorted(r.source_id for r in workflows.make_similar(spark, rows, Sometimes(), "sys", path).collect()) == ["id0", "id4"]
    assert sorted(r.pos for r in spark.read.parquet(workflows.failed_path(path)).collect()) == [1, 2, 5, 6]
