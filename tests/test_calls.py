"""Calls over several tasks, first successes by a cursor, recorded replies, counts with the write."""

import json
import sys
import time
from dataclasses import dataclass

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from dialoom.functions.text import as_text, embedded_reply, embedded_steps, parse_embedded
from dialoom.plans import presets, workflows
from dialoom.plans.client import CallFailed, LengthClient, ReplayTable, ask, request_column, request_key
from dialoom.sources.progress import Progress
from dialoom.sources.readers import read_parquet_rows, read_problems, read_prompt, require
from dialoom.sources.spread import Spread
from dialoom.sources.writers import append_missing, cursor_path, first_successes, write_text
from dialoom.streaming.incremental import batches_stream, last_wins_stream, read_last_wins, record_stream


# workers cannot import this module: its classes travel whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class TaskClient:
    """Answers with the number of the task, after a while."""

    wait: float = 0.0

    def complete(self, task, messages, temperature=0.0, schema=None):
        time.sleep(self.wait)
        part = TaskContext.get().partitionId()
        if task == "teacher":
            return json.dumps({"thought_process": str(part), "student_emotion": "Bored", "roadmap_breakdown": "", "next_step_plan": "", "is_completed": True, "teacher_utterance": "x"})
        return json.dumps({"similar_question": f"part {part}", "similar_solution": "s"})


def questions(spark, n):
    rows = [(k, f"id{k}", "t", "l", "o", f"q {k}", "s", "ts") for k in range(n)]
    return spark.createDataFrame(rows, "pos long, id string, type string, level string, original_problem string, translated_question string, original_solution string, translated_solution string")


def test_a_wave_is_dealt_over_tasks(spark, tmp_path):
    got = workflows.make_similar(spark, questions(spark, 64), TaskClient(), "sys", str(tmp_path / "s"), wave=64, spread=Spread(parts=8))
    parts = [r.similar_question for r in got.collect()]
    assert len(parts) == 64 and len(set(parts)) == 8 and all(parts.count(p) == 8 for p in parts)
    inputs = spark.range(20).select(F.col("id").alias("pos"), F.lit("p").alias("problem"), F.lit("s").alias("student_prompt"), F.struct(F.lit("P").alias("id")).alias("student_profile"), F.col("id").cast("string").alias("source_id"))
    made = workflows.make_dialogues(spark, inputs, TaskClient(), "t", str(tmp_path / "d"), spread=Spread(parts=4)).collect()
    assert len({r.conversation[1].thought_process for r in made}) == 4


def test_results_do_not_depend_on_the_parts(spark, tmp_path):
    inputs = spark.range(30).select(F.col("id").alias("pos"), F.concat(F.lit("problem "), F.col("id")).alias("problem"), F.lit("student").alias("student_prompt"), F.struct(F.lit("P").alias("id")).alias("student_profile"), F.col("id").cast("string").alias("source_id"))
    rows = [
        sorted(workflows.make_dialogues(spark, inputs, LengthClient(fail_in=11), "t", str(tmp_path / f"d{parts}"), wave=wave, spread=Spread(in_flight, parts)).collect())
        for parts, in_flight, wave in ((1, 1, 64), (8, 64, 64), (3, 2, 7))
    ]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 30


def test_time_falls_with_the_parts(spark, tmp_path):
    def seconds(name, spread):
        began = time.time()
        workflows.make_similar(spark, questions(spark, 48), TaskClient(0.2), "sys", str(tmp_path / name), spread=spread)
        return time.time() - began

    seconds("warm", Spread(64, 4))
    # 48 calls of 0.2 s: one at a time 9.6 s, four at a time 2.4 s
    assert seconds("four", Spread(4, 4)) < seconds("one", Spread(1, 1)) - 4


def test_the_limit_holds_over_all_tasks(spark):
    for in_flight, parts in ((64, None), (3, 8), (10, 4), (1, None)):
        tasks, each = Spread(in_flight, parts).plan(spark)
        assert 1 <= tasks * each <= in_flight


def test_waves_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("dialoom.sources.writers.MOST_WAVES", 4)
    seen = []
    todo = spark.range(50).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("key"))
    assert append_missing(spark, todo, str(tmp_path / "w"), "key", lambda d: d, wave=2, report=seen.append).count() == 50
    assert [r["rows"] for r in seen] == [13, 13, 13, 11]


# --- first successes --------------------------------------------------------


def counting(spark):
    """A filter that counts the rows it sees, in an accumulator."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def keep(pos):
        seen.add(1)
        return pos % 3 != 0

    return seen, keep(F.col("pos"))


def recorded_run(spark, asked):
    def run(rows):
        def calls(batches):
            for b in batches:
                for k in b.column(b.schema.get_field_index("pos")).to_pylist():
                    asked.add([k])
                yield b

        return rows.mapInArrow(calls, rows.schema).where("pos % 7 <> 0")

    return run


@pytest.fixture
def asked(spark):
    from pyspark.accumulators import AccumulatorParam

    class Lists(AccumulatorParam):
        def zero(self, value):
            return []

        def addInPlace(self, a, b):
            return a + b

    return spark.sparkContext.accumulator([], Lists())


def loop(n, limit, start=0):
    """The calls of a loop over single rows, and its results."""
    calls, got = [], []
    for k in range(start, n):
        if len(got) == limit:
            break
        if k % 3:
            calls.append(k)
            if k % 7:
                got.append(k)
    return calls, got


@pytest.mark.parametrize("n, limit, start", [(5000, 200, 0), (5000, 40, 200), (300, 200, 0), (100, 5, 99), (0, 5, 0), (50, 0, 0)])
def test_first_successes_make_the_calls_of_a_loop(spark, tmp_path, asked, n, limit, start):
    seen, keep = counting(spark)
    rows = spark.range(n).select(F.col("id").alias("pos")).repartition(3)
    got = first_successes(spark, rows, keep, str(tmp_path / "f"), limit, recorded_run(spark, asked), start=start)
    calls, want = loop(n, limit, start)
    assert sorted(r.pos for r in got.collect()) == want and got.columns == ["pos"]
    assert sorted(asked.value) == calls
    assert seen.value <= max(n - start, 0)  # no row is filtered twice


def test_sparse_positions(spark, tmp_path, asked):
    rows = spark.range(30).select((F.col("id") * 10_000_019).alias("pos"))
    seen = []
    got = first_successes(spark, rows, F.lit(True), str(tmp_path / "f"), 12, recorded_run(spark, asked), report=seen.append)
    want = [k * 10_000_019 for k in range(30) if k * 10_000_019 % 7][:12]
    assert sorted(r.pos for r in got.collect()) == want and seen[-1]["ranges"] < 60


def test_asking_ahead_takes_fewer_waves(spark, tmp_path, asked):
    rows = spark.range(5000).select(F.col("id").alias("pos"))
    run = lambda d: d.where("pos % 10 = 1")
    plain, ahead = [], []
    a = first_successes(spark, rows, F.lit(True), str(tmp_path / "a"), 50, run, report=plain.append).collect()
    b = first_successes(spark, rows, F.lit(True), str(tmp_path / "b"), 50, run, ahead=True, report=ahead.append).collect()
    assert sorted(a) == sorted(b) and len(a) == 50 and len(ahead) < len(plain)


def test_goes_on_behind_the_cursor(spark, tmp_path, asked):
    rows, path = spark.range(2000).select(F.col("id").alias("pos")), str(tmp_path / "f")
    keep = F.col("pos") % 3 != 0
    waves = []

    def fails(d):
        waves.append(1)
        if len(waves) == 3:
            raise RuntimeError("lost")
        return recorded_run(spark, asked)(d)

    with pytest.raises(RuntimeError):
        first_successes(spark, rows, keep, path, 300, fails)
    assert spark.read.json(cursor_path(path)).count() == 2
    got = first_successes(spark, rows, keep, path, 300, recorded_run(spark, asked), resume=True)
    calls, want = loop(2000, 300)
    assert sorted(r.pos for r in got.collect()) == want and sorted(asked.value) == calls
    # without resume it begins anew
    assert first_successes(spark, rows, keep, path, 10, recorded_run(spark, asked)).count() == 10


# --- recorded replies -------------------------------------------------------


def test_request_keys_agree(spark):
    messages = [[("system", "日本 \U0001f600"), ("user", "")], [("user", "1:x")], [("user", None)], []]
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(messages)], "k int, m array<struct<role:string,content:string>>")
    got = [r[0] for r in rows.orderBy("k").select(request_column("similar", F.col("m"))).collect()]
    assert got == [request_key("similar", [{"role": a, "content": b} for a, b in m]) for m in messages] and len(set(got)) == 4


def test_replay_by_a_join(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"p{k % 3}") for k in range(9)], "pos long, prompt string")
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    key = lambda p: request_key("t", [{"role": "user", "content": p}])
    replies = spark.createDataFrame([(key("p0"), "b"), (key("p0"), "a"), (key("p0"), None), (key("p1"), None)], "request string, reply string")
    got = ask(rows, ReplayTable(replies), "t", messages, 0.0)
    assert sorted((r.pos, r.reply, r.error) for r in got.collect()) == [(k, "a" if k % 3 == 0 else None, None if k % 3 == 0 else "no recorded reply") for k in range(9)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_evaluation_from_recorded_replies(spark, tmp_path):
    """Answers and verdicts that a first run was given, found again by a second."""
    originals = spark.createDataFrame([(f"k{p}", p, f"question {p}") for p in range(6)], "key string, place long, translated_question string")
    similar = spark.createDataFrame([(f"k{p}", "sq", "ss") for p in range(6)], "key string, similar_question string, similar_solution string")
    inputs = workflows.evaluation_inputs(originals, similar, presets.profiles(spark), presets.EVALUATION_PROMPT, presets.TEACHER_PROMPT)
    c = LengthClient(fail_in=5)
    first = workflows.evaluate(spark, inputs, c, c, c, presets.JUDGE_PROMPT, str(tmp_path / "a")).orderBy("pos").collect()
    second = spark.read.parquet(str(tmp_path / "a" / "phase2"))
    records = []
    for r in second.collect():
        question = workflows.WORDS["judge"].format(answer=r.phase2_student_answer, solution=r.similar_solution)
        for task, system, prompt in (("answer", r.transfer_system, r.prompt), ("judge", presets.JUDGE_PROMPT, question)):
            messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
            try:
                records.append((request_key(task, messages), c.complete(task, messages)))
            except CallFailed:
                records.append((request_key(task, messages), None))
    replay = ReplayTable(spark.createDataFrame(records, "request string, reply string"))
    again = workflows.evaluate(spark, inputs, c, c, replay, presets.JUDGE_PROMPT, str(tmp_path / "b"), answers=replay).orderBy("pos").collect()
    plain = lambda rows: [(r.pos, r.phase2_student_answer, r.phase2_is_correct, r.judge_reason.split("stub")[0].split("no rec")[0]) for r in rows]
    assert plain(again) == plain(first) and len(first) == 6


# --- embedded objects -------------------------------------------------------

PIECES = ["{", "}", "[", "]", '"teacher_utterance"', '"is_completed"', ":", ",", "true", "false", "null", '"words"', '"a\\"b"', "NaN", "1", " ", "\n", "\\ud800", '"\\ud83d\\ude00"', "x", '"x"', "é"]
GOOD = '{"teacher_utterance": "w", "is_completed": true}'


def by_python(text):
    try:
        words, done = parse_embedded(text)
    except (AttributeError, RecursionError):
        return None
    return as_text(words), bool(done)


def agree(spark, texts):
    texts = [t for t in texts if by_python(t) is not None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2)
    got = {r.k: (r.x.teacher_utterance, r.x.is_completed) for r in rows.select("k", embedded_reply("t").alias("x")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == by_python(t), t


def test_embedded_cases(spark):
    cases = ["", "words", "{", "}", "}{", "a } b { c", GOOD, f"so {GOOD} end", f"{GOOD} {GOOD}", f"{GOOD},{GOOD}", f"{GOOD}]x[{{}}", f'{GOOD},"x":{{}}', f'{GOOD}, "x": []}}']
    cases += ['{"teacher_utterance": 3}', '{"teacher_utterance": null, "is_completed": 1}', '{"is_completed": "yes"}', '{"a": NaN}', '{"a": 1, "a": 2, "teacher_utterance": "z"}', '{"teacher_utterance": "a\\ud800b"}', '{"teacher_utterance": "\\ud83d\\ude00"}']
    cases += ['{"teacher_utterance": "a\nb"}', "{'teacher_utterance': 'a'}", '{"teacher_utterance": "a",}', '{"is_completed": true, "list": [1, [2]]}', '{"x": {"teacher_utterance": "inner"}}', "{" * 50 + "}" * 50, '{"n": 1e999}', '{"n": 123456789012345678901234567890}', '{"teacher_utterance": "日本 }"} }']
    agree(spark, cases)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*PIECES, GOOD]), max_size=12).map("".join), min_size=60, max_size=60))
def test_embedded_fuzz(spark, texts):
    agree(spark, [t.replace("\\ud800", "\\\\ud800") if '"' not in t else t for t in texts])


def test_few_replies_go_to_python(spark):
    texts = [GOOD, f"so {GOOD}", "words", None, "{broken", "{broken}", '{"a": NaN}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(embedded_steps(F.col("t"))[1].alias("hard"))
    assert rows.agg(F.count_if("hard")).first()[0] == 2


# --- sources, counts and streams --------------------------------------------


def test_parquet_positions(spark, tmp_path):
    for k, name in enumerate(("b", "a", "c")):
        rows = spark.range(k * 1000, k * 1000 + 700).select(F.concat(F.lit(f"{name}"), F.col("id")).alias("problem"), F.lit(7).alias("pos")).coalesce(1)
        rows.write.option("parquet.block.size", 2000).option("parquet.page.size", 500).parquet(str(tmp_path / name))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = read_parquet_rows(spark, [str(tmp_path / x) for x in "cab"])
        assert got.rdd.getNumPartitions() > 3
        rows = got.orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"a{k}" for k in range(1000, 1700)] + [f"b{k}" for k in range(700)] + [f"c{k}" for k in range(2000, 2700)]
    assert [r.pos for r in rows] == list(range(2100)) and [r.problem for r in rows] == want
    filled = read_problems(spark, str(tmp_path / "a"), kind="parquet").where("pos = 0").first()
    assert (filled.problem, filled.solution, filled.type, filled.level) == ("a1000", "", "unknown", "unknown")


def test_prompts_from_any_store(spark, tmp_path):
    from dialoom.sources.scratch import fresh_path

    path = f"{fresh_path(spark, 'prompt')}/p.txt"
    write_text(spark, path, "Hallo {X}\n日本")
    assert read_prompt(spark, path) == "Hallo {X}\n日本"
    with pytest.raises(FileNotFoundError, match="no prompt at"):
        read_prompt(spark, path + "x")
    with pytest.raises(IsADirectoryError):
        read_prompt(spark, path.rsplit("/", 1)[0])
    require(spark, path)
    with pytest.raises(FileNotFoundError, match="one.*two"):
        require(spark, path, "/nowhere/one", "/nowhere/two")


def test_counts_come_with_the_write(spark, tmp_path):
    rows = spark.createDataFrame([("as shown in the figure",), ("plain",), (None,), ("図に示す",)], "problem string")
    said = []
    progress = Progress(spark, lambda step, counts: said.append((step, counts)))
    assert workflows.clean_to(rows, str(tmp_path / "c"), progress) == {"initial": 4, "kept": 2, "removed": 2}
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2 and said == [("clean", {"initial": 4, "kept": 2})]


RECORD = StructType([StructField("id", StringType()), StructField("pos", LongType()), StructField("v", StringType())])


def test_streams_of_keyed_records(spark, tmp_path):
    folder, rows = str(tmp_path / "in"), [(f"k{n % 5}", n, f"v{n}") for n in (7, 3, 12, 1, 9, 30, 2, 22, 18, 5)]
    progress = Progress(spark)
    for part in (rows[:4], rows[4:7], rows[7:]):
        spark.createDataFrame(part, RECORD).coalesce(2).write.mode("append").json(folder)
        source = progress.watch_stream(record_stream(spark, folder, RECORD, max_files=1), "read", n=F.count("*"))
        last_wins_stream(source, F.col("id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = {}
    for key, pos, v in sorted(rows, key=lambda r: r[1]):
        want[key] = (want.get(key, (pos,))[0], pos, v)
    got = {r.key: (r.place, r.pos, r.v) for r in read_last_wins(spark, str(tmp_path / "out")).collect()}
    assert got == want
    for _ in range(50):
        if progress.streamed("read").get("n") == len(rows):
            break
        time.sleep(0.1)
    assert progress.streamed("read") == {"n": len(rows)}
    progress.close()
    # a batch that is run again replaces itself: the checkpoint's last commit is lost, the batch comes again
    stream = lambda: batches_stream(record_stream(spark, folder, RECORD), str(tmp_path / "b"), str(tmp_path / "cp2"), lambda d: d.where("pos > 4")).awaitTermination()
    stream()
    for name in ("0", ".0.crc"):
        (tmp_path / "cp2" / "commits" / name).unlink(missing_ok=True)
    stream()
    assert sorted(r.pos for r in spark.read.parquet(str(tmp_path / "b")).collect()) == sorted(n for _, n, _ in rows if n > 4)
