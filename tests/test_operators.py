import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoom.operators import assign, metrics
from dialoom.operators.positions import hash_order, renumber


def test_last_wins(spark):
    rows = [(0, "a", None, "1"), (1, "", "s", "2"), (2, "a", None, "3"), (3, None, "s", "4"), (4, "b", "s", "5")]
    got = assign.last_wins(spark.createDataFrame(rows, "pos long, id string, source_id string, v string").repartition(3), assign.record_key())
    assert sorted((r.key, r.place, r.v) for r in got.collect()) == [("a", 0, "3"), ("b", 4, "5"), ("s", 1, "4")]


def presets(spark, n=3):
    return spark.createDataFrame([(k, f"p{k}") for k in range(n)], "ord long, id string")


def test_round_robin_uses_up_skipped_places(spark):
    rows = spark.createDataFrame([(k, None if k == 1 else "q") for k in range(5)], "pos long, q string")
    got = assign.round_robin(rows, presets(spark)).where("q is not null")
    assert sorted((r.pos, r.preset_id) for r in got.collect()) == [(0, "p0"), (2, "p2"), (3, "p0"), (4, "p1")]


def test_matched_rows_alone_move_the_counter(spark):
    left = spark.createDataFrame([(f"k{p}", p) for p in (0, 1, 5, 9)], "key string, place long")
    right = spark.createDataFrame([(f"k{p}", "x") for p in (0, 5, 9, 77)], "key string, v string")
    got = assign.round_robin_matched(assign.pair(left, right), presets(spark))
    assert sorted((r.place, r.preset_id) for r in got.collect()) == [(0, "p0"), (5, "p1"), (9, "p2")]


@pytest.mark.parametrize("n, begins, train", [(0, [], 0), (1, [0], 0), (10, [7, 3, 2, 8, 5, 6, 9, 4, 0, 1], 8), (184, [2, 14, 121, 145], 147), (37, None, 29)])
def test_seeded_split(spark, n, begins, train):
    df = spark.range(n).withColumnRenamed("id", "pos").repartition(3)
    got = sorted(((r.shuffled, r.pos, r.split) for r in assign.seeded_split(spark, df).collect()))
    order = list(range(n))
    random.Random(42).shuffle(order)
    assert [p for _, p, _ in got] == order and [s for s, _, _ in got] == list(range(n))
    if begins is not None:
        assert order[: len(begins)] == begins
    assert [x for _, _, x in got] == ["train"] * train + ["val"] * (n - train)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 5_000_000), max_size=60), st.integers(1, 5))
def test_positions_do_not_depend_on_partitions(spark, ids, parts):
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(parts)
    dense = {r.id: r.n for r in renumber(df, "id", "n", width=1000).collect()}
    assert dense == {i: k for k, i in enumerate(sorted(ids))}
    shuffled = {r.id: r.n for r in hash_order(df, 42, "id", "n").collect()}
    import hashlib

    order = sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert shuffled == {i: k for k, i in enumerate(order)}
    split = assign.hash_split(df, "id").groupBy("split").count().collect()
    assert {r[0]: r[1] for r in split}.get("train", 0) == int(len(ids) * 0.8)


def test_first_passing_and_overlap(spark):
    df = spark.range(1000).withColumnRenamed("id", "pos").repartition(7)
    a = assign.first_passing(df, F.col("pos") % 3 == 0, 100)
    b = assign.first_passing(df, F.col("pos") % 3 == 0, 40, start=200)
    assert [r.pos for r in a.orderBy("pos").collect()] == list(range(0, 300, 3))
    assert sorted(r.pos for r in assign.pool_overlap(a, b, "pos").collect()) == list(range(201, 300, 3))


TURNS = "array<struct<role:string>>"


def test_summary(spark):
    rows = [(True, [("teacher",), ("student",), ("teacher",)]), (None, None), (False, []), (True, [("student",)])]
    got = metrics.session_summary(spark.createDataFrame(rows, f"is_completed boolean, conversation {TURNS}")).first()
    assert tuple(got) == (4, 2, 50.0, 2, 0.5)
    none = metrics.session_summary(spark.createDataFrame([], f"is_completed boolean, conversation {TURNS}")).first()
    assert tuple(none) == (0, 0, None, 0, None)


def test_frequency_keeps_ties_in_order_and_report(spark):
    rows = [(0, 0, "Bored"), (0, 1, None), (1, 0, "Proud"), (1, 1, "Bored"), (2, 0, "Proud"), (2, 1, "Curious")]
    turns = spark.createDataFrame(rows, "session_pos long, turn_pos long, student_emotion string").repartition(4)
    table = metrics.emotion_frequency(turns)
    got = [(r.emotion, r.n) for r in table.orderBy("rank").collect()]
    assert got == [("Bored", 2), ("Proud", 2), ("Unknown", 1), ("Curious", 1)]
    summary = metrics.session_summary(spark.createDataFrame([(True, [("teacher",)])], f"is_completed boolean, conversation {TURNS}"))
    assert " - Bored: 2 (33.3 %)" in metrics.report_text(summary, table)


def test_transitions_and_models(spark):
    rows = [(1, 0, "Frustrated"), (1, 1, "Engaged"), (1, 2, "Frustrated"), (1, 3, "Bored"), (2, 0, "Engaged")]
    got = metrics.emotion_transitions(spark.createDataFrame(rows, "session long, turn long, student_emotion string")).collect()
    assert sorted((r.from_emotion, r.to_emotion, r.n, r.probability) for r in got) == [("Engaged", "Frustrated", 1, 1.0), ("Frustrated", "Bored", 1, 0.5), ("Frustrated", "Engaged", 1, 0.5)]
    results = spark.createDataFrame([("a", True, False), ("a", False, False), ("b", True, True)], "model string, phase1_is_completed boolean, phase2_is_correct boolean")
    assert tuple(metrics.compare_models(results, "a", "b").first()) == (0.5, 0.0, 1.0, 1.0, 0.5, 1.0)
