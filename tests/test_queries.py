"""Every query with SQL against DuckDB on the same tables; every other one runs."""

import json
import math

import duckdb
import pytest

from dialoom.functions.text import parse_embedded
from dialoom.operators import assign
from dialoom.plans.queries import SQL, Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [tuple(float(f"{r[k]:.12g}") if isinstance(r[k], float) else r[k] for k in order) for r in rows]


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, sf_dir, duck, name):
    df = Q[name](spark, sf_dir)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    want = plain(result.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r]
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9)) for a, b in zip(g, w)), (g, w)
    if name not in ("pool_overlap", "offset_pool"):  # the smallest table ends before the second pool begins
        assert want


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert Q[name](spark, sf_dir).count() > 0


def test_embedded_json_reads_whole_texts(spark, tmp_path):
    long = "words of a tutor " * 50
    texts = ["short", long, f'{long}{{"teacher_utterance": "said \\" é", "is_completed": true}} end', f"{long}{{broken", f"{long}\n\t\"'\\ 中文 \u2028", ""]
    rows = [(k, texts[k % len(texts)], "s", "en") for k in range(5 * len(texts))]
    spark.createDataFrame([*rows, (30, None, "s", "en"), (31, None, "s", "en"), (34, None, "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def reply(k, text):
        good = json.dumps({"teacher_utterance": text, "is_completed": k % 2 == 0}, ensure_ascii=False)
        return (good, f"So: {good} done.", "{broken " + text, text + ' {"is_completed": true, "x": NaN}', text)[k % 5]

    got = {r.doc_id: (r.teacher_utterance, r.is_completed) for r in Q["embedded_json"](spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k < 30} == {k: parse_embedded(reply(k, text)) for k, text, *_ in rows}
    assert got[0] == ("short", True) and got[14] == ('said " é', True) and got[19][0] == texts[1]
    assert [got[k] for k in (30, 31, 34)] == [("", True), ("", False), (None, False)]
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in connection.execute(SQL["embedded_json"]).fetchall()} == got


@pytest.mark.parametrize("name, partners", [("pair_original_similar", "documents"), ("profile_assign_matched", "documents"), ("evaluation_stub", "benchmark")])
def test_all_partners_are_joined(spark, sf_dir, monkeypatch, name, partners):
    joined = []
    pair = assign.pair
    monkeypatch.setattr(assign, "pair", lambda left, right, *more: joined.append((left, right)) or pair(left, right, *more))
    assert Q[name](spark, sf_dir).count() > 0
    [(left, right)] = joined
    assert right.count() == spark.read.parquet(f"{sf_dir}/{partners}.parquet").count()
    assert left.join(right, "key", "left_anti").count() > 0  # rows without a partner are still shown


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
