import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from dialoom.llm.quality_rules import Condition, Rule, RuleList, cover, cut_back, fit, grow, judge, literals, rule_met, statistics
from dialoom.llm.queries import QUERIES

from .fixtures import empty_documents, odd_documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n_repeat = len(covered)
    failed = len(w) < 50 or 100 * n_repeat > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n_repeat, failed


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(got, rows):
    assert Counter((r.doc_id, *(r[c] for c in COUNTS)) for r in got) == Counter((i, *counts(t)) for i, t in rows)
    assert all(not r.kept for r in got if r.base_failed)


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    labels = spark.createDataFrame([(8, 1, 0), (9, 0, None), (None, 0, 0), (8, None, None), (777, 0, 1)], "doc_id long, quality int, toxic int")
    check(judge(docs, fit(docs, labels)).collect(), [(r[0], r[1]) for r in rows])
    empty = empty_documents(spark)
    assert fit(empty, labels) == RuleList() and judge(empty, RuleList()).collect() == [] and fit(docs, labels.limit(0)) == RuleList()


def test_repeats_and_lines(spark):
    draw = random.Random(3)
    texts = ["a b a b a b a b", "a a a a", "a a a", "x y z\nx y z\n\n \nx y z \nq", "one two", "\n", "a\x0bb\x0ca\rb a\tb", "é 中 文 é 中 文 ß"]
    texts += [" ".join(draw.choice("abcde") for _ in range(draw.randrange(90))) for _ in range(60)]
    rows = list(enumerate(texts))
    got = judge(spark.createDataFrame(rows, "doc_id long, text string"), RuleList()).collect()
    check(got, rows)
    assert all(r.kept != r.base_failed and r.rule is None for r in got)


def test_table_and_held_out_rows(spark):
    """Rules from labelled rows with odd ids, judged on those with even ids."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = fit(docs, labels.where("doc_id % 2 = 1"))
    assert rules.rules and all(r.right >= 5 for r in rules.rules) and rules.words
    rows = judge(docs.join(labels.where("doc_id % 2 = 0").select("doc_id"), "doc_id", "left_semi"), rules).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    poor = [r for r in rows if r.toxic == 0 and r.quality == 0]
    clean = [r for r in rows if r.toxic == 0 and r.quality == 1 and not r.base_failed]
    assert len(toxic) > 100 and len(poor) > 100 and len(clean) > 1000
    # words of other languages are each in a dozen rows; what shows up once in a sample cannot be learned from it
    assert sum(not r.kept for r in toxic) >= 0.8 * len(toxic)
    insults = [r for r in toxic if re.search("trash|pathetic|disgusting|idiot|worthless|stupid|clown|loser|scum|moron", r.text.lower())]
    assert len(insults) > 80 and sum(not r.kept for r in insults) >= 0.95 * len(insults)
    assert sum(not r.kept for r in poor) >= 0.9 * len(poor)
    assert sum(not r.kept for r in clean) <= 0.005 * len(clean)


def test_query_against_sql(spark):
    """The counts that do not depend on what was learned."""
    sf = "/root/testdata/sf0.001"
    sql = """WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    x AS (SELECT doc_id, k, w[k:k + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
    r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, x) AS n FROM x) WHERE n > 1),
    n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM r) GROUP BY doc_id),
    l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w)
    SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
     len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)"""
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    query = QUERIES["op12_quality_rules"](spark, sf)
    assert query.columns[:8] == ["doc_id", *COUNTS[:5], "base_failed", "kept"]
    assert sorted(tuple(r)[:6] for r in query.collect()) == sorted(connection.execute(sql).fetchall())


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rules = RuleList((Rule((Condition("symbols_per_word", True, 0.5), Condition("telling_words", True, 1.0)), 9, 0),), ("trash",))
    plan = judge(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- the learner ------------------------------------------------------------


def brute_gain(met, bad, rows):
    p, n = (rows & bad).sum(), (rows & ~bad).sum()
    out = []
    for k in range(met.shape[1]):
        r, w = (rows & bad & met[:, k]).sum(), (rows & ~bad & met[:, k]).sum()
        out.append(r * (np.log2(r / (r + w)) - np.log2(p / (p + n))) if r else -np.inf)
    return np.array(out)


@pytest.mark.parametrize("seed", range(4))
def test_growing_takes_the_largest_gain(seed):
    draw = np.random.default_rng(seed)
    met, bad = draw.random((200, 12)) < 0.5, draw.random(200) < 0.4
    rows = draw.random(200) < 0.8
    rule = grow(met, bad, rows, 4)
    for k in rule:
        gain = brute_gain(met, bad, rows)
        assert gain[k] == pytest.approx(gain.max())
        rows = rows & met[:, k]
    assert len(rule) <= 4


def test_cutting_back():
    # the second condition only fits the rows it was grown on
    met = np.array([[1, 1], [1, 0], [1, 0], [0, 0], [1, 0]], bool)
    bad = np.array([1, 1, 1, 0, 1], bool)
    assert cut_back([0, 1], met, bad, np.array([0, 1, 1, 1, 1], bool)) == ([0], 3, 0)


def test_covering_finds_a_planted_list():
    draw = np.random.default_rng(7)
    values = np.hstack([draw.random((3000, 3)), draw.random((3000, 1)) < 0.1])
    bad = ((values[:, 0] > 0.8) & (values[:, 1] < 0.5)) | (values[:, 3] > 0)
    conditions, met = literals(values, ["a", "b", "c", "told"], 40)
    checked = np.arange(3000) % 3 == 2
    rules = cover(conditions, met, bad, checked)
    got = np.zeros(3000, bool)
    for rule in rules:
        got |= met[:, [conditions.index(c) for c in rule.conditions]].all(1)
    assert (got & ~bad).sum() <= 10 and (got & bad).sum() >= 0.9 * bad.sum()  # thresholds lie on a grid of quantiles
    assert any(c == Condition("told", True, 1.0) for r in rules for c in r.conditions)
    # labels that say nothing give no rules
    assert cover(conditions, met, draw.random(3000) < 0.3, checked) == []
    assert cover(conditions, met, np.zeros(3000, bool), checked) == []


def test_words_that_a_group_of_copies_shares_are_not_learned(spark):
    draw = random.Random(1)
    plain = lambda: " ".join(draw.choice(["ba", "be", "bi", "bo", "bu"]) + draw.choice("lmnrst") + str(draw.randrange(9)) for _ in range(80))
    copied = plain() + " groupword othergroupword"
    rows = [(k, plain() + (" awful! " + plain() if k % 4 == 0 else "")) for k in range(200)] + [(1000 + k, f"{copied} awful {k}") for k in range(40)]
    labels = [(k, 1, int("awful" in t)) for k, t in rows]
    got = fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.words == ("awful",) and [r.conditions for r in got.rules] == [(Condition("telling_words", True, 1.0),)]


def test_list_as_an_expression(spark):
    first = Rule((Condition("symbols_per_word", True, 1.0), Condition("n_words", False, 3.0)), 1, 0)
    rules = RuleList((first, Rule((Condition("telling_words", True, 1.0),), 1, 0)), ("trash", "scum"))
    rows = [(1, "# # #"), (2, "# # # #"), (3, "such TRASH, he said"), (4, "trashy"), (5, None), (6, "x###Scum###")]
    counted = statistics(spark.createDataFrame(rows, "doc_id long, text string"), rules.words)
    assert {r.doc_id: r.k for r in counted.select("doc_id", rule_met(rules).alias("k")).collect()} == {1: 1, 2: None, 3: 2, 4: None, 5: None, 6: 2}
    assert str(first) == "symbols_per_word >= 1 and n_words <= 3  [1 right, 0 wrong]"
    # filters over the statistics don't make an array again for each element that reads it
    assert counted.where("n_repeat_words = 0").count() == 6
