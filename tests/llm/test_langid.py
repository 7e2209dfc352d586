import math
import zlib
from collections import Counter

from dialoom.llm.common import id_crc
from dialoom.llm.langid import PLACES, drop_rejected, fit, has_letter, identify
from pyspark.sql import functions as F
from dialoom.llm.queries import op9_language_id

from .fixtures import empty_documents, odd_documents


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op9_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert not any(r.rejected for r in got)


def test_odd_rows(spark, sf_dir):
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), id_crc() % 4 != 2)
    docs, rows = odd_documents(spark)
    got = identify(docs, model).collect()
    assert len(got) == len(rows)
    none = sum(not any(c.isalpha() for c in r[1] or "") for r in rows)
    assert sum(r.lang_pred == "und" and r.score == 0 and r.rejected for r in got) == none
    assert identify(empty_documents(spark), model).collect() == []
    blank = fit(empty_documents(spark), id_crc() % 4 != 2)
    assert {r.lang_pred for r in identify(docs, blank).collect()} == {"und"}


def test_fit_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (fit(d, id_crc() % 4 != 2) for d in (docs, docs.repartition(7)))
    assert a.labels == b.labels and abs(a.centroids - b.centroids).max() < 1e-6


def vector(text, idf):
    """A text's trigrams by a plain loop over bytes: runs of letters between other characters."""
    def symbol(b):
        return b - 96 if 97 <= b <= 122 else b - 101 if b >= 128 else 0

    s = [symbol(b) for b in f" {text.lower()} ".encode()]
    tf = Counter()
    for a, b, c in zip(s, s[1:], s[2:]):
        if b:
            tf[(((a * 24317 + b) * 24317 + c) * 2654435769 % 2**32) >> 19] += 1
    v = {k: math.sqrt(n) * idf[k] for k, n in tf.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / size for k, x in v.items()}


def test_cosines_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, id_crc() % 4 != 2)
    assert max(k for k in vector("zz \U0010ffff \xff", [1.0] * PLACES)) < PLACES
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in identify(docs, model).collect():
        if not has_letter(texts[r.doc_id]):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        v = vector(texts[r.doc_id], model.idf)
        cosines = [sum(x * float(c[k]) for k, x in v.items()) for c in model.centroids]
        best = max(cosines)
        assert math.isclose(r.score, best, abs_tol=1e-4) and r.rejected == (r.score < model.least)
        assert best - cosines[model.labels.index(r.lang_pred) + cosines[model.labels.index(r.lang_pred) :].index(max(c for c, name in zip(cosines, model.labels) if name == r.lang_pred))] < 1e-4


FOREIGN = [
    "当前的研究表明这种方法在许多情况下都是有效的但是仍然需要进一步的验证和讨论",
    "Съешь же ещё этих мягких французских булок да выпей чаю потому что он горячий",
    "Η γλώσσα αυτή δεν υπάρχει στα δεδομένα και πρέπει να απορριφθεί από το μοντέλο",
    "xq zvwk qqzx jjkq wxzv kqxj zzqw vkxq jqzx",
]


def test_foreign_texts_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, F.lit(True))
    odd = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(FOREIGN)], "doc_id long, text string, known string, rejected string")
    assert [r.rejected for r in identify(odd, model).orderBy("doc_id").collect()] == [True] * len(FOREIGN)
    mixed = odd.select("doc_id", "text").union(docs.select("doc_id", "text").where("text rlike '[a-z]'"))
    assert drop_rejected(mixed, model).count() == mixed.count() - len(FOREIGN)
    assert drop_rejected(odd, model).columns == odd.columns


def test_sample_is_bounded_and_keeps_every_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = sorted({r.lang for r in docs.select("lang").distinct().collect() if r.lang})
    for same in (7, None):  # one id, or none, on all rows
        one = docs.withColumn("doc_id", F.lit(same).cast("long"))
        model = fit(one, F.lit(True), max_rows=40)
        assert sorted(set(model.labels)) == labels
    assert sorted(set(fit(docs, F.lit(True), max_rows=len(labels)).labels)) == labels
    try:
        fit(docs, F.lit(True), max_rows=len(labels) - 1)
        raise AssertionError("more labels than rows must be refused")
    except ValueError:
        pass
    # a row that repeats is learned from once
    many = docs.union(docs.where("doc_id = 3").crossJoin(spark.range(500)).select("doc_id", "text", "lang"))
    a, b = fit(docs, F.lit(True)), fit(many.repartition(5), F.lit(True))
    assert a.labels == b.labels and abs(a.centroids - b.centroids).max() < 1e-6
