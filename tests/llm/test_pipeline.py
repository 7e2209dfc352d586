"""The pipeline's stages against brute force, each on its own input."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from dialoom.llm import langid
from pyspark.sql import functions as F

from .fixtures import empty_documents, odd_documents
from .test_decontaminate import brute as contaminated
from .test_langid import FOREIGN
from .test_minhash import brute as near
from .test_packing import library_ids


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    names, functions = zip(*corpus_pipeline.STAGES)
    assert len(names) == 4
    one = functions[0](spark, docs, sf_dir)
    assert one.columns == docs.columns
    rows = one.collect()
    # no clean document goes: all of these have letters
    assert Counter(map(tuple, rows)) == Counter(map(tuple, docs.collect()))
    two = functions[1](spark, one, sf_dir)
    kept = {r[0] for r in near([(r.doc_id, r.text) for r in rows], 5, 80) if r[3]}
    rows = [r for r in rows if r.doc_id in kept]
    assert Counter(map(tuple, two.collect())) == Counter(map(tuple, rows)) and two.columns == docs.columns
    three = functions[2](spark, two, sf_dir)
    bad = {r[0] for r in contaminated([(r.doc_id, r.text) for r in rows], bench) if r[5]}
    rows = [r for r in rows if r.doc_id not in bad]
    assert bad and Counter(map(tuple, three.collect())) == Counter(map(tuple, rows)) and three.columns == docs.columns
    texts = {r.doc_id: r.text for r in rows}
    assert len(texts) == len(rows)
    at, held = (0, 0), Counter()
    for r in sorted(functions[3](spark, three, sf_dir).collect(), key=lambda r: (r.sequence_id, r.offset)):
        ids = library_ids(texts[r.doc_id])
        assert (r.sequence_id, r.offset) == at and r.doc_tokens == len(ids) and r.start == held[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        held[r.doc_id] += r.length
        at = (r.sequence_id, r.offset + r.length) if r.offset + r.length < 4096 else (r.sequence_id + 1, 0)
    assert held == {k: len(library_ids(t)) for k, t in texts.items()}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in rows}


def test_foreign_documents_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text rlike '[a-z]'")
    odd = docs.limit(len(FOREIGN)).select(*[F.col(c) for c in docs.columns]).collect()
    odd = spark.createDataFrame([(-1 - k, t, None, *r[3:]) for k, (t, r) in enumerate(zip(FOREIGN, odd))], docs.schema)
    left = corpus_pipeline.STAGES[0][1](spark, docs.union(odd), sf_dir).collect()
    assert {r.doc_id for r in left} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_odd_and_empty_tables(spark, sf_dir):
    docs, rows = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns and after.count() <= docs.count()
        assert stage(spark, empty_documents(spark), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty_documents(spark), sf_dir).count() == 0
    found = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).collect()
    assert all(r.text and langid.has_letter(r.text) for r in found)
    assert len(rows) > len(found)
