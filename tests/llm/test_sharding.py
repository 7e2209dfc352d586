import bisect
import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

from dialoom.llm.sharding import place, shard
from pyspark.sql import functions as F

from .fixtures import empty_documents, odd_documents


def check(got, rows, shards):
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ideal, largest = sum(sizes.values()) / shards, max(r.size for r in got)
    assert all(abs(sizes[k] - ideal) <= largest for k in range(shards))


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    check(shard(docs, shards=4).collect(), [(r[0], r[1]) for r in rows], 4)
    assert shard(empty_documents(spark)).collect() == []


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(shard(docs, shards=10).collect(), [(r.doc_id, r.text) for r in docs.collect()], 10)


def test_hot_text_is_subdivided(spark):
    rows = [(k, "the same text" if k % 3 == 0 else f"text {k} " * (k % 7)) for k in range(3000)] + [(7, "the same text")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard(docs, shards=8, rows_per_range=100).collect()
    check(got, rows, 8)
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"the same text")}) > 1


def test_comparison_tree(spark):
    draw = random.Random(5)
    bounds = sorted({-(2**63), 2**63 - 1, 0, *(draw.randrange(-(2**63), 2**63) for _ in range(317))})
    keys = [k + d for k in bounds for d in (-1, 0, 1) if -(2**63) <= k + d < 2**63]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for some in ([], bounds[:1], bounds[:2], bounds):
        got = rows.select("k", F.expr(place("k", some, 0, len(some))).alias("n")).collect()
        assert len(got) == len(keys) and all(r.n == bisect.bisect_right(some, r.k) for r in got)


def test_places_by_running_sums(spark, sf_dir):
    """The shard of every record is that of the middle of its bytes on the line of all bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for shards in (1, 7, 40):
        got = sorted(shard(docs, shards=shards).collect(), key=lambda r: (r.shard, r.slot))
        ends = list(accumulate(r.size for r in got))
        assert [r.shard for r in got] == [min(shards - 1, (end - r.size + r.size // 2) * shards // ends[-1]) for r, end in zip(got, ends)]
