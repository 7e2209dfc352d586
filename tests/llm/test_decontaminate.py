import hashlib
import re

from dialoom.llm.decontaminate import drop_contaminated, find_contamination

from .fixtures import empty_documents, odd_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            p = words(text)
            n = min(window, len(p))
            for a in range(len(p) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b] == p[a] and w[b : b + n] == p[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (3, "the the"),
    (10, "WORD"),
    (10, "café été"),
    (4, None),
    (5, " .,!"),
    (None, "123 456"),
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
]


def test_odd_rows(spark):
    docs, rows = odd_documents(spark)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    small = [(r[0], r[1]) for r in rows if len(r[1] or "") < 10_000]
    want = brute(small, ITEMS) + [(11, 30_000, 30_000, 1, hashlib.sha256(b"10").hexdigest(), True)]
    assert rows_of(find_contamination(docs, bench)) == sorted(want, key=repr)
    # a benchmark in several passes gives the same
    assert rows_of(find_contamination(docs, bench, pass_bytes=200)) == sorted(want, key=repr)
    assert find_contamination(empty_documents(spark), bench).collect() == []
    assert all(not r.contaminated for r in find_contamination(docs, bench.limit(0)).collect())
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[-1] for r in want)


def test_table(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert rows_of(find_contamination(docs, bench)) == want
    assert any(r[2] for r in want)
