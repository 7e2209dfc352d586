import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import pyarrow as pa

from dialoom.llm.lm_score import (
    OCTAVES,
    SENT_KINDS,
    SENT_NAMES,
    STEPS,
    Exchange,
    Node,
    _ending,
    _forwarding,
    _sent,
    _table,
    bigrams,
    context_bucket,
    fold_of,
    learn_weights,
    pack_counts,
    pack_keys,
    score,
    unpack_counts,
    unpack_keys,
)

from .fixtures import empty_documents, odd_documents


def toks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


def count(docs):
    one, two, start = Counter(), Counter(), 0
    for _, t in docs:
        w = toks(t)
        one.update(w)
        two.update(zip(["<s>", *w], w))
        start += 1
    return one, two, start


def brute(docs):
    train = [d for d in docs if crc(d[0]) % 10 != 0]
    one, two, start = count(train)
    n, v = sum(one.values()), len(one)
    folded = [d for d in train if crc(d[0]) % 10 == 1]
    f1, f2, fs = count(folded)
    nf, cells = sum(f1.values()), Counter()

    def step(p):
        return int(np.clip(np.round(STEPS * (np.log2(p * (v + 1)) + OCTAVES // 2)), -1, STEPS * OCTAVES)) if p > 0 else -1

    context = lambda c, s, w: s if w == "<s>" else c[w]
    for _, t in folded:
        w = toks(t)
        for a, b in zip(["<s>", *w], w):
            cv = context(one, start, a) - context(f1, fs, a)
            c2 = two[a, b] - f2[a, b]
            cells[int(context_bucket(np.array([cv]))[0]), step((one[b] - f1[b]) / max(n - nf, 1)), step(c2 / cv if cv > 0 else 0)] += 1
    x = learn_weights(cells)
    out = []
    for i, t in docs:
        w, base, total = toks(t), 0.0, 0.0
        for a, b in zip(["<s>", *w], w):
            cv = context(one, start, a)
            y = x[int(context_bucket(np.array([cv]))[0])]
            total += math.log10(y[0] / (v + 1) + y[1] * one[b] / max(n, 1) + y[2] * two[a, b] / max(cv, 1))
            base += math.log10((one[b] + 0.1) / (n + 0.1 * (v + 1)))
        out.append((i, len(w), sum(one[b] > 0 for b in w), n, base, total))
    return out


def same(got, want):
    key = lambda r: (repr(r[0]), r[1], r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9) and math.isclose(g[5], w[5], rel_tol=1e-6), (g, w)


def run(df, **options):
    return score(df, ~fold_of("doc_id", 10, 0), fold_of("doc_id", 10, 1), **options)


def test_odd_rows(spark, tmp_path):
    docs, rows = odd_documents(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = brute([(r[0], r[1]) for r in rows])
    same(run(docs).collect(), want)
    same(run(docs, block_bytes=5000).collect(), want)  # several blocks a partition
    same(run(docs, block_bytes=5000, fan=3).collect(), want)  # an exchange in four steps
    assert "spark.sql.files.minPartitionNum" not in spark.conf.getAll  # the session is left as it was
    assert run(empty_documents(spark)).collect() == []


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = run(docs).collect()
    same(got, brute([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in got if crc(r.doc_id) % 10 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_no_training_rows(spark):
    got = score(spark.createDataFrame([(10, "a b")], "doc_id long, text string"), fold_of("doc_id", 1, 5), fold_of("doc_id", 1, 5)).first()
    assert got.n_known == got.train_tokens == 0 and got.score == got.base_score == 0


def test_training_rows_but_none_held_out(spark, tmp_path):
    ids = [k for k in range(100) if crc(k) % 10 > 1][:4]
    rows = [(k, t) for k, t in zip(ids, ["the cat sat", "the cat ran", "the dog sat", "unlike words"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    got = {r.doc_id: r for r in run(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    # "the cat sat": 8 different words with the end, 15 in all; weights (0.1, 0.5, 0.4) in each seen context
    one, two = (3, 2, 2, 4), ((3, 4), (2, 3), (1, 2), (2, 2))
    want = sum(math.log10(0.1 / 9 + 0.5 * c / 15 + 0.4 * a / b) for c, (a, b) in zip(one, two))
    assert got[ids[0]].train_tokens == 15 and math.isclose(got[ids[0]].score, want, rel_tol=1e-9)
    same(got.values(), brute(rows))


def test_packed_keys():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (unpack_keys(pack_keys(keys)) == keys).all()
    assert (unpack_counts(pack_counts(np.arange(70_000))) == np.arange(70_000)).all()


def node(lists):
    """A node's table from (keys, counts) of its senders."""
    rows = [(0, 0, 2 * k, pack_keys(np.array(x, np.uint64)), pack_counts(np.array(n)), b"", 0) for k, (x, n) in enumerate(lists)]
    return _table(rows, SENT_NAMES, SENT_KINDS)


def test_counts_beyond_32_bits():
    large = 2**32 + 5
    assert unpack_counts(pack_counts(np.array([large, 0, 2**62]))).tolist() == [large, 0, 2**62]
    total, fold = Node(node([([3, 9], [large, 1]), ([9], [2**40])])).sums()
    assert total.tolist() == [large, 2**40 + 1] and fold.tolist() == [0, 0]
    got = _ending(True)(node([([3, 9], [large, 1]), ([9], [2**40])])).to_pylist()
    assert [unpack_counts(r["total"]).tolist() for r in got[:2]] == [[large, 2**40 + 1], [2**40 + 1]] and got[2]["tokens"] == large + 2**40 + 1


def exchanged(blocks, fan):
    """Lists that travel in each step for so many blocks, with buckets in proportion, and the sums at the end."""
    draw, ways = np.random.default_rng(3), Exchange(blocks * 100, bucket_bytes=100, fan=fan)
    sent, want = [], Counter()
    for block in range(blocks):
        h = draw.integers(0, 2**64, 400, dtype=np.uint64)
        h[:50] = np.arange(50, dtype=np.uint64) << np.uint64(58)
        want.update(h.tolist())
        batches = _sent(2 * block, [(h, bigrams(h, np.array([0, 400])), np.ones(400, bool))], ways)
        sent += [{**r, "group": block % ways.groups} for b in batches for r in b.to_pylist() if r["kind"] == 0]
    travelled = []
    for step in range(1, ways.steps + 1):
        travelled.append(len(sent))
        nodes = defaultdict(list)
        for r in sent:
            nodes[r["part"], r["group"]].append(r)
        tables = [_table([tuple(r[c] for c in SENT_NAMES) for r in rows], SENT_NAMES, SENT_KINDS) for rows in nodes.values()]
        if step < ways.steps:
            sent = pa.concat_tables([_forwarding(ways, step)(t) for t in tables]).to_pylist()
    got = Counter()
    for t in tables:
        n = Node(t)
        got.update(dict(zip(n.keys.tolist(), n.sums()[0].tolist())))
    assert got == want and len({r["part"] for r in sent}) == len(tables)
    return ways.steps, travelled


def test_records_grow_in_proportion():
    for blocks in (64, 128, 256):
        steps, travelled = exchanged(blocks, 8)
        assert steps > 1 and all(n <= 2 * 8 * blocks for n in travelled)
