import random
import re
from itertools import combinations

import numpy as np
import pytest

from dialoom.llm import minhash
from dialoom.llm.minhash import drop_near_duplicates, near_duplicates

from .fixtures import empty_documents, odd_documents


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(docs, k, percent):
    """(id, set size, component, kept) by comparing all pairs that share a shingle."""
    sets = [(i, shingle_set(t, k)) for i, t in docs]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in sets:
        if i is not None and s:
            by.setdefault(s, []).append(i)
    for ids in by.values():
        for j in ids[1:]:
            a, b = find(ids[0]), find(j)
            root[max(a, b)] = min(a, b)
    where = {}
    for s in by:
        for x in s:
            where.setdefault(x, []).append(s)
    for pair in {frozenset(p) for ss in where.values() for p in combinations(ss, 2)}:
        x, y = pair
        if 100 * len(x & y) >= percent * len(x | y):
            a, b = find(by[x][0]), find(by[y][0])
            root[max(a, b)] = min(a, b)
    out = [(i, len(s), find(i) if i is not None and s else i) for i, s in sets]
    return sorted(((*r, r[0] == r[2]) for r in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_odd_rows(spark, k, percent):
    docs, rows = odd_documents(spark)
    assert rows_of(near_duplicates(docs, k, percent)) == brute([(r[0], r[1]) for r in rows], k, percent)
    assert near_duplicates(empty_documents(spark), k, percent).collect() == []
    kept = drop_near_duplicates(docs, k, percent)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(8) == 1 and 9 not in ids and ids.count(None) == 2 and {0, 1, 2} <= set(ids)


def copies(seed=5, groups=40, size=12):
    """Groups of near copies around the limit, some large, some of few words."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([4, 12, 60, 200]))]
        for _ in range(size if g else 150):
            words = list(base)
            for _ in range(draw.randrange(1 + len(base) // 20)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    draw.shuffle(rows)
    return rows


def test_links_near_the_limit(spark, monkeypatch):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 3, 85)
    assert rows_of(near_duplicates(docs, 3, 85)) == want
    # the same with bands that count as large from four classes on, in blocks of ten
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 10)
    monkeypatch.setattr(minhash, "PAIR_BLOCK", 10)
    monkeypatch.setattr(minhash, "LEADERS", 1)
    assert rows_of(near_duplicates(docs, 3, 85)) == want
    # and with every band of more than eight blocks divided by codes of other registers
    monkeypatch.setattr(minhash, "WIDE", 8)
    assert rows_of(near_duplicates(docs, 3, 85)) == want


def group(size, seed=2):
    """One large group of near copies around the limit: half of them too far from all others."""
    draw = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(5000)]
    base = [draw.choice(vocabulary) for _ in range(90)]
    rows = []
    for k in range(size):
        words = list(base)
        for at in draw.sample(range(90), 1 + k % 2 * 2 + draw.randrange(2)):
            words[at] = draw.choice(vocabulary)
        rows.append((k, " ".join(words)))
    return rows


def exact(rows, percent):
    """Components by all pairs of sets, as a product of matrices; and the number of links."""
    sets = [shingle_set(t, 3) for _, t in rows]
    place = {x: k for k, x in enumerate(sorted({x for s in sets for x in s}))}
    m = np.zeros((len(rows), len(place)), np.float32)
    for k, s in enumerate(sets):
        m[k, [place[x] for x in s]] = 1
    common = (m @ m.T).astype(np.int64)
    size = np.array(list(map(len, sets)))
    linked = 100 * common >= percent * (size[:, None] + size - common)
    root = np.arange(len(rows))
    while True:
        low = np.array([root[linked[k]].min() for k in range(len(rows))])
        if (low == root).all():
            return root, int(np.triu(linked, 1).sum())
        root = low


def test_a_large_group_makes_rows_in_proportion(spark, monkeypatch):
    """No table or join grows with the square of a group of near copies, and no class of it is lost."""
    made = {}
    write = minhash.Scratch.write
    monkeypatch.setattr(minhash.Scratch, "write", lambda self, df, name: made.__setitem__(name, (out := write(self, df, name)).count()) or out)
    counts = []
    for size in (1000, 2000):
        rows = group(size)
        made.clear()
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
        root, links = exact(rows, 85)
        found = sum(root[r.doc_id] == r.component_id for r in got)
        print(f"group of {size}: {links} links, {len(set(root.tolist()))} components, recall {found / size:.4f}")
        assert found == size and len(set(root.tolist())) > size // 10
        counts.append({k: made[k] for k in ("members", "marked_one", "marked_two", "links_one", "links_two")})
    # a class has a row for each of its bands; the blocks of a group of this size are one or two, so at most two copies of it are dealt
    assert counts[1]["members"] <= 2.2 * counts[0]["members"], counts
    for c in counts:
        assert c["marked_one"] <= 2 * c["members"] and c["marked_two"] <= 2 * c["members"] and c["links_two"] <= c["marked_two"], counts


@pytest.mark.parametrize("percent", [70, 80, 85, 90])
def test_pairs_at_the_limit_share_a_code_of_a_divided_band(percent):
    bands = minhash.BANDS
    count = bands * minhash.plan(percent)
    width = minhash.sub_plan(percent, count - count // bands)
    draw = np.random.default_rng(1)
    a = draw.integers(0, 60000, (20000, count)).astype(np.uint16)
    b = np.where(draw.random(a.shape) < percent / 100, a, a + np.uint16(1))
    x, y = (minhash.sub_codes(m, 3, bands, width)[0] for m in (a, b))
    assert (~(x == y).any(1)).sum() <= 3
    # the shared band is no part of the codes
    c = a.copy()
    c[:, 3 * count // bands : 4 * count // bands] += np.uint16(1)
    assert (minhash.sub_codes(c, 3, bands, width)[0] == x).all()


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    assert rows_of(near_duplicates(docs, 3, 85)) == want
    assert sum(not r[-1] for r in want) > 5
