import math

import numpy as np

from dialoom.llm.embeddings import near_vectors

KINDS = "vec_id long, embedding array<float>, label int, _id string, n_links int"


def brute(rows, cosine=0.93):
    ok = [i is not None and l is not None and v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) for i, v, l in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if k else None for k, (_, v, _) in zip(ok, rows)]
    links, root = [0] * len(rows), {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return sorted(((r[0], n, c := None if r[0] is None else find(r[0]), r[0] == c) for r, n in zip(rows, links)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows(spark):
    v = [1.0, 0.0, 0.0, 0.5]
    rows = [
        (1, v, 1), (2, v, 1), (2, v, 1), (3, [2 * x for x in v], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0] * 4, 1),
        (9, [1.0, None, 0.0, 0.0], 1), (10, [float("nan"), 1.0, 0.0, 0.0], 1), (11, [float("inf"), 1.0, 0.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, -0.0, 0.0, -0.5], 1),
        (None, v, 1), (None, None, None), (14, [3e38, 0.0, 0.0, 1.5e38], 1), (15, [1e-40, 0.0, 0.0, 5e-41], 1),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KINDS).repartition(3)
    assert rows_of(near_vectors(df)) == brute(rows)
    assert near_vectors(df.limit(0)).collect() == []


def test_clusters_and_a_hot_vector(spark):
    draw = np.random.default_rng(3)
    rows = []
    for c in range(40):
        centre = draw.standard_normal(16)
        for _ in range(300 if c == 0 else 6):
            rows.append((len(rows), (centre / np.linalg.norm(centre) + 0.06 * draw.standard_normal(16)).astype(np.float32).tolist(), c % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(200)]
    got, want = rows_of(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))), brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found >= 0.97 * there and all(g[1] <= w[1] for g, w in zip(got, want))


def test_recall_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got, want = rows_of(near_vectors(df)), brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
