import random

from dialoom.llm.common import Scratch, components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root if find(x) != x}


def test_components(spark):
    draw = random.Random(1)
    chain = [(k, k + 1) for k in range(300)]
    edges = chain + [(1000, 1000 + k) for k in range(200)] + [(draw.randrange(2000, 2300), draw.randrange(2000, 2300)) for _ in range(150)] + [(5, 5), (7, 6), (6, 7)]
    draw.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    for limit in (500_000, 100):  # in one task, and in many
        got = components(Scratch(spark, "test"), df, part_edges=limit).collect()
        want = {x: r for x, r in brute(edges).items()}
        assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components(Scratch(spark, "test"), df.limit(0)).collect() == []
    words = spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")
    assert sorted(map(tuple, components(Scratch(spark, "test"), words).collect())) == [("b", "a"), ("c", "a")]
