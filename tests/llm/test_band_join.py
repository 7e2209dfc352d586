import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from dialoom.llm import band_join as module
from dialoom.llm.band_join import NO_LINE, band_join, first_of, reach

LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, rank string, p string, cell int"
ITEMS = "item_id long, price double, u string, gap int"


def brute(lines, items, first=10, apart=50, mille=5):
    def cents(x):
        return math.floor(100 * x + 0.5) if x is not None and math.isfinite(x) else None

    full = []
    for sale, line, item, q, amount, *_ in lines:
        if None in (sale, item, q, amount) or q == 0 or cents(amount) is None:
            continue
        u = (2 * cents(amount) + q) // (2 * q)
        text = f"{sale},{'' if line is None else line},{item}"
        full.append((u, sale, NO_LINE if line is None else line, item, zlib.crc32(text.encode())))
    rows = Counter()
    for item, price, *_ in items:
        p = cents(price) if item is not None else None
        pairs = [] if p is None else sorted((abs(x[0] - p), *x) for x in full if x[3] != item and (abs(x[0] - p) <= apart or 1000 * abs(x[0] - p) <= mille * min(x[0], p)))
        sums = (len(pairs), sum(x[0] for x in pairs), sum(x[5] for x in pairs))
        for k, (gap, u, sale, line, other, _) in enumerate(pairs[:first]):
            rows[(item, k + 1, gap, u, sale, None if line == NO_LINE else line, other, *sums)] += 1
        if not pairs:
            rows[(item, 0, None, None, None, None, None, 0, 0, 0)] += 1
    return rows


def made(seed, n, hot=True):
    draw = random.Random(seed)
    items = [(k, draw.choice([3.0, 4.0, 4.0, round(draw.uniform(0.5, 40), 2), round(draw.uniform(300, 400), 2)]), "x", 1) for k in range(60)]
    items += [(None, 3.0, "x", 1), (70, None, "x", 1), (71, -0.2, "x", 1), (72, 0.0, "x", 1), (73, float("nan"), "x", 1), (74, 9e6, None, None), items[0], items[0], items[1], (None, None, None, None)]
    lines = []
    for k in range(n):
        item = 7 if hot and draw.random() < 0.4 else draw.randrange(60)
        q = draw.randrange(1, 9)
        price = items[item][1] * draw.choice([1, 1, 1.001, 0.996, 1.2])
        lines.append((k // 4, k % 4, item, q, round(q * price, 2), "r", "p", 0))
    lines += lines[:40] + lines[:5] * 30
    lines += [(None, 1, 2, 1, 3.0, "r", "p", 0), (1, None, 2, 1, 3.0, "r", "p", 0), (1, 1, None, 1, 3.0, "r", "p", 0), (1, 1, 2, None, 3.0, "r", "p", 0), (1, 1, 2, 1, None, "r", "p", 0)]
    lines += [(5, 1, 2, 0, 3.0, "r", "p", 0), (5, 2, 2, -2, 3.01, "r", "p", 0), (5, 3, 2, 3, -1.0, None, None, None), (5, 4, 2, 1, float("inf"), "r", "p", 0), (None,) * 8]
    return lines, items


def check(spark, lines, items, **options):
    got = band_join(spark.createDataFrame(lines, LINES).repartition(3), spark.createDataFrame(items, ITEMS).repartition(2), **options)
    assert got.columns == ["item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc"]
    assert Counter(map(tuple, got.collect())) == brute(lines, items, options.get("first", 10))


def test_odd_rows_and_a_hot_item(spark):
    lines, items = made(3, 900)
    check(spark, lines, items)
    # many small blocks, chunks that cut prices, few first pairs
    check(spark, lines, items, first=2, item_block=3, line_block=2, chunk=50)


def test_empty_tables(spark):
    lines, items = made(4, 30)
    check(spark, [], items)
    check(spark, lines, [])
    check(spark, lines, [(1, None, None, None)])


def test_one_price(spark):
    """All lines of one item at one price, and one line of another among them."""
    lines = [(k, 1, 1, 1, 3.0, "r", "p", 0) for k in range(500)] + [(9999, 1, 2, 1, 3.3, "r", "p", 0)]
    check(spark, lines, [(1, 3.0, "x", 1), (2, 3.0, "x", 1), (3, 3.1, "x", 1)], chunk=64, line_block=1)


def test_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(module, "HOT", 3)
    lines, items = made(5, 300)
    check(spark, lines, items)


def test_reach_is_exact():
    p = np.array([-60, 0, 1, 49, 50, 10_000, 10_001, 123_457, 10**9])
    low, high = reach(p, 50, 5)
    for k, lo, hi in zip(p.tolist(), low.tolist(), high.tolist()):
        near = lambda u: abs(u - k) <= 50 or 1000 * abs(u - k) <= 5 * min(u, k)
        assert near(lo) and not near(lo - 1) and near(hi) and not near(hi + 1)


@pytest.mark.parametrize("seed", range(5))
def test_first_of_each_group(seed):
    draw = np.random.default_rng(seed)
    group, item, rank = draw.integers(0, 4, 300), draw.integers(0, 3, 300), draw.permutation(300)
    kept = first_of(group, item, np.lexsort((rank, group)), 4)
    for g in range(4):
        for left_out in range(4):
            want = [k for k in np.lexsort((rank, group)) if group[k] == g and item[k] != left_out][:4]
            assert [k for k in kept if group[k] == g and item[k] != left_out][:4] == want
    assert len(kept) <= 4 * 8
