import math

import numpy as np
import pytest

from dialoom.llm import whitening as module
from dialoom.llm.queries import QUERIES
from dialoom.llm.whitening import fit, identity_errors, joined_spread, one_sided_jacobi, spread, triangle, whiten


def brute(rows, k=8):
    """By covariance and eigenvectors, over vectors of one length: id -> (n, deviation, [|whitened|], [explained])."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows]
    x = np.array([v for _, v in kept])
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[: min(k, len(e))]
    order = [j for j in order if e[j] > e.max() * 1e-12]
    white = centred @ v[:, order] / np.sqrt(e[order])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums.tolist())) for row in x.tolist()]
    return {i: (n, d, w, e[order] / e.sum()) for (i, _), d, w in zip(kept, deviation, white)}


def agree(got, want):
    assert len(got) == len(want)
    signs = None
    for r in sorted(got, key=lambda r: r.vec_id):
        n, deviation, white, explained = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert np.allclose(r.explained, explained, rtol=1e-9)
        signs = np.sign(np.array(r.whitened) * white) if signs is None else signs
        assert np.allclose(np.array(r.whitened) * signs, white, atol=1e-6), (r.whitened, white)


@pytest.mark.parametrize("d", [1, 2, 5, 8, 33])
def test_rotations(d):
    draw = np.random.default_rng(d)
    r = triangle(draw.standard_normal((40, d)) * np.logspace(0, -9, d))
    sizes, v = one_sided_jacobi(r)
    assert np.allclose(sizes, np.linalg.svd(r, compute_uv=False), rtol=1e-10)
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13
    assert np.allclose(np.linalg.norm(r @ v, axis=0), sizes, rtol=1e-10)


def test_rotations_without_rank():
    sizes, v = one_sided_jacobi(np.zeros((3, 3)))
    assert (sizes == 0).all() and (v == np.eye(3)).all()
    sizes, _ = one_sided_jacobi(triangle(np.outer(np.arange(6.0), [1.0, 2.0, -1.0])))
    assert sizes[0] > 0 and (sizes[1:] < 1e-14 * sizes[0]).all()


def test_spreads_join():
    rows = np.random.default_rng(1).standard_normal((50, 3)) + 1000
    both = joined_spread(spread(rows[:20]), spread(rows[20:]))
    assert np.allclose(both, spread(rows), rtol=1e-9, atol=1e-8)


def test_table(spark, sf_dir, monkeypatch):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    for fan, block in ((64, 4096), (2, 7)):  # in one round of merging, and in several
        monkeypatch.setattr(module, "FAN", fan)
        monkeypatch.setattr(module, "BLOCK", block)
        rows = vectors.repartition(9)
        model = fit(rows)
        errors = identity_errors(rows, model)
        assert all(e < 1e-9 for e in errors.values())
        agree(whiten(rows, model, errors).collect(), want)
    listed = QUERIES["op11_whitening"](spark, sf_dir)
    assert listed.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = listed.collect()
    assert len(got) == 8 * len(want) and {r.component for r in got} == set(range(1, 9)) and len({r.identity_error for r in got}) == 1
    assert listed.schema["component"].dataType.simpleString() == "int" and listed.schema["n"].dataType.simpleString() == "bigint"


KINDS = "vec_id long, embedding array<float>, label int, n string, whitened int"


def test_odd_rows(spark):
    draw = np.random.default_rng(2)
    plain = [(k, [float(c) for c in draw.standard_normal(4)]) for k in range(30)]
    plain += [plain[0], plain[0]]  # repeated rows count each
    others = [(100 + k, [float(k), float(k * k)]) for k in range(5)]
    rows = [(i, v, 1, "x", 0) for i, v in plain + others]
    rows += [(200, None, 1, "x", 0), (201, [1.0, None, 2.0, 3.0], 1, "x", 0), (202, [1.0, math.nan, 2.0, 3.0], 1, "x", 0), (203, [math.inf, 1.0, 2.0, 3.0], 1, "x", 0)]
    rows += [(204, [], 1, "x", 0), (205, [7.0, 8.0, 9.0], None, None, None), (None,) * 5]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    model = fit(df)
    got = whiten(df, model, identity_errors(df, model)).collect()
    # a vector that is alone with its length has no direction
    assert [r.whitened for r in got if r.vec_id == 205] == [[]]
    agree([r for r in got if r.vec_id < 100], _with_repeats(plain))
    agree([r for r in got if 100 <= r.vec_id < 200], brute(others))
    assert {r.vec_id for r in got} == {i for i, _ in plain + others} | {205}


def _with_repeats(rows):
    class Rows(dict):
        def __len__(self):
            return len(rows)

    return Rows(brute(rows))


def test_null_ids_equal_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1, "x", 0), (1, [3.0, 2.0], 1, "x", 0)], KINDS)
    model = fit(df)
    got = whiten(df, model).collect()
    assert {r.vec_id for r in got} == {None, 1} and all(np.allclose(np.abs(r.whitened), [1.0]) and r.identity_error is None for r in got)
    equal = spark.createDataFrame([(k, [1.0, 2.0], 1, "x", 0) for k in range(3)], KINDS)
    assert [r.whitened for r in whiten(equal, fit(equal)).collect()] == [[]] * 3
    empty = df.limit(0)
    assert fit(empty) == {} and whiten(empty, {}).collect() == []


def test_what_leaves_its_bounds_fails(spark):
    with pytest.raises(Exception, match="too large"):
        fit(spark.createDataFrame([(1, [3e38, 1.0], 1, "x", 0)], KINDS))
    many = spark.createDataFrame([(k, [1.0] * k, 1, "x", 0) for k in range(1, 19)], KINDS)
    with pytest.raises(Exception, match="lengths"):
        fit(many)
