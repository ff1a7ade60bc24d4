import math

import numpy as np
import pytest

from andamio.llm import whitening
from tests.llm.test_collision_ann import frame

NAN, INF = float("nan"), float("inf")


def brute(rows, components=4):
    """x by id, and the principal components of the distinct x by plain numpy."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in kept]
    fit = np.array(sorted({x for _, x in xs}), np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return xs, n, [int(s) for s in sums], values[order], vectors[:, order], values.sum()


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6)) @ rng.normal(size=(6, 6)) + [3, -200, 0, 1e4, 0, 0]
    rows = list(enumerate(x.tolist())) + [(7, x[8].tolist()), (None, x[9].tolist())]
    rows += [(2000 + i, x[0].tolist()) for i in range(500)]  # a third of all rows are one vector
    rows += [(3000, None), (3001, [1.0, None, 0, 0, 0, 0]), (3002, [NAN] * 6), (3003, [0, 0, 0, 0, 0, INF])]
    got = whitening.whitened_components(frame(spark, rows).repartition(7)).collect()
    xs, n, sums, values, vectors, trace = brute(rows)
    assert n == 900 and len(got) == 4 * len(xs)
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in xs)
    for k in range(4):
        mine = {r.vec_id: r for r in got if r.component == k + 1}
        want = {i: float((np.array(v) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k])) for i, v in xs}
        sign = 1 if mine[1].whitened * want[1] > 0 else -1
        for i, w in want.items():
            if i != 7:  # an id of two vectors
                assert mine[i].whitened == pytest.approx(sign * w, abs=1e-9)
        assert {r.n for r in mine.values()} == {900}
        assert mine[1].explained == pytest.approx(values[k] / trace, rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_merging_equals_the_whole():
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, size=(500, 5))
    parts = [whitening.Moments.of(p) for p in np.split(x, [1, 2, 100, 350])]
    whole, merged = whitening.Moments.of(x), parts[0]
    for p in parts[1:]:
        merged = merged.merged(p)
    assert merged.n == 500 and merged.sums == whole.sums == x.sum(0).tolist()
    assert np.allclose(merged.mean, whole.mean, rtol=1e-13) and np.allclose(merged.scatter, whole.scatter, rtol=1e-12)


def test_odd_tables(spark):
    assert whitening.whitened_components(frame(spark, [])).collect() == []
    assert whitening.whitened_components(frame(spark, [(1, None), (2, []), (3, [None])])).collect() == []
    one = whitening.whitened_components(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    # Two vectors: one component has variance; a shorter vector has zeros behind.
    two = whitening.whitened_components(frame(spark, [(1, [1.0, 0.0, 0.0]), (2, [3.0])])).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in two) == [(i, c, c > 1) for i in (1, 2) for c in (1, 2, 3)]
    assert {abs(r.whitened) for r in two if r.component == 1} == {1.0} and {r.explained for r in two if r.component == 1} == {1.0}


def test_deviations_are_exact_or_null(spark):
    huge = whitening.whitened_components(frame(spark, [(1, [3e7, 1.0]), (2, [0.0, 2.0]), (3, [3e38, 0.0]), (4, [-3e38, 0.0])])).collect()
    assert {r.vec_id for r in huge if r.deviation is None} == {1, 2, 3, 4}
    fine = whitening.whitened_components(frame(spark, [(1, [1e6, 1.0]), (2, [0.0, 2.0])])).collect()
    assert {r.deviation for r in fine} == {256_000_000**2 + 256**2}
