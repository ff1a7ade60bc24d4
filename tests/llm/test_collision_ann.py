import numpy as np
import pytest

from andamio.llm import collision_ann


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, rank int, score double")


def exact(rows, k=20):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            near = sorted((-float(v @ q), j) for j, v in rows if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_against_brute_force(spark, scale):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= rng.uniform(0.5, 1.5, size=(3000, 1))
    rows = list(enumerate(x.tolist()))
    out = collision_ann.nearest(frame(spark, rows), block_rows=700, query_rows=64).collect()
    want = exact(rows)
    assert {r.query_id for r in out} == set(want)
    hits = sum((r.vec_id, True) in {(j, True) for j, _ in want[r.query_id]} for r in out)
    assert hits >= 0.95 * sum(map(len, want.values()))
    by = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(float(np.float32(x[r.query_id]).astype(float) @ np.float32(x[r.vec_id]).astype(float)), rel=1e-12)
    for rs in by.values():
        assert [r.rank for r in rs] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)


def test_far_blocks_are_pruned(spark):
    """Vectors in clusters: most blocks are out of a query's reach, and nothing near is lost."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.repeat(centres, 60, axis=0) + rng.normal(size=(3600, 32)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x.tolist()))
    seen = []
    inner = collision_ann.searched

    def counted(data, visits, *others):
        seen.append((data.select("block", "part").distinct().count(), visits.count()))
        return inner(data, visits, *others)

    collision_ann.searched = counted
    try:
        out = collision_ann.nearest(frame(spark, rows), block_rows=300).collect()
    finally:
        collision_ann.searched = inner
    want = exact(rows)
    hits = sum(r.vec_id in {j for j, _ in want[r.query_id]} for r in out)
    assert hits >= 0.95 * sum(map(len, want.values()))
    (blocks, homes), (_, visits) = seen
    assert homes == 180 and blocks >= 16 and visits < 0.5 * blocks * homes


def test_odd_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [1, 1]), (2, [1, 1]), (3, [0, 0]), (4, None), (5, [1, None]), (6, [nan, 1]), (7, [inf, 1]), (None, [1, 1]), (8, []), (20, [-1, 2]), (40, [1, 2, 3]), (60, [3e38, 3e38])]
    out = [(r.query_id, r.rank, r.vec_id, r.score) for r in collision_ann.nearest(frame(spark, rows)).orderBy("query_id", "rank").collect()]
    good = [(i, v) for i, v in rows if i in (0, 1, 2, 20, 40, 60)]
    assert out == [(q, n + 1, j, s) for q, near in sorted(exact(good).items()) for n, (j, s) in enumerate(near)]


def test_one_vector_many_times(spark):
    rows = [(i, [0.6, 0.8, 0.0]) for i in range(300)] + [(1000 + i, [0.0, 0.1, 1.0 + i]) for i in range(30)]
    out = collision_ann.nearest(frame(spark, rows), block_rows=50).collect()
    want = exact(rows)
    for r in out:
        assert want[r.query_id][r.rank - 1][0] == r.vec_id


def test_empty_table(spark):
    assert collision_ann.nearest(frame(spark, [])).collect() == []
