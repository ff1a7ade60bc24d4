import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from andamio.llm import va_codes
from tests.llm.test_collision_ann import frame

NAN = float("nan")


def brute(rows, parts=8, entries=16, rounds=6):
    """The contract by plain loops over (vec_id, vector, label)."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v, _ in kept) // parts
    cut = [(i, [[math.floor(4096 * float(np.float32(c))) for c in v[p * width : (p + 1) * width]] for p in range(parts)], label) for i, v, label in kept]
    cut.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[r[1][p] for r in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(r[1][p], books[p])[1] for r in cut]
            for e in range(len(books[p])):
                mine = [r[1][p] for r, o in zip(cut, of, strict=True) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out, labels = [], {}
    for i, ps, label in cut:
        best = [nearest(ps[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        labels[label] = labels.get(label, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, error, labels[label], sha) for i, code, error, label in out), key=str)


def table(spark, rows):
    made = spark.createDataFrame([(i, v, label, "c", 5) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    return made.withColumn("of", F.lit("clash")).withColumn("a.b", F.lit(1))


def got(frame, **how):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in va_codes.compressed(frame, **how).collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    x[40:60] = x[3]  # copies among the many and ties between entries
    x[5] = x[2]
    rows = [(i, v.tolist(), None if i % 7 == 0 else i % 3) for i, v in enumerate(x)]
    rows += [(9, x[100].tolist(), 1), (None, x[101].tolist(), None), (900, None, 1), (901, [None] * 24, 1), (902, [NAN] * 24, 1)]
    rows += [(1000 + i, x[7].tolist(), 2) for i in range(150)]
    assert got(table(spark, rows).repartition(5)) == brute(rows)


def test_few_rows_odd_lengths_and_large_numbers(spark):
    rows = [(3, [1.0] * 8, None), (1, [2.5] * 8, 4), (2, [2.5] * 8, 4)]
    assert got(table(spark, rows)) == brute(rows)
    padded = [(1, [1.0, 2.0] + [0.0] * 6, 1), (2, [3.0] * 8, 1)]
    assert got(table(spark, [(1, [1.0, 2.0], 1), (2, [3.0] * 8, 1)])) == brute(padded)
    large = [(i, [1e4 * i * (-1) ** i] * 8, 1) for i in range(40)]
    assert got(table(spark, large)) == brute(large)


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 2)], [(1, [None], 2)]):
        out = va_codes.compressed(table(spark, rows))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.collect() == []


def test_the_filter_is_exact_and_filters():
    rng = np.random.default_rng(4)
    for _ in range(20):
        entries = rng.integers(-50, 50, size=(16, 8)) * int(rng.integers(1, 100))
        entries[9] = entries[4]
        points = np.concatenate([rng.integers(-50, 50, size=(200, 8)) * 50, entries])
        distances = ((points[:, None, :] - entries[None]) ** 2).sum(2)
        cells = va_codes.Cells(entries)
        lower, upper = cells.bounds(points)
        assert (lower <= distances).all() and (distances <= upper).all()
        entry, least, refined = cells.nearest(points)
        assert (entry == distances.argmin(1)).all() and (least == distances.min(1)).all()
        assert refined < 0.8 * distances.size
        # The same in Python's own whole numbers, where longs would overflow.
        entry, least, _ = va_codes.Cells(entries.astype(object) * 10**12).nearest(points.astype(object) * 10**12)
        assert (entry == distances.argmin(1)).all() and least.tolist() == [int(d) * 10**24 for d in distances.min(1)]
