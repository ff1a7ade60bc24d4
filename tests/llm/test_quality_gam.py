import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from andamio.llm import quality_gam
from tests.llm.fixtures import ODD, docs


def corpus(n):
    rows, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        words = [f"word{(i * 7 + k) % 50}" for k in range(20 + i % 30)]
        rows.append((i, " ".join(words) if good else " | ".join(w.upper() for w in words)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_fold(spark):
    rows, labels = corpus(400)
    frame = docs(spark, rows)
    out = quality_gam.judge(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == 400
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.predicted == labels[r.doc_id][1]


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rows, labels = corpus(300)
    frame = docs(spark, rows)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = (quality_gam.judge(frame, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect() for x in (labels, turned))
    assert Counter(a) == Counter(b)


def test_tables_add_up():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction only
    model = quality_gam.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert {(i, j) for i, j, _ in model.pairs} >= {(0, 1)}
    one = x[:1]
    b = model.bins(one)[0]
    by_hand = model.start + sum(t[b[i]] for i, t in enumerate(model.single)) + sum(t[b[i], b[j]] for i, j, t in model.pairs)
    assert abs(by_hand - model.margin(one)[0]) < 1e-12


def test_odd_rows_and_few_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 0), (3, None, 1), (1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_gam.judge(docs(spark, ODD), labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in ODD)
    none = quality_gam.judge(docs(spark, ODD), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_gam.judge(docs(spark, []), labels).collect() == []
    kept = quality_gam.accepted(docs(spark, ODD), labels.limit(0))
    assert kept.columns == docs(spark, ODD).columns and kept.count() == len(ODD)
    assert quality_gam.judge(docs(spark, ODD), labels, 1).agg(F.count("*")).first()[0] == len(ODD)


def test_query_against_brute_force(spark, tmp_path):
    rows, labels = corpus(200)
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    learnt = [(i, t, labels[i][1]) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    # The order of the rows changes sums of floats only in their last digits.
    model = quality_gam.fit(np.array([quality_gam.features(t) for _, t, _ in learnt]), np.array([float(q) for _, _, q in learnt]))
    got = {r.doc_id: r for r in quality_gam.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = 1 / (1 + np.exp(-np.clip(model.margin(np.array([quality_gam.features(t)])), -30, 30)))[0]
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(want >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_clashing_columns_survive(spark):
    rows, labels = corpus(60)
    frame = docs(spark, rows).withColumn("_score", F.lit(-5.0)).withColumn("score", F.lit(-6.0)).withColumn("row", F.lit("r"))
    out = quality_gam.accepted(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == frame.columns and {(r._score, r.score, r.row) for r in out.collect()} == {(-5.0, -6.0, "r")}
