"""The whole pipeline against brute force, stage by stage, on a small corpus."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from andamio.llm import quality_gam, shingle_join, source_mix, tokens
from tests.llm.fixtures import DOCS, ODD, docs
from tests.llm.test_exact_dedup import lower
from tests.llm.test_shingle_join import shingle_set


def corpus():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, labels = [], []
    for i in range(160):
        words = [word() for _ in range(rng.randint(20, 80))]
        good = i % 6 != 0
        rows.append((i, " ".join(words) if good else " | ".join(w.upper() + "!!" for w in words), f"src{i % 4}"))
        labels.append((i, int(good), 0))
        if i % 10 == 1:
            rows.append((1000 + i, rows[-1][1].upper() if i % 20 == 1 else rows[-1][1], "src0"))
        if i % 10 == 2 and len(words) > 45:
            rows.append((2000 + i, " ".join([*words[:-1], "changed"]), "src1"))
    return rows, labels


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_mix.mixed_documents, "__defaults__", (16, 64, source_mix.SEED))
    rows, labels = corpus()
    rows += [(5000, None, None), (5001, "", "src2")]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality_gam.train(read, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = lambda t: model.score(np.array([quality_gam.features(t)]))[0]
    kept = [r for r in rows if score(r[1]) >= 0.3]
    assert sum(l == 0 for i, l, _ in labels if i in {r[0] for r in kept}) == 0 and sum(l for _, l, _ in labels) == sum(r[0] < 1000 for r in kept)

    best = {}
    for r in kept:
        best[lower(r[1])] = max(best.get(lower(r[1]), -1), r[0])
    kept = [r for r in kept if best[lower(r[1])] == r[0]]

    sets = {r[0]: shingle_set(r[1]) for r in kept}
    gone = set()
    for a in kept:
        for b in kept:
            o = len(sets[a[0]] & sets[b[0]])
            if a[0] < b[0] and o and 100 * o >= 85 * (len(sets[a[0]]) + len(sets[b[0]]) - o):
                gone.add(b[0])  # every link here is to a smaller id that stays
    kept = [r for r in kept if r[0] not in gone]

    stages, got = [], read
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, got, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        stages.append(got.collect())
        if name == "near_copies":
            assert Counter(r.doc_id for r in stages[-1]) == Counter(r[0] for r in kept)
            assert {(r.doc_id, r.text) for r in stages[-1]} == {(r[0], r[1]) for r in kept}
    mixed, packed = stages[3], stages[4]
    near = docs(spark, kept)
    taken = {r.doc_id: r.taken for r in source_mix.mix(near, 16, 64).collect()}
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(r.text.split())
    assert +words == +Counter(taken)

    tok = Tokenizer.from_file(tokens.default_path())
    want = Counter()
    for r in mixed:
        ids = np.array(tok.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        want[r.doc_id, 0, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed) == want
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(whole) == Counter(packed)


def test_near_copies_keep_columns_and_odd_rows(spark):
    frame = docs(spark, ODD)
    out = shingle_join.keep_one_of_each(frame)
    assert out.columns == frame.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter({(1, ODD[0][1]): 1, (3, None): 1, (4, ""): 1, (5, ODD[4][1]): 1, (7, ODD[6][1]): 1, (7, ODD[8][1]): 1, (None, "no id"): 1, (None, None): 1, (8, ODD[11][1]): 1, (9, "one"): 1})
    assert shingle_join.keep_one_of_each(docs(spark, [])).collect() == []


def test_near_copies_link_from_four_fifths_of_five_word_shingles(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles of five words, 101 of four
    edit = lambda first, *at: " ".join(f"{first}{i}" if i in at else w for i, w in enumerate(words))
    # Edits take 10 of 100 shingles (90 / 110 = 0.818), and 12 (88 / 112 = 0.786); of four words 8 (93 / 109 = 0.853).
    rows = [(1, " ".join(words)), (2, edit("x", 30, 60)), (3, edit("y", 20, 50, 103, 102))]
    # The last 19 words replaced take 19 shingles at either length: 81 / 119 and 82 / 120.
    rows += [(4, " ".join([*words[:85], *(f"z{i}" for i in range(19))]))]
    # One edit inside and six at the end: 11 of 100 shingles (89 / 111 = 0.802), of four words 10 (91 / 111 = 0.82).
    other = [w.replace("w", "v") for w in words]
    rows += [(5, " ".join(other)), (6, " ".join(["u" if i == 40 else f"u{i}" if i >= 98 else w for i, w in enumerate(other)]))]
    frame = docs(spark, rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, frame, "").collect()) == [1, 3, 4, 5]
    assert sorted(r.doc_id for r in shingle_join.keep_one_of_each(frame).collect()) == [1, 3, 4, 5, 6]


def test_stages_return_documents(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.collect() == []


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Dots, backticks, blanks and names that the stages use themselves; repeated rows that differ elsewhere."""
    rows = [(i, f"plain words number {i} follow here and end well", "src0" if i % 3 else None) for i in range(40)] + [(3, "plain words number 3 follow here and end well", "other")]
    frame = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for name in ("a.b", "a`b", "with blank", "row", "nth", "id", "key"):
        frame = frame.withColumn(name, F.col("source"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_ = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        again = stage(spark, docs_, str(tmp_path))
        docs_ = stage(spark, docs_, str(tmp_path))
        assert docs_.columns == frame.columns, name
        assert sorted(map(str, docs_.collect())) == sorted(map(str, again.collect())) and docs_.count() > 0
    assert {r["a.b"] for r in docs_.collect()} <= {"src0", "other", None}


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), str(tmp_path)).collect() == []
