import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from andamio.llm import common, exact_dedup
from tests.llm.fixtures import LONG, ODD, docs


def lower(text):
    return (text or "").translate(str.maketrans(common.UPPER, common.LOWER))


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    return Counter((i, max((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids), groups


def test_odd_rows_and_small_chunks(spark):
    want, groups = expected(ODD)
    for sizes in ((512, 8192), (4, 16), (1, 1)):
        out = exact_dedup.exact_duplicates(docs(spark, ODD), *sizes).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == want
        assert sum(r.kept for r in out) == len(groups)
        assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_chunks_join_to_the_text_and_are_local(spark):
    row = spark.createDataFrame([(LONG, "new start. " + LONG)], "a string, b string")
    a, b = row.select(exact_dedup.chunks_of(F.col("a"), 64, 512), exact_dedup.chunks_of(F.col("b"), 64, 512)).first()
    assert "".join(a) == LONG and "".join(b) == "new start. " + LONG
    assert len(set(a) & set(b)) > 0.9 * len(set(a))


def test_a_clash_of_identifiers_is_noticed(spark, monkeypatch):
    frame = docs(spark, [(1, "a" * 600), (2, "b" * 600)]).withColumn("norm", F.col("text"))
    assert exact_dedup.ids_are_verified(frame, 0)
    real = exact_dedup.chunk_id
    monkeypatch.setattr(exact_dedup, "chunk_id", lambda c, seed: F.lit(b"same") if seed == 0 else real(c, seed))
    assert not exact_dedup.ids_are_verified(frame, 0)
    out = exact_dedup.exact_duplicates(docs(spark, [(1, "a" * 600), (2, "b" * 600)])).collect()
    assert [r.group_size for r in out] == [1, 1]


def test_survivors_keep_their_columns(spark):
    frame = docs(spark, ODD)
    out = exact_dedup.keep_one_of_each(frame)
    assert out.columns == frame.columns
    got = Counter(lower(r.text) for r in out.collect())
    assert got == Counter({lower(t) for _, t in ODD})


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).collect() == []
    assert exact_dedup.keep_one_of_each(docs(spark, [])).collect() == []


def test_chunks_end_in_every_script(spark):
    rng = random.Random(3)
    japanese = "".join(chr(rng.randrange(0x3041, 0x3097)) for _ in range(140_000))
    texts = [japanese, "a" * 9_000 + " an english sentence of some words." * 20_000, "z" * 10_000_000, "".join(rng.choice("abcdefghij0123456789") for _ in range(50_000))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.chunks for r in frame.select("doc_id", exact_dedup.chunks_of(F.col("text")).alias("chunks")).collect()}
    for i, t in enumerate(texts):
        assert "".join(got[i]) == t and max(map(len, got[i])) <= exact_dedup.LONGEST + 2
    # The same chunks come behind another beginning.
    shifted = frame.filter("doc_id = 0").select(exact_dedup.chunks_of(F.concat(F.lit("いろは"), "text")).alias("chunks")).first()[0]
    assert len(set(shifted) & set(got[0])) > 0.9 * len(got[0])


def test_clashing_columns_survive(spark):
    frame = docs(spark, [(1, "one"), (2, "ONE"), (3, None)])
    for name in ("_sha", "_stays", "_row_sha", "row", "id", "sha", "stays", "stays_sha"):
        frame = frame.withColumn(name, F.lit(name))
    out = exact_dedup.keep_one_of_each(frame)
    assert out.columns == frame.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in frame.collect() if r.doc_id != 1)
