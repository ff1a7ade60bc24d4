from collections import Counter

from pyspark.sql import functions as F

from andamio.llm import common, source_mix
from tests.llm.fixtures import ODD, docs

ROWS = (
    [(i, "w " * (50 + i % 7), "a") for i in range(120)]
    + [(200 + i, "x y z\t" * 30, "b") for i in range(40)]
    + [(300 + i, "q " * 400, None) for i in range(9)]
    + [(400, " one", "tiny"), (401, None, "tiny"), (401, None, "tiny"), (None, "p q r s", "tiny"), (500, "", "none")]
)


def water_fill(sizes):
    """Brute force: raise the level in small steps of exact re-sharing."""
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        level = left / sum(weights[s] for s in free) if free else 0
        over = [s for s in free if weights[s] * level >= 3 * sizes[s] and weights[s] * level > 0]
        new = {s for s in over if weights[s] * level > 3 * sizes[s]}
        if not new:
            return {s: float(3 * sizes[s]) if s in capped else weights[s] * level for s in sizes}
        capped |= new


def test_targets_sizes_and_caps(spark):
    out = source_mix.mix(docs(spark, ROWS), block_words=8, shard_slots=16).collect()
    sizes = Counter()
    for _, text, source in ROWS:
        sizes[source] += len((text or "").split())
    want = water_fill(dict(sizes))
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in ROWS)
    source = {r[0]: r[2] for r in ROWS}
    got = Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        got[s] += r.taken
    for s, t in want.items():
        assert got[s] == int(t + 0.5), (s, got[s], t)


def test_reruns_and_partitions_agree(spark):
    frame = docs(spark, ROWS)
    a = source_mix.mix(frame).collect()
    b = source_mix.mix(frame.repartition(7).orderBy(F.rand(1))).collect()
    assert Counter(a) == Counter(b)


def test_buckets_do_not_change_streams(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "BUCKET_ROWS", 10)
    rows = docs(spark, ROWS)
    sources, streams = source_mix.prepared(rows, 8, 7)
    for rank in {r["rank"] for r in sources.collect()}:
        at = 0
        for r in streams.filter((F.col("rank") == rank) & (F.col("size") > 0)).orderBy("start").collect():
            assert r.start == at
            at += r["size"]


def test_slots_are_each_dealt_once(spark):
    sources, _ = source_mix.prepared(docs(spark, ROWS), 8, 7)
    sources = {s["rank"]: s for s in sources.collect()}, sources
    deals = {}
    for seed, shard_slots in ((7, 16), (8, 16), (7, 40)):
        slots = source_mix.deal(sources[1], shard_slots, seed, 8).collect()
        deals[seed, shard_slots] = Counter((r.shard, r["rank"]) for r in slots)
        by_shard = Counter(r.shard for r in slots)
        total = sum(s.slots for s in sources[0].values())
        assert [by_shard[i] for i in range(len(by_shard))] == [min(shard_slots, total - i * shard_slots) for i in range(-(-total // shard_slots))]
        for rank, s in sources[0].items():
            own = sorted((r.k, r.block, r.words) for r in slots if r["rank"] == rank)
            assert [k for k, _, _ in own] == list(range(s.slots))
            for p in range(s.passes):
                assert sorted(b for _, b, _ in own[p * s.blocks : (p + 1) * s.blocks]) == list(range(s.blocks))
            assert sum(w for _, _, w in own) == int(s.target + 0.5)
    assert len({tuple(sorted(d.items())) for d in deals.values()}) == 3


def test_draws_are_multinomial(spark):
    sources, _ = source_mix.prepared(docs(spark, ROWS), 8, 7)
    slots = {s["rank"]: s.slots for s in sources.collect()}
    total, seen = sum(slots.values()), Counter()
    for seed in range(12):
        for r in source_mix.draws(sources, 50, seed).collect():
            seen[r["rank"]] += r.n
    assert sum(seen.values()) == 12 * total
    for rank, n in slots.items():
        p = n / total
        assert abs(seen[rank] - 12 * n) <= 4.5 * (12 * total * p * (1 - p)) ** 0.5 + 1


def test_permutations(spark):
    frame = spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 2, 3, 10, 97, 1000)))).alias("n"), F.array(*(source_mix.number(F.lit("k"), F.lit(r)) for r in range(12))).alias("keys"))
    rows = frame.select("n", "keys", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    got = rows.select("n", "i", source_mix.permuted(F.col("i"), F.col("n"), F.col("keys")).alias("at")).collect()
    for n in (1, 2, 3, 10, 97, 1000):
        at = [r.at for r in sorted(got) if r.n == n]
        assert sorted(at) == list(range(n))
    steps = Counter((b - a) % 1000 for a, b in zip(at, at[1:], strict=False))
    assert steps.most_common(1)[0][1] < 20  # not a stride


def test_clashing_columns_survive(spark):
    frame = docs(spark, ROWS[:20])
    for name in ("start", "_id", "copy", "spans", "_source", "_size", "_at", "_words", "_turn", "row", "id", "key", "shard", "whole"):
        frame = frame.withColumn(name, F.lit(name))
    out = source_mix.mixed_documents(frame, 8, 16)
    assert out.columns == frame.columns
    assert all(r.start == "start" and r._words == "_words" and r.shard == "shard" for r in out.collect())


def test_small_sources_meet_their_targets_to_the_word(spark):
    rows = [(i, "w " * 500, "big") for i in range(40)]
    rows += [(1000, "a b c d e f g h i j", "ten"), (1001, "p " * 33, "seventy"), (1002, "q " * 37, "seventy"), (1003, "r " * 100, "tail"), (1004, "lone", None)]
    rows += [(2000 + i, "v " * 97, "more") for i in range(30)]
    source = {r[0]: r[2] for r in rows}
    for frame in (docs(spark, rows), docs(spark, [r for r in rows if r[2] in ("more", "seventy", "tail")])):
        taken, target = Counter(), {}
        for r in source_mix.mix(frame).collect():
            taken[source[r.doc_id]] += r.taken
            target[source[r.doc_id]] = r.target
            assert r.taken <= 3 * r.size
        assert all(taken[s] == int(t + 0.5) for s, t in target.items()), (taken, target)
        got = Counter()
        for r in source_mix.mixed_documents(frame).collect():
            got[r.source] += len(r.text.split())
        assert got == taken


def test_mixed_documents_hold_the_taken_words(spark):
    frame = docs(spark, ROWS)
    out = source_mix.mixed_documents(frame, 8, 16)
    assert out.columns == frame.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in source_mix.mix(frame, 8, 16).collect():
        want[r.doc_id] += r.taken
    assert +got == +want


def test_odd_rows_and_empty_table(spark):
    out = source_mix.mix(docs(spark, ODD)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in ODD)
    assert sum(r.size for r in out) == sum(len([w for w in (t or "").split()]) for _, t in ODD)
    assert source_mix.mixed_documents(docs(spark, ODD), 8).count() > 0
    assert source_mix.mix(docs(spark, [])).collect() == []
    assert source_mix.mixed_documents(docs(spark, [])).collect() == []
    assert common.WORD
