import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from andamio.llm import byte_shards
from tests.llm.fixtures import ODD, docs


def brute(rows, shards):
    """doc_id, size, crc, shard, slot by one loop over the sorted rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    sizes = [len((t or "").encode()) + 16 for _, t in rows]
    total, before, out, held = sum(sizes), 0, [], Counter()
    for (i, t), size in zip(rows, sizes, strict=True):
        shard = (2 * before + size) * shards // (2 * total)
        out.append((i, size, zlib.crc32((t or "").encode()), shard, held[shard]))
        held[shard] += 1
        before += size
    return sorted(out, key=str)


MANY = [(i * 37 % 1000, f"text {i % 11} " * (i % 29)) for i in range(700)] + [(5, "the same")] * 400 + [(4, "é" * 9)] * 3


@pytest.mark.parametrize("rows", [ODD, MANY, [(1, None)], [(1, "x"), (2, "y" * 100_000)]])
@pytest.mark.parametrize("shards", [1, 7, 40])
def test_against_brute_force(spark, rows, shards):
    out = byte_shards.placed(docs(spark, rows).repartition(5), shards, partition_rows=50).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out), key=str) == brute(rows, shards)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}


def test_shards_are_gapless_and_near_equal(spark):
    out = byte_shards.placed(docs(spark, MANY), 12, partition_rows=64).collect()
    slots, held = defaultdict(list), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest, target = max(r.size for r in out), sum(held.values()) / 12
    assert set(held) == set(range(12)) and all(abs(b - target) <= longest for b in held.values())


def test_odd_tables(spark):
    assert byte_shards.placed(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        byte_shards.placed(docs(spark, []), 0)


def test_documents_keep_their_columns(spark):
    frame = docs(spark, MANY + ODD)
    for name in ("shard", "slot", "row", "key", "nth", "a.b", "a`b", "sha"):
        frame = frame.withColumn(name, F.lit(name))
    for rows in (frame, frame.dropDuplicates(["doc_id", "text"])):
        out = byte_shards.sharded_documents(rows, 9)
        assert out.select("row.*").columns == rows.columns
        got = out.collect()
        assert Counter(tuple(r.row) for r in got) == Counter(tuple(r) for r in rows.collect())
        assert Counter((r.row.doc_id, r.shard, r.slot) for r in got) == Counter((r.doc_id, r.shard, r.slot) for r in byte_shards.placed(rows, 9).collect())


def test_written_shards(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    manifest = byte_shards.write_shards(docs(spark, MANY), path, 6).collect()
    back = spark.read.parquet(path)
    assert {r.shard: (r["rows"], r["bytes"]) for r in manifest} == {r.shard: (r.n, r.b) for r in back.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 16).alias("b")).collect()}
    assert back.select("doc_id", "shard", "slot").distinct().count() == len(MANY)
