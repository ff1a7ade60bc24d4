"""Versions in buckets, landed pages and an index that follows its products."""

import json
import os

from andamio.operators import search, snapshots
from andamio.sources import landed

ROW = "supplier string, supplier_id string, name string, price double, brand string, seq int"


def rows(spark, *made):
    return spark.createDataFrame(list(made), ROW)


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_an_upsert_writes_what_its_batch_touches(spark, tmp_path):
    path = f"{tmp_path}/catalogue"
    first = rows(spark, *(("S", str(i), f"name {i} " * 30, 1.0, "B", 1) for i in range(2000)))
    snapshots.upsert(first, f"file://{path}", 0, None, 32)
    snapshots.upsert(rows(spark, ("S", "7", "new", 2.0, None, 1), ("S", "7", "newer", 3.0, None, 2), ("T", "1", "other", 4.0, None, 1)), f"file://{path}", 1, 0, 32)
    assert len([d for d in os.listdir(f"{path}/data/version=1") if d.startswith("bucket=")]) <= 2
    assert size_of(f"{path}/data/version=1") < size_of(f"{path}/data/version=0") / 8
    now = {(r.supplier, r.supplier_id): (r.name, r.price, r.brand) for r in snapshots.snapshot(spark, f"file://{path}", 1).collect()}
    assert len(now) == 2001 and now["S", "7"] == ("newer", 3.0, "B") and now["T", "1"] == ("other", 4.0, None) and now["S", "8"][1] == 1.0
    # The version before is still there, an empty batch adds a manifest, a repeated one changes nothing.
    assert snapshots.snapshot(spark, f"file://{path}", 0).count() == 2000
    snapshots.upsert(rows(spark), f"file://{path}", 2, 1, 32)
    assert not os.path.exists(f"{path}/data/version=2") and snapshots.snapshot(spark, f"file://{path}", 2).count() == 2001
    snapshots.upsert(rows(spark, ("S", "7", "newer", 3.0, None, 2), ("T", "1", "other", 4.0, None, 1)), f"file://{path}", 1, 0, 32)
    assert snapshots.snapshot(spark, f"file://{path}", 1).count() == 2001


def test_null_keys_and_an_empty_start(spark, tmp_path):
    path = f"file://{tmp_path}/catalogue"
    snapshots.upsert(rows(spark), path, 0, None, 4)
    assert snapshots.snapshot(spark, path, 0).collect() == []
    snapshots.upsert(rows(spark, (None, "1", "a", 1.0, None, 1), ("S", None, "b", 1.0, None, 1)), path, 1, 0, 4)
    assert sorted(r.name for r in snapshots.snapshot(spark, path, 1).collect()) == ["a", "b"]


def land(path, category, pages):
    for n, body in pages.items():
        folder = f"{path}/category={category}/page={n}"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/page.json", "w") as f:
            f.write(body if isinstance(body, str) else json.dumps({"items": [{"id": i} for i in body[0]], "last": body[1]}))


def test_listings_end_where_they_end(spark, tmp_path):
    land(tmp_path, "plain", {1: ([1, 2], False), 2: ([3], False)})
    land(tmp_path, "empty", {1: ([1], False), 2: ([], False), 3: ([9], False)})
    land(tmp_path, "last", {1: ([1], False), 2: ([2], True), 3: ([9], False)})
    land(tmp_path, "missing", {1: ([1], False), 3: ([9], False)})
    land(tmp_path, "corrupt", {1: ([1], False), 2: "<html>busy</html>", 3: ([3], True)})
    land(tmp_path, "late", {2: ([9], False)})
    found = landed.pages(spark, f"file://{tmp_path}", "struct<id: bigint>")
    items, offsets = landed.listed(found)
    got = {}
    for r in items.collect():
        got.setdefault(r.category, []).append(r.item.id)
    assert {c: sorted(x) for c, x in got.items()} == {"plain": [1, 2, 3], "empty": [1], "last": [1, 2], "missing": [1], "corrupt": [1, 3]}
    assert {r.category: (r.page, r.corrupt, r.complete) for r in offsets.collect()} == {
        "plain": (2, [], False), "empty": (1, [], True), "last": (2, [], True), "missing": (1, [], False), "corrupt": (3, [2], True), "late": (None, [], False),
    }
    # What was read before is not listed again; a page that came since is.
    land(tmp_path, "missing", {2: ([5], False)})
    again, _ = landed.listed(landed.pages(spark, f"file://{tmp_path}", "struct<id: bigint>"), offsets)
    assert sorted((r.category, r.item.id) for r in again.collect() if r.category in ("plain", "missing")) == [("missing", 5), ("missing", 9)]


SHELF = "id long, name string, category string, subcategory string"


def scores(spark, index, asked=("taladro", "broca roja", "disco 1.5")):
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    return sorted((r.query_id, r.id, r.score) for r in search.bm25(queries, index.postings, index.stats).collect())


def test_base_and_deltas_equal_a_rebuild(spark):
    base = [(i, f"taladro {'broca' if i % 2 else 'disco 1.5'} roja {i}", "Herramientas", None) for i in range(60)]
    first = [(3, "broca roja nueva", "Otra", None), (70, "disco 1.5", "Herramientas", None)]
    second = [(3, "taladro otra vez", None, None)]
    make = lambda r: spark.createDataFrame(r, SHELF)
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    parts = [search.index_of(make(base)), search.index_delta(make(first), gone(5, 6)), search.index_delta(make(second), gone(70))]
    now = {r[0]: r for r in base}
    for r in (*first, *second):
        now[r[0]] = r
    left = make([r for i, r in now.items() if i not in (5, 6, 70)])
    want = scores(spark, search.index_of(left))
    assert scores(spark, search.merged_index(parts)) == want and want
    assert scores(spark, search.compacted(parts)) == want
