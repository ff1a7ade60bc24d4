"""Landed pages in batches: few files, the same pages."""

import json

from andamio.plans import feeds
from andamio.plans.queries import QUERIES
from andamio.sources import landed


def test_few_files_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "new_folder", lambda session, what: f"file://{tmp_path}/{what}")
    assert QUERIES["landed_offsets"](spark, "/root/testdata/sf0.01").count() == 25
    assert 0 < sum(f.is_file() and f.name.startswith("part-") for f in tmp_path.rglob("*")) <= 8


def test_batches_are_pages(spark, tmp_path):
    texts = {("a", 1): '{"items": [{"id": 1}, {"id": 2}], "last": false}', ("a", 2): "<html>\nbusy</html>", ("a", 3): '{"items": [], "last": true}', ("b", 1): '{"items": [{"id": 3}]}'}
    for (category, page), text in texts.items():
        folder = tmp_path / "single" / f"category={category}" / f"page={page}"
        folder.mkdir(parents=True)
        (folder / "x.txt").write_text(text)
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "x.json").write_text("\n".join(json.dumps({"category": c, "page": p, "value": t}) for (c, p), t in texts.items()))
    read = lambda found: sorted(map(repr, found.collect()))
    single = read(landed.pages(spark, f"file://{tmp_path}/single", "struct<id: bigint>"))
    assert read(landed.batches(spark, f"file://{tmp_path}/many", "struct<id: bigint>")) == single and len(single) == 4
