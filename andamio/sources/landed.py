"""Pages of a supplier's listing as they were landed: ``category=NAME/page=7/`` with one JSON text each, or many pages in a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def pages(spark: SparkSession, path: str, item: str) -> DataFrame:
    """category, page, items (of DDL type ``item``), last, corrupt: a row for each file.

    A file is {"items": [...], "last": true or false}; one that is no such JSON is corrupt and
    has no items. Files are read whole, in parallel, by the executors.
    """
    rows = spark.read.schema("value string, category string, page int").text(path, wholetext=True)
    return _read(rows, item)


def batches(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The same of files in which every line is a page: {"category": ..., "page": 7, "value": its text as it came}.

    So files grow with what a file can hold, not with pages, and few are listed.
    """
    return _read(spark.read.schema("value string, category string, page int").json(path), item)


def _read(rows: DataFrame, item: str) -> DataFrame:
    schema = f"struct<items: array<{item}>, last: boolean>"
    rows = rows.withColumn("read", F.from_json("value", schema))
    empty = F.array().cast(f"array<{item}>")
    return rows.filter("page IS NOT NULL").select("category", "page", F.coalesce("read.items", empty).alias("items"), F.coalesce("read.last", F.lit(False)).alias("last"), F.col("read.items").isNull().alias("corrupt"))


def listed(found: DataFrame, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The items (category, page, item) of the pages that count, and each category's offset.

    A listing's pages are 1, 2, 3 and so on up to the page that says it is the last, or before the
    first empty or missing one: what lies behind is of an earlier run. A corrupt page is passed over
    and noted, the others stay. ``done`` (category, page) has the offsets of a run before:
    pages up to them are not listed again. Offsets: category, page (how far it is read), corrupt (the
    pages passed over), complete (whether the end was reached).
    """
    down = Window.partitionBy("category").orderBy("page")
    rows = found.groupBy("category", "page").agg(F.max_by("items", F.size("items")).alias("items"), F.max("last").alias("last"), F.min("corrupt").alias("corrupt"))
    start = F.lit(0)
    if done is not None:
        rows = rows.join(done.groupBy("category").agg(F.max("page").alias("start")), "category", "left").withColumn("start", F.coalesce("start", F.lit(0)))
        start = F.col("start")
    rows = rows.filter(F.col("page") > start).withColumn("nth", F.row_number().over(down))
    ended = F.coalesce(F.max(F.col("last").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    empty = F.max((~F.col("corrupt") & (F.size("items") == 0)).cast("int")).over(down) == 1
    missing = F.col("page") != F.col("nth") + start
    rows = rows.withColumns({"behind": ended | empty | missing, "empty": empty})
    counted = rows.filter("NOT behind")
    items = counted.select("category", "page", F.explode("items").alias("item"))
    reached = rows.groupBy("category").agg(F.max(F.when(~F.col("behind"), F.col("page"))).alias("page"), F.array_sort(F.collect_list(F.when(~F.col("behind") & F.col("corrupt"), F.col("page")))).alias("corrupt"), F.max((~F.col("behind") & F.col("last")) | (F.col("empty") & (F.col("page") == F.col("nth") + start))).alias("complete"))
    return items, reached
