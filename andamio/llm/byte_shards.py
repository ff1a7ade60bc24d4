"""Operator 13: shards of near-equal bytes by global prefix sums (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .source_mix import summed_before

#: Shards, and the bytes that a document takes beside its text.
SHARDS, OVERHEAD = 40, 16
#: Rows in a partition of the order, all of which one task sums up.
PARTITION_ROWS = 100_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, sha, size, text_crc32, times: documents that repeat id and text are one row here.

    A third of all rows may repeat one document: they are counted where they are read,
    so only one row for each task moves.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.sha2(text, 256).alias("sha"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.groupBy("doc_id", "sha", "size", "text_crc32").agg(F.count(F.lit(1)).alias("times"))


def in_order(rows: DataFrame, partition_rows: int) -> DataFrame:
    """Adds ``part``: partitions that follow each other in the order of doc_id (null first) and sha."""
    parts = max(1, -(-rows.count() // partition_rows))
    return rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "sha").withColumn("part", F.spark_partition_id())


def prefix_sums(rows: DataFrame) -> DataFrame:
    """Adds ``bytes_before`` and ``rows_before``: what all rows before this one add up to.

    Each partition's totals are summed over the partitions (a line for PARTITION_ROWS
    rows), and the rows within their partition.
    """
    taken = F.col("size") * F.col("times")
    totals = rows.groupBy("part").agg(F.sum(taken).alias("bytes"), F.sum("times").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_at") for c in ("bytes", "rows")))
    before = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "sha").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("bytes_in", F.coalesce(F.sum(taken).over(before), F.lit(0))).withColumn("rows_in", F.coalesce(F.sum("times").over(before), F.lit(0)))
    joined = summed.join(starts, "part")
    return joined.withColumn("bytes_before", F.col("bytes_at") + F.col("bytes_in")).withColumn("rows_before", F.col("rows_at") + F.col("rows_in")).drop("bytes_at", "rows_at", "bytes_in", "rows_in", "part")


def placed(docs: DataFrame, shards: int = SHARDS, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, sha, nth.

    Documents are in the order of doc_id (null ids first) and, for one id, of their text's
    sha256. All sizes are summed in that order and cut at equal targets: a document is
    in the shard in which its middle byte lies, so a shard differs from its target by no
    more than the longest document. Shards are contiguous in the order, ``slot`` counts
    from 0 in each. Null text counts as empty (size OVERHEAD, crc32 0). Rows that repeat
    id and text are documents of their own, next to each other. A shard may be empty where
    documents are few or longer than a target. No rows in, no rows out; other columns
    are ignored. The law is ``bytes``, so ``grown_shard`` is null.
    """
    if shards < 1:
        raise ValueError("there has to be a shard")
    rows = common.materialise(in_order(common.materialise(sizes(docs), "sizes"), partition_rows), "order")
    summed = common.materialise(prefix_sums(rows), "sums")
    total = summed.agg(F.coalesce(F.sum(F.col("size") * F.col("times")), F.lit(0))).first()[0]
    each = common.repeated(summed, "times").withColumn("begin", F.col("bytes_before") + (F.col("nth") - 1) * F.col("size"))
    # The middle of a document in half bytes, over a shard's target in half bytes.
    middle = F.expr(f"CAST((2 * begin + size) * CAST({shards} AS DECIMAL(10, 0)) DIV {max(1, 2 * total)} AS INT)")
    each = each.select("doc_id", "sha", "size", "text_crc32", "nth", (F.col("rows_before") + F.col("nth") - 1).alias("place"), middle.alias("shard"))
    first = each.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    each = each.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("first"))
    return each.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "sha", "nth")


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents, each as struct ``row`` with its columns under any names, with ``shard`` and ``slot``.

    Nulls, repeats and empty tables as in ``placed``. Rows that repeat id and text take the
    slots of their group by the partition that they are read from and a hash of the row.
    """
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)

    def key(doc_id: Column, text_sha: Column) -> Column:
        return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), text_sha)

    where = common.materialise(placed(docs, shards).select(key(F.col("doc_id"), F.col("sha")).alias("key"), "nth", "shard", "slot"), "placed")
    rows = docs.select(common.whole_row(docs).alias("row"), key(F.col("doc_id"), sha).alias("key"))
    if where.filter("nth > 1").take(1):
        rows = common.materialise(rows.withColumn("read_by", F.spark_partition_id()).withColumn("one", F.lit(1)), "rows")
        rows = _numbered(rows)
    else:
        rows = rows.withColumn("nth", F.lit(1).cast("long"))
    return rows.join(where, ["key", "nth"]).select("row", "shard", "slot")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``nth``: from 1 within a key. A key's rows are numbered by the partition that read them."""
    rows = rows.withColumn("hash", F.xxhash64("row"))
    return summed_before(rows, ["key"], F.col("read_by"), ["hash"], "one", "earlier").select("row", "key", (F.col("earlier") + 1).cast("long").alias("nth"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, compression: str = "zstd") -> DataFrame:
    """Writes folders ``shard=N`` of Parquet files in slot order; returns the manifest.

    The manifest has shard, rows, bytes, first_id and last_id. A shard's rows go to several tasks,
    by ranges of slots, so no task holds a whole shard.
    """
    spread = sharded_documents(docs, shards).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    spread.select("row.*", "slot", "shard").write.partitionBy("shard").option("compression", compression).parquet(path)
    rows = placed(docs, shards)
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(common.table(spark, sf_dir, "documents")).drop("sha", "nth")


ORACLE_SQL = f"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i : CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END) ORDER BY n) AS line
  FROM range(256) bytes(n)
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + {OVERHEAD} AS size FROM documents
), s AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, sha256(text) ROWS UNBOUNDED PRECEDING) - size AS begin, sum(size) OVER () AS total,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(text)) AS place
  FROM d
), p AS (
  SELECT *, ((2 * begin + size) * {SHARDS} // (2 * total))::INT AS shard FROM s
)
SELECT doc_id, size::BIGINT AS size, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard,
  xor(list_reduce(list_prepend({0xFFFFFFFF}::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h : ('0x' || h)::BIGINT)),
    lambda c, b : xor(c >> 8, crc.line[(xor(c, b) & 255) + 1])), {0xFFFFFFFF})::BIGINT AS text_crc32
FROM p CROSS JOIN crc
"""
