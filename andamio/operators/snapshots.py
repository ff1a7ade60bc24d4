"""The catalogue as versions of buckets: an upsert rewrites the buckets that its batch touches, no others.

``path`` holds ``data/version=N/bucket=B`` with the rows of bucket B as version N wrote them,
and ``manifest/N``, which says for each bucket which version has its rows. The manifest is written
last: a version without one was never finished, and writing it again gives the same.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalogue

#: Buckets of a catalogue; a manifest has a line for each, and each is one task's work.
BUCKETS = 256


def bucket(buckets: int) -> Column:
    """Where a key belongs. Null keys have buckets too."""
    return F.pmod(F.xxhash64("supplier", "supplier_id"), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, version: int) -> tuple[dict[int, int], T.StructType]:
    """The version of each bucket that holds rows (BUCKETS lines at most), and the columns."""
    lines = spark.read.schema("bucket int, version int, columns string").parquet(f"{path}/manifest/{version}").collect()
    return {r.bucket: r.version for r in lines if r.bucket is not None}, T.StructType.fromJson(json.loads(next(r.columns for r in lines if r.bucket is None)))


def _read(spark: SparkSession, path: str, of: dict[int, int], schema: T.StructType) -> DataFrame:
    folders = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(of.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    """All rows of a version."""
    return _read(spark, path, *manifest(spark, path, version))


def upsert(batch: DataFrame, path: str, version: int, before: int | None, buckets: int = BUCKETS) -> None:
    """Writes ``version``: the rows of ``before`` (None: nothing yet) with ``batch``, as ``catalogue.upserted`` has it.

    Only buckets that hold a key of the batch are read and written. An empty batch writes
    a manifest alone. What a failed attempt left of the version is overwritten. Columns that
    are new with a batch are null in older rows. The number of buckets stays that of the first version.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("bucket", bucket(buckets))
    touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
    of, columns = manifest(spark, path, before) if before is not None else ({}, batch.drop("seq").schema)
    new = catalogue.upserted(_read(spark, path, {b: of[b] for b in touched if b in of}, columns), batch)
    if touched:
        new.withColumn("bucket", bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    now = [(b, v, None) for b, v in sorted((of | dict.fromkeys(touched, version)).items())] + [(None, version, new.schema.json())]
    spark.createDataFrame(now, "bucket int, version int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{version}")
