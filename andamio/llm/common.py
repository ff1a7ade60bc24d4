"""Shared pieces of the corpus operators: tables, the shared folder, group look-ups."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java's and Python's view of a word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of that very name, dots, blanks and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs``, whatever their names, as one struct."""
    return F.struct(*map(named, docs.columns))


def first_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one whose ``row`` hashes lowest, so reruns keep the same.

    The limit comes before the shuffle, so repeats of a key do not meet in one task.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row")))
    return rows.withColumn("nth", nth).filter("nth <= 1").drop("nth")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset, and there is but one machine (tests, a laptop), a folder of
    our own is taken.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm_dir = sc._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            found = jvm_dir.get()
        elif not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="andamio-shared-")
            sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/andamio-{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_made)
    _made.append((spark, path))
    return path


def _remove_made() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before
            return


def materialise(df: DataFrame, what: str = "step") -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back.

    Cuts the lineage with files that outlive any executor, so a lost executor
    costs a reread and not a recomputation.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._written_to = path
    return read


def discard(*written: DataFrame) -> None:
    """Removes what ``materialise`` wrote, once all that was made from it is written too."""
    for df in written:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(df._written_to)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes in a batch that goes to a Python worker, unless the session sets it.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches for Python workers by bytes, as rows may be long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII text takes the quick built-in."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: The largest groups that are joined by broadcast: a constant number of rows.
HOT_GROUPS = 256


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, fit: Column | None = None) -> DataFrame:
    """Joins each row to its group's row without gathering a large group in a task.

    ``groups`` has one row per key. The ``HOT_GROUPS`` largest go by broadcast (a
    bounded number of rows); the rest, none of which can hold more than
    1/HOT_GROUPS of the rows, by a shuffle. ``fit`` bounds what a broadcast row may
    hold, where keys can be long. Both inputs are read twice, so they should be materialised.
    """
    hot = groups.filter(F.col(size) > 1).filter(F.lit(True) if fit is None else fit).orderBy(F.desc(size), *keys).limit(HOT_GROUPS)
    usual = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups, keys)
    return usual.unionByName(rows.join(F.broadcast(hot), keys))


#: Repeats of a row that one array holds.
REPEATS = 4096


def repeated(rows: DataFrame, times: str, nth: str = "nth") -> DataFrame:
    """Each row as often as ``times`` says, numbered from 1, by short arrays."""
    run = rows.withColumn("run", F.explode(F.expr(f"sequence(0L, (CAST({times} AS LONG) - 1) DIV {REPEATS})")))
    return run.withColumn(nth, F.explode(F.expr(f"sequence(run * {REPEATS} + 1, least(CAST({times} AS LONG), (run + 1) * {REPEATS}))"))).drop("run")


def most_frequent(counts: DataFrame, number: str, limit: int) -> DataFrame:
    """The rows with the largest ``number``, ``limit`` at most, without sorting the table.

    A histogram of the numbers by eighths of powers of two (a few hundred rows) gives
    the number from which on no more than ``limit`` rows are left. Rows that tie with
    the first one left out are left out too.
    """
    step = F.floor(F.log2(F.col(number)) * 8)
    by_step = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect() if r["step"] is not None), reverse=True)
    held, least = 0, None
    for at, n in by_step:
        if held + n > limit:
            break
        held, least = held + n, at
    return counts.filter(F.lit(False) if least is None else step >= least)


def integer_vectors(vectors: DataFrame, scale: int, multiple: int = 1, keep: tuple[str, ...] = ("vec_id",)) -> tuple[DataFrame, int]:
    """The columns ``keep`` and x = floor(scale * entry) as longs, and the length of x.

    Rows whose vector is null or holds null or non-finite entries are dropped. Shorter
    vectors get zeros behind, up to the longest, rounded up to a ``multiple``, so all are
    equally long. (An entry beyond a long is the largest or smallest long.)
    """
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(*keep, v.alias("v")).filter(F.col("v").isNotNull()).filter(good)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(0, -(-longest // multiple) * multiple)
    x = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    if width:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    return rows.select(*keep, x.alias("x")), width
