"""Operator 12: codes of vectors by small codebooks, entries filtered by approximate cells (VA-file)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .whitening import largest, rows_of

#: Components become floor(SCALE * component); parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bits of a cell; vectors that are compared at a time.
BITS, TOGETHER = 3, 4096


class Cells:
    """The entries of one codebook as a vector-approximation file.

    Every coordinate of an entry is kept as the number of the cell, of 2**BITS in its
    dimension, that it falls into; a cell is known by the least and largest coordinate in it.
    """

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        size, width = entries.shape
        cells = min(2**bits, size)
        # Equally full cells; equal coordinates share one.
        order = np.sort(entries, axis=0)
        starts = order[np.arange(cells) * size // cells]
        self.cell = np.stack([np.searchsorted(starts[:, j], entries[:, j], side="right") - 1 for j in range(width)], axis=1)
        self.low = np.zeros((cells, width), entries.dtype)
        self.high = np.zeros((cells, width), entries.dtype)
        for j in range(width):
            for c in set(self.cell[:, j].tolist()):
                inside = entries[self.cell[:, j] == c, j]
                self.low[c, j], self.high[c, j] = inside.min(), inside.max()

    def bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance that each entry can have from each point.

        A point's table has a line for each dimension and cell; an entry's bounds are the
        sums of the lines that its cells name.
        """
        lower = np.zeros((len(points), len(self.entries)), points.dtype)
        upper = np.zeros_like(lower)
        for j in range(points.shape[1]):
            below, above = self.low[:, j] - points[:, j, None], points[:, j, None] - self.high[:, j]
            apart = np.maximum(np.maximum(below, above), 0)
            furthest = np.maximum(np.abs(below), np.abs(above))
            lower += (apart * apart)[:, self.cell[:, j]]
            upper += (furthest * furthest)[:, self.cell[:, j]]
        return lower, upper

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each point (ties to the lower index), its squared distance, and how many were refined.

        An entry whose lower bound is above another's upper bound is further away for
        certain; only the others' distances are computed, in whole numbers.
        """
        lower, upper = self.bounds(points)
        at, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        apart = points[at] - self.entries[entry]
        exact = (apart * apart).sum(axis=1)
        # Candidates are in the order of points, then entries: the first least one of each point counts.
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        least = np.minimum.reduceat(exact, starts)
        hits = np.flatnonzero(exact == np.repeat(least, np.diff(np.r_[starts, len(at)])))
        first = hits[np.r_[True, at[hits][1:] != at[hits][:-1]]]
        return entry[first], least, len(at)


def wide_enough(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as longs where no squared distance passes a long, else as Python's own whole numbers."""
    most = largest(x) + largest(book)
    if most < 2**62 and most * most * x.shape[-1] < 2**63:
        return x, book
    return x.astype(object), book.astype(object)


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a row per vector, a column per part) and the squared distances of the parts."""
    parts, _, width = books.shape
    codes, errors = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), object)
    for p in range(parts):
        points, book = wide_enough(x[:, p * width : (p + 1) * width], books[p])
        cells = Cells(book)
        for at in range(0, len(x), TOGETHER):
            codes[at : at + TOGETHER, p], errors[at : at + TOGETHER, p], _ = cells.nearest(points[at : at + TOGETHER])
    return codes, errors


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest ids (null last, ties by vector)."""
    seeds = np.array([r.x for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()], np.int64)
    return seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2)


def following_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries moved to the floored mean of the parts nearest to them; unused ones stay.

    Each task sums its own parts by entry; at most parts x entries rows come to the driver.
    """
    parts, entries, width = books.shape

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column(0), parts * width)
            codes, _ = assigned(x, books)
            for p in range(parts):
                for e in np.unique(codes[:, p]):
                    mine = x[codes[:, p] == e, p * width : (p + 1) * width]
                    counts[p * entries + e] += len(mine)
                    sums[p * entries + e] += mine.sum(axis=0, dtype=object if largest(mine) > 2**40 else np.int64)
        used = np.flatnonzero(counts)
        lines = [pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())]
        yield pa.RecordBatch.from_arrays([*lines, *(pa.array([str(s) for s in sums[used, j]], pa.string()) for j in range(width))], ["entry", "n", *(f"s{j}" for j in range(width))])

    schema = ", ".join(["entry int, n long", *(f"s{j} string" for j in range(width))])
    summed = rows.select("x").mapInArrow(of_partition, schema)
    summed = summed.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"s{j}").cast("decimal(38, 0)")).alias(f"s{j}") for j in range(width)))
    moved = books.copy()
    for r in summed.collect():
        moved[r.entry // entries, r.entry % entries] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    return moved


def trained_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        books = following_books(rows, books)
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error: every vector's entries in hex, two digits a part, and their squared distance."""
    parts, _, width = books.shape
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = assigned(rows_of(batch.column("x"), parts * width), books)
            text = [bytes(line).hex() for line in codes.astype(np.uint8)]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array([int(e) for e in errors.sum(axis=1)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "x").mapInArrow(of_partition, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped. Vectors
    shorter than the longest, or whose length does not divide into the parts, get zeros
    behind. Where fewer vectors are kept than a codebook has entries, it has one for each.
    Repeated ids are rows of their own (among the first entries by their vectors), null ids
    rank last, null labels are one label. No rows in, or empty vectors alone: no rows out.
    Other columns are ignored. An error that passes a long stops the job.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a part's code has two hex digits")
    rows, width = common.integer_vectors(vectors, scale, parts, ("vec_id", "label"))
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rows = common.materialise(rows, "integers")
    if not width or not rows.take(1):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    books = trained_books(rows, parts, entries, rounds)
    out = coded(rows, books).withColumn("of", F.to_json(F.struct("label")))
    out = common.materialise(out, "coded")
    labels = out.groupBy("of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    joined = common.with_groups(out, common.materialise(labels, "labels"), ["of"], "rows")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(common.table(spark, sf_dir, "embeddings"))


def _round_sql(n: int) -> str:
    """Assignment n to the books of round n - 1, and the books of round n."""
    return f"""), a{n} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := d, e := e)) AS best
  FROM (SELECT v.r, v.p, b.e, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM v JOIN b{n - 1} b ON v.p = b.p AND v.j = b.j GROUP BY ALL) GROUP BY r, p
), b{n} AS MATERIALIZED (
  SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x
  FROM b{n - 1} b LEFT JOIN (
    SELECT v.p, best.e AS e, j, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM v JOIN a{n} a ON v.r = a.r AND v.p = a.p GROUP BY v.p, best.e, j
  ) m ON b.p = m.p AND b.e = m.e AND b.j = m.j
"""


ORACLE_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c : c IS NULL OR NOT isfinite(c))) = 0
), v AS MATERIALIZED (
  SELECT r, i // (len(embedding) // {PARTS}) AS p, i % (len(embedding) // {PARTS}) AS j, floor({SCALE} * embedding[i + 1]::DOUBLE)::BIGINT AS x
  FROM (SELECT *, unnest(range(len(embedding))) AS i FROM k)
), b0 AS MATERIALIZED (
  SELECT p, r - 1 AS e, j, x FROM v WHERE r <= {ENTRIES}
{"".join(map(_round_sql, range(1, ROUNDS + 2)))}), coded AS (
  SELECT r, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS + 1} GROUP BY r
), whole AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN coded USING (r) CROSS JOIN whole
"""
