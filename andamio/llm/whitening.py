"""Operator 11: whitening of embeddings by merged moments (Chan's formula)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Entries become floor(SCALE * entry); components that are returned.
SCALE, COMPONENTS = 256, 4
#: Components whose share of the variance is below this are rounding and are not scaled up.
LEAST_SHARE = 1e-11


def largest(x: np.ndarray) -> int:
    """The largest absolute value, the smallest long's included; 0 where there is none."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


@dataclass
class Moments:
    """Count, mean, centred scatter (doubles) and exact sums of some vectors."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @staticmethod
    def of(x: np.ndarray, exact: bool = True) -> Moments:
        mean = x.mean(axis=0, dtype=np.float64)
        centred = x - mean
        sums = [int(s) for s in x.sum(axis=0, dtype=object if largest(x) > 2**40 else np.int64)] if exact else []
        return Moments(len(x), mean, centred.T @ centred, sums)

    def merged(self, other: Moments) -> Moments:
        """The moments of both together (Chan, Golub and LeVeque)."""
        n, apart = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), scatter, [a + b for a, b in zip(self.sums, other.sums, strict=True)])


@dataclass
class Whitening:
    """What the driver knows of a fit: lines of the vectors' length, never the vectors.

    ``values`` fall; ``components`` has them as columns; ``usable`` tells which can be scaled.
    """

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: list[float | None]
    usable: np.ndarray
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of rows of x, NaN where a component is not usable."""
        n, sums = float(self.n), np.array([float(s) for s in self.sums])
        small = largest(x) * self.n < 2**53 and max(map(abs, self.sums), default=0) < 2**53
        # n * x - S is a whole number: where it is exact in doubles, only one rounding is left.
        centred = (x * n - sums) / n if small else x - sums / n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.usable, centred @ self.components / np.sqrt(np.maximum(self.values, 0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum over dimensions of (n * x - S)^2, exact; None where a long cannot hold it."""
        width, most = x.shape[1], self.n * largest(x) + max(map(abs, self.sums), default=0)
        if most * most * width < 2**63:
            apart = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (apart * apart).sum(1).tolist()
        apart = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(s) if s < 2**63 else None for s in (apart * apart).sum(1)]


def rows_of(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def merged_moments(vectors: DataFrame, width: int, of: Whitening | None = None) -> Moments | None:
    """The moments of the column x, or of what ``of`` makes of it; None where there is no row.

    Each partition merges those of its batches, then partitions merge in pairs (treeReduce), so
    a task or the driver holds no more than a few matrices.
    """

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(0), width)
                here = Moments.of(x) if of is None else Moments.of(of.project(x)[:, of.usable], exact=False)
                found = here if found is None else found.merged(here)
        if found is not None:
            lines = [[found.n], [found.mean.tolist()], [found.scatter.ravel().tolist()], [[str(s) for s in found.sums]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(lines, (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string())), strict=True)], ["n", "mean", "scatter", "sums"])

    states = vectors.select("x").mapInArrow(of_partition, "n long, mean array<double>, scatter array<double>, sums array<string>").rdd
    if not states.getNumPartitions():
        return None

    def state(row) -> Moments:
        size = len(row.mean)
        return Moments(row.n, np.array(row.mean), np.array(row.scatter).reshape(size, size), [int(s) for s in row.sums])

    def pair(a: Moments | None, b: Moments | None) -> Moments | None:
        return b if a is None else a if b is None else a.merged(b)

    return states.map(state).treeAggregate(None, pair, pair)


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Principal components of the column x (each row counts), and how far from the identity they whiten it."""
    found = merged_moments(distinct, width) if width else None
    if found is None:
        return None
    covariance = found.scatter / found.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    kept = np.argsort(-values, kind="stable")[:components]
    values, vectors, trace = values[kept], vectors[:, kept], float(np.trace(covariance))
    # Either sign would do: the largest entry is made positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))])
    usable = values > LEAST_SHARE * trace
    made = Whitening(found.n, found.sums, values, vectors, [float(v) / trace if trace > 0 else None for v in values], usable)
    if usable.any():
        again = merged_moments(distinct, width, made)
        made.identity_error = float(np.abs(again.scatter / again.n - np.eye(int(usable.sum()))).max())
    return made


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct x once, written. Repeats are combined where they are read, before they move."""
    return common.materialise(rows.select("x").distinct(), "fit")


def whiten(rows: DataFrame, width: int, made: Whitening) -> DataFrame:
    """Adds ``whitened`` (an array of components, null where one is not usable) and ``deviation``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x"), "deviation long, whitened array<double>"])

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column("x"), width)
            out = made.project(x)
            flat = pa.array(out.ravel(), pa.float64(), mask=np.isnan(out.ravel()))
            starts = pa.array(np.arange(0, out.size + 1, max(1, out.shape[1]), dtype=np.int32))
            others = [(n, batch.column(n)) for n in batch.schema.names if n != "x"]
            columns = [*others, ("deviation", pa.array(made.deviations(x), pa.int64())), ("whitened", pa.ListArray.from_arrays(starts, flat))]
            yield pa.RecordBatch.from_arrays([c for _, c in columns], [n for n, _ in columns])

    return rows.mapInArrow(of_partition, schema)


def whitened_components(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are dropped. Shorter
    vectors get zeros behind. The fit takes each distinct x once, so copies do not
    weigh more; every kept row is whitened, repeated ids and null ids as rows of their own.
    Vectors with fewer entries than ``components`` have a component for each entry, empty
    ones none. A component without variance (one distinct vector, or fewer than the
    components) has a null ``whitened``; where none has any, ``identity_error`` is null, and
    where the trace is 0 ``explained`` too. A ``deviation`` beyond a long is null. No rows in,
    no rows out; other columns are ignored.
    """
    rows, width = common.integer_vectors(vectors, scale)
    made = fit(fit_list(rows), width, components)
    if made is None:
        empty = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], empty)
    out = whiten(rows, width, made).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*(F.lit(e).cast("double") for e in made.explained)), F.col("at") + 1)
    error = F.lit(made.identity_error).cast("double")
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), error.alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(common.table(spark, sf_dir, "embeddings"))
