"""Operator 7: nearest neighbours by counting collisions on sorted projections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Queries of the query set: rows whose id is divisible by this; neighbours of each.
EVERY, NEIGHBOURS = 20, 20
#: Vectors in a block of the index, queries in a block.
BLOCK_ROWS, QUERY_ROWS = 4096, 4096
#: Projections; the share of them that have to collide; the first half-width of a window in
#: standard deviations and its growth from round to round.
PROJECTIONS, COLLIDE, FIRST, GROWTH, ROUNDS = 128, 0.85, 1.0, 1.25, 12
#: Windows grow until this share of a block, and the neighbours asked for, passes.
VERIFIED, SEED = 0.1, 11
#: Queries that find out a block's first useful round. (Counts of collisions are bytes.)
PILOTS = 16
assert PROJECTIONS < 256
#: How far, in standard deviations of a random projection, a query's window reaches for vectors
#: as near as the last of those that it has found. (Three leave out one such vector in 370.)
REACH = 3.0


def projections(size: int, count: int) -> np.ndarray:
    """Random directions as columns, orthogonal to each other within every ``size`` of them."""
    rng = np.random.default_rng([SEED, size, count])
    bases = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-count // size))]
    return np.concatenate(bases, axis=1)[:, :count]


class Block:
    """The sorted projection arrays of some vectors.

    Vectors are scaled by the longest and given one more component that makes all
    equally long, so that the nearest to a unit query has the largest inner product.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        # Divided by the largest component first, so that no square overflows.
        top = np.abs(vectors).max()
        small = self.vectors / top
        length = np.sqrt((small * small).sum(1))
        small = np.concatenate([small, np.sqrt(np.maximum(length.max() ** 2 - length**2, 0))[:, None]], axis=1) / length.max()
        self.directions = projections(small.shape[1], PROJECTIONS)
        values = (small @ self.directions).T
        at = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, at, axis=1)
        self.place = np.empty(values.shape, np.uint16 if len(ids) < 2**16 else np.uint32)
        np.put_along_axis(self.place, at, np.arange(len(ids), dtype=self.place.dtype)[None, :], axis=1)
        self.unit = float(values.std()) or 1.0

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query ids, vector ids, scores: the nearest found of each query, itself left out."""
        scaled = queries / np.abs(queries).max(1, keepdims=True)
        scaled /= np.sqrt((scaled * scaled).sum(1, keepdims=True))
        centre = np.concatenate([scaled, np.zeros((len(queries), 1))], axis=1) @ self.directions
        enough = min(len(self.ids), k + 1 + int(VERIFIED * len(self.ids)))
        need = int(np.ceil(COLLIDE * PROJECTIONS))
        passed: list[np.ndarray | None] = [None] * len(queries)
        shifted, inside = np.empty_like(self.place), np.empty(self.place.shape, bool)

        def widen(asking: np.ndarray, first: int) -> int:
            """Widens the windows of these queries until enough vectors pass; the first round that any of them took."""
            soonest = ROUNDS
            for r in range(first, ROUNDS):
                if not len(asking):
                    break
                half = self.unit * FIRST * GROWTH**r
                low, high = (np.stack([np.searchsorted(self.sorted[j], centre[asking, j] + s * half, side) for j in range(PROJECTIONS)], axis=1) for s, side in ((-1, "left"), (1, "right")))
                low, width = low.astype(self.place.dtype), (high - low).astype(self.place.dtype)
                left = []
                for n, q in enumerate(asking):
                    # A place lies in a window if its distance from the window's begin is less than the width.
                    np.subtract(self.place, low[n][:, None], out=shifted)
                    np.less(shifted, width[n][:, None], out=inside)
                    found = np.flatnonzero(inside.view(np.uint8).sum(0, dtype=np.uint8) >= need)
                    if len(found) >= enough:
                        passed[q], soonest = found, min(soonest, r)
                    else:
                        left.append(q)
                asking = np.array(left, dtype=np.int64)
            return soonest

        # A few queries show from which round on windows can hold enough.
        soonest = widen(np.arange(min(PILOTS, len(queries))), 0)
        widen(np.arange(min(PILOTS, len(queries)), len(queries)), max(0, min(soonest, ROUNDS - 1) - 1))
        out: list[tuple] = []
        for q, vector in enumerate(queries):
            # Windows that never filled: all vectors are verified.
            found = np.arange(len(self.ids)) if passed[q] is None else passed[q]
            found = found[self.ids[found] != ids[q]]
            score = (self.vectors[found] * vector).sum(1)
            best = np.lexsort((self.ids[found], -score))[:k]
            out.append((np.full(len(best), ids[q]), self.ids[found][best], score[best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), size: one vector for each id that can take part."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(good.alias("good"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))


def transformed(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors as points on a sphere: scaled by the longest, with one more component.

    The nearest point to a unit query is then the vector with the largest inner product.
    """
    small = vectors / longest
    return np.concatenate([small, np.sqrt(np.maximum(1 - (small * small).sum(1), 0))[:, None]], axis=1)


def unit_queries(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    scaled /= np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return np.concatenate([scaled, np.zeros((len(scaled), 1))], axis=1)


def matrices(batch: pa.RecordBatch):
    """(rows, size, vectors) for the rows of each size in a batch with columns size and v."""
    size = batch.column("size").to_numpy()
    for n in np.unique(size):
        part = batch.filter(pa.array(size == n))
        yield part, int(n), part.column("v").flatten().to_numpy().reshape(part.num_rows, n)


def part_of(ids: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """Which of a block's parts an id is in."""
    mixed = (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return (mixed % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Divided by the largest component first, so that no square overflows."""
    top = np.abs(vectors).max(1)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(1))


def with_columns(batch: pa.RecordBatch, **more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more.values())], names=[*batch.schema.names, *more])


def placed(rows: DataFrame) -> DataFrame:
    """Adds p0, p1: where a vector stands in two sorted arrays; q0, q1: where it stands as a query;
    and longest, the length of the longest vector of its size."""
    top = F.array_max(F.transform("v", F.abs))
    length = top * F.sqrt(F.aggregate(F.transform("v", lambda x: x / top), F.lit(0.0), lambda a, x: a + x * x))
    longest = {r["size"]: r["longest"] for r in rows.groupBy("size").agg(F.max(length).alias("longest")).collect()}

    def place(batches):
        for batch in batches:
            for part, n, v in matrices(batch):
                two = projections(n + 1, 2)
                p, q = transformed(v, longest[n]) @ two, unit_queries(v) @ two
                yield with_columns(part, p0=p[:, 0], p1=p[:, 1], q0=q[:, 0], q1=q[:, 1], longest=np.full(len(v), longest[n]))

    return common.materialise(rows.mapInArrow(place, "vec_id long, v array<double>, size int, p0 double, p1 double, q0 double, q1 double, longest double"), "placed")


def celled(rows: DataFrame, side: int) -> DataFrame:
    """Adds c0, c1: ranges of the first sorted array, ``side`` of them, and of the second within each."""
    fractions = [i / side for i in range(1, side)]
    if not fractions:
        return rows.withColumns({"c0": F.lit(0).cast("long"), "c1": F.lit(0).cast("long")})

    def cut(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
        found = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*map(F.lit, fractions)), F.lit(20 * side)).alias("cuts")).collect()
        cuts = {tuple(r[k] for k in keys): np.array(r["cuts"]) for r in found}

        def assign(batches):
            for batch in batches:
                key = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
                at = [np.searchsorted(cuts[k], x, side="left") for k, x in zip(key, batch.column(value).to_pylist(), strict=True)]
                yield with_columns(batch, **{name: np.array(at, np.int64)})

        return df.mapInArrow(assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + f", {name} long")

    first = cut(rows, ["size"], "p0", "c0")
    return cut(first, ["size", "c0"], "p1", "c1")


class Directory:
    """The blocks with the box that each spans in the two arrays, in the order of (size, range)."""

    def __init__(self, rows: list, block_rows: int):
        rows = sorted(rows, key=lambda r: (r["size"], r.c0, r.c1))
        names = ("size", "c0", "low0", "high0", "low1", "high1", "rows")
        self.size, self.c0, self.low0, self.high0, self.low1, self.high1, count = (np.array([r[n] for r in rows]) for n in names)
        self.c1 = np.array([r.c1 for r in rows])
        self.parts = -(-count // block_rows)

    def own(self, size: int, q0: float, q1: float) -> int:
        """The block that is nearest to a query, by its first place and then by its second."""
        a, b = np.searchsorted(self.size, [size, size + 1])
        far = np.maximum(np.maximum(self.low0[a:b] - q0, q0 - self.high0[a:b]), 0)
        at = np.flatnonzero(far == far.min())
        beside = np.maximum(np.maximum(self.low1[a:b][at] - q1, q1 - self.high1[a:b][at]), 0)
        return int(a + at[np.argmin(beside)])

    def met(self, size: int, q0: float, q1: float, half: float) -> np.ndarray:
        """The blocks that a query's windows meet in both arrays."""
        a, b = np.searchsorted(self.size, [size, size + 1])
        s = slice(a, b)
        return a + np.flatnonzero((self.low0[s] <= q0 + half) & (self.high0[s] >= q0 - half) & (self.low1[s] <= q1 + half) & (self.high1[s] >= q1 - half))


def searched(data: DataFrame, visits: DataFrame, queries: DataFrame, k: int, query_rows: int) -> DataFrame:
    """query_id, vec_id, score: the best k of every block that a query visits.

    data: block, part, vec_id, v; visits: block, part, vec_id; queries: vec_id, v. Visits are
    numbers until here, where vectors join them on their way to the blocks. A block meets
    its queries some ``query_rows`` at a time, so a task holds no more than the two.
    """
    asked = visits.groupBy("block", "part").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("turns"))
    asked = common.materialise(asked, "turns")
    rows = data.join(asked, ["block", "part"]).select("block", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asks"), "vec_id", "v")
    turn = F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.col("turns")).cast("int")
    asking = visits.join(asked, ["block", "part"]).join(queries.select("vec_id", "v"), "vec_id").select("block", "part", turn.alias("turn"), F.lit(True).alias("asks"), "vec_id", "v")

    def search(batches):
        key, held = None, ([], [])

        def close():
            data, asked = held
            if not data or not asked:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
            (ids, vectors), (of, queries) = ((np.concatenate([x[0] for x in side]), np.concatenate([x[1] for x in side])) for side in (data, asked))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in Block(ids, vectors).search(of, queries, k)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            block, part, turn = (batch.column(i).to_numpy() for i in range(3))
            asks, ids = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            turns = (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (turn[1:] != turn[:-1]) | (asks[1:] != asks[:-1])
            edges = [0, *(np.flatnonzero(turns) + 1).tolist(), len(ids)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                now = (block[a], part[a], turn[a])
                if now != key:
                    if key is not None:
                        yield close()
                    key, held = now, ([], [])
                flat = batch.column(5).slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                held[int(asks[a])].append((ids[a:b], flat))
        if key is not None:
            yield close()

    grid = rows.unionByName(asking).repartition("block", "part", "turn").sortWithinPartitions("block", "part", "turn", "asks")
    return grid.mapInArrow(search, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query, by inner product.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but the
    query's own. Vectors that are null, zero, or hold a null or a number that is not
    finite take no part, nor do null ids. Of rows with one id the smallest vector
    counts. Vectors meet only those with as many components. With fewer than k
    candidates all are returned; no rows in, no rows out; other columns are ignored.

    Vectors are dealt to blocks by their ranges in two sorted projections (and at random
    where a range holds more than a block, so equal vectors do not pile up). A query first
    visits the block around its own place. How near its k-th best is there tells how far
    its windows have to reach in the two arrays, and it then visits the blocks that they
    meet, all others being pruned. Within a block, windows around the query's place in
    each of many sorted arrays widen until enough vectors are in most of them, and those
    are verified in full. Where a query's windows do not fill in ROUNDS rounds (a block whose
    vectors are far from it on most projections), the whole block is verified for it: the
    exact way, never a shorter list. What is held in one place is a directory with a line a
    block (some 70 bytes for 4,096 vectors, 2 GB for 10^11 vectors).
    """
    common.small_batches(vectors.sparkSession)
    rows = common.materialise(usable(vectors), "vectors")
    total = rows.count()
    side = max(1, int(np.ceil(np.sqrt(total / block_rows))))
    rows = common.materialise(celled(placed(rows), side), "cells")
    cells = rows.groupBy("size", "c0", "c1").agg(F.count(F.lit(1)).alias("rows"), F.min("p0").alias("low0"), F.max("p0").alias("high0"), F.min("p1").alias("low1"), F.max("p1").alias("high1"))
    blocks = Directory(cells.collect(), block_rows)
    number = {(int(s), int(a), int(b)): i for i, (s, a, b) in enumerate(zip(blocks.size, blocks.c0, blocks.c1, strict=True))}
    held = rows.sparkSession.sparkContext.broadcast((blocks, number))

    def dealt(batches):
        blocks, number = held.value
        for batch in batches:
            key = zip(*(batch.column(c).to_pylist() for c in ("size", "c0", "c1")), strict=True)
            block = np.array([number[x] for x in key], np.int64)
            part = part_of(batch.column("vec_id").to_numpy(), blocks.parts[block] if len(block) else np.ones(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(part), batch.column("vec_id"), batch.column("v")], names=["block", "part", "vec_id", "v"])

    def home(batches):
        blocks, _ = held.value
        for batch in batches:
            of = [blocks.own(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("size", "q0", "q1")), strict=True)]
            part = part_of(batch.column("vec_id").to_numpy(), blocks.parts[of] if of else np.ones(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(of, np.int64)), pa.array(part), batch.column("vec_id")], names=["block", "part", "vec_id"])

    def reached(batches):
        blocks, _ = held.value
        for batch in batches:
            for part, n, v in matrices(batch):
                last, longest = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("last", "longest"))
                far = np.sqrt(np.maximum(2 - 2 * (last / longest) / lengths(v), 0))
                half = np.where(np.isnan(last), np.inf, far * min(1.0, REACH / np.sqrt(n + 1)) + 1e-9)
                out: list[tuple] = []
                places = zip(part.column("q0").to_numpy(), part.column("q1").to_numpy(), half, strict=True)
                for i, (q0, q1, h) in enumerate(places):
                    own = blocks.own(n, q0, q1)
                    at = int(part_of(part.column("vec_id").slice(i, 1).to_numpy(), blocks.parts[[own]])[0])
                    for b in blocks.met(n, q0, q1, h):
                        p = np.arange(blocks.parts[b])
                        p = p[p != at] if b == own else p
                        out.append((np.full(len(p), i), np.full(len(p), b), p))
                if out:
                    i, b, p = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int64)), pa.array(p.astype(np.int64)), part.column("vec_id").take(pa.array(i))], names=["block", "part", "vec_id"])

    kind = "block long, part long, vec_id long"
    data = common.materialise(rows.mapInArrow(dealt, f"{kind}, v array<double>"), "blocks")
    queries = rows.filter(F.col("vec_id") % every == 0)
    near = common.materialise(best(searched(data, common.materialise(queries.mapInArrow(home, kind), "homes"), queries, k, query_rows), k), "near")
    last = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("last"))
    visits = common.materialise(queries.join(last, "vec_id", "left").mapInArrow(reached, kind), "visits")
    found = near.drop("rank").unionByName(searched(data, visits, queries, k, query_rows))
    return best(found, k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))
