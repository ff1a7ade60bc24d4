"""Operator 2: shortest-pack-first packing over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

LENGTH, END = 2048, 1
#: About how many pieces of one length a task ranks.
RANKED = 2_000


@dataclass(frozen=True)
class Slots:
    """Runs of equal slots: pieces of ``length`` with ranks from ``rank`` on go to the
    sequences from ``sequence`` on, at ``offset``."""

    key: np.ndarray  # length << 44 | first rank, ascending
    sequence: np.ndarray
    offset: np.ndarray
    filled: np.ndarray


def shortest_pack_first(counts: dict[int, int], room: int) -> list[tuple[list[int], int]]:
    """Packing patterns (lengths in order of placing) with how often each is used.

    Lengths are placed longest first, always into the open packs with the most room
    left. Where none has room, as many packs are opened as what is still to be placed
    needs at least, so pieces of one frequent length come to share packs. Works on
    counts alone: the number of steps depends on how many lengths there are and not on
    how many pieces.
    """
    open_packs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # room left -> (count, pattern)
    full: list[tuple[int, tuple]] = []

    def put(left: int, count: int, pattern: tuple) -> None:
        (open_packs[left] if left else full).append((count, pattern))

    to_place, open_room = sum(k * n for k, n in counts.items()), 0
    for length in sorted(counts, reverse=True):
        rest = counts[length]
        while rest:
            left = max(open_packs, default=0)
            if left < length:
                new = min(rest, max(-(-(to_place - open_room) // room), -(-rest // (room // length))))
                put(room - length, new, (None, length))
                open_room += new * (room - length)
                to_place -= new * length
                rest -= new
                continue
            count, pattern = open_packs[left].pop()
            if not open_packs[left]:
                del open_packs[left]
            took = min(rest, count)
            open_room -= took * length
            to_place -= took * length
            put(left - length, took, (pattern, length))
            if count > took:
                put(left, count - took, pattern)
            rest -= took

    def lengths(pattern) -> list[int]:
        found = []
        while pattern:
            pattern, length = pattern
            found.append(length)
        return found[::-1]

    return [(lengths(p), n) for n, p in [*full, *(x for left in sorted(open_packs) for x in open_packs[left])]]


def slots(patterns: list[tuple[list[int], int]]) -> Slots:
    used: dict[int, int] = defaultdict(int)
    runs, sequence = [], 0
    for lengths, count in patterns:
        offset, total = 0, sum(lengths)
        for length in lengths:
            runs.append((length << 44 | used[length], sequence, offset, total))
            used[length] += count
            offset += length
        sequence += count
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)
    return Slots(*(table[:, i].copy() for i in range(4)))


def tokenised_pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: documents cut at multiples of ``length``."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])

    def cut(batches):
        ids, last = tokens.ids(path), np.array([end], "<u4")
        out: list[tuple] = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], schema=schema)
            out.clear()
            return batch

        for doc_id, text in tokens.rows(batches, "doc_id", "text"):
            all_ids = np.concatenate([ids.of(text or ""), last])
            for start in range(0, len(all_ids), length):
                piece = all_ids[start : start + length]
                out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(all_ids)))
            if len(out) >= 20_000:
                yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 among the pieces of the same length.

    Two levels, as one length may have most of the pieces: ranks within salted parts of
    a length, and the parts' sizes before.
    """
    parts = max(1, -(-pieces.count() // RANKED))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32"))
    return pieces.withColumn("nth", nth).join(before, ["length", "part"]).withColumn("rank", F.col("ahead") + F.col("nth") - 1).drop("part", "ahead", "nth")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    A document is its ids and ``end``; null text counts as empty, so an empty document
    is one piece of one id. Documents are cut at multiples of ``length``; the pieces
    are packed without further cuts. A sequence is padded to ``length``, unless what it
    holds is a power of two (padded_to). Repeated rows and null ids are packed like any
    other; no rows in, no rows out; other columns are ignored.

    Only the histogram of lengths (``length`` rows at most) comes to the driver. The
    patterns go back as runs of ranks, whose number depends on the histogram alone.
    """
    path = path or tokens.default_path()
    common.small_batches(docs.sparkSession)
    pieces = common.materialise(tokenised_pieces(docs, path, length, end), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = docs.sparkSession.sparkContext.broadcast(slots(shortest_pack_first(counts, length)))

    def place(batches):
        table = runs.value
        for batch in batches:
            of = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            key = of["length"].to_numpy() << 44 | of["rank"].to_numpy()
            at = np.searchsorted(table.key, key, side="right") - 1
            filled = table.filled[at]
            sequence = table.sequence[at] + (key - table.key[at])
            padded = np.where(filled & (filled - 1), length, filled)
            yield pa.RecordBatch.from_arrays(
                [*(of[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(table.offset[at]), pa.array(padded)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"],
            )

    return ranked(pieces).mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
