"""Operator 10: similarity join of shingle sets under several global orders."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: The query's words in a shingle, and similarity from which documents link, in hundredths.
WORDS, PERCENT = 4, 85
#: Counters of shingle frequencies, and marks of documents to fetch: tables that grow with the
#: data between these bounds. A fuller table costs time (worse orders, more documents
#: fetched), never a link.
LEAST_SLOTS, MOST_SLOTS, MOST_MARKS = 1 << 16, 1 << 23, 1 << 24
#: Bytes of text for each counter.
BYTES_A_SLOT = 400
#: Orders beside the first; members that are compared in one task.
MORE_ORDERS, TOGETHER = 2, 1024
BLOCK = TOGETHER // 2
#: Sets in a group from which on cutting it by another order's tokens costs less than its blocks.
CUT_FROM = 64 * TOGETHER
#: A token that so many documents have is a group by itself: its list is never gathered.
HOT_TOKEN = 100_000

# Odd multipliers of a 64-bit mixer.
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S = [np.uint64(x) for x in (30, 27, 31)]


def mixed(x: np.ndarray, turn: int = 0) -> np.ndarray:
    x = x + np.uint64((int(_M1) * (turn + 1)) % 2**64)
    x = (x ^ (x >> _S[0])) * _M2
    x = (x ^ (x >> _S[1])) * _M3
    return x ^ (x >> _S[2])


class WordHashes(dict):
    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word, self.seed)
        return found


def shingles(text: str | None, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; A-Z lower-cased."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    # Fewer words than a shingle has: the whole sequence, told apart by its length.
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _M2 + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(out))


def least_shared(n: np.ndarray | int, percent: int = PERCENT):
    """The fewest shingles that a set of n shares with any set it links with."""
    return -(-percent * n // 100)


def slot_of(h: np.ndarray, slots: int) -> np.ndarray:
    return (h & np.uint64(slots - 1)).astype(np.int64)


# -- tables summed over all tasks -----------------------------------------------------------


def table_size(wanted: int, most: int) -> int:
    """A power of two from ``wanted`` on, between the bounds."""
    return min(most, max(LEAST_SLOTS, 1 << max(0, wanted - 1).bit_length()))


def packed(table: np.ndarray) -> bytes:
    """Counters in as few bytes each as the largest needs."""
    top = int(table.max(initial=0))
    return table.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // size])


def summed_slots(df: DataFrame, slots: int, count) -> np.ndarray:
    """Sums ``count(batches, table)`` of all tasks into one table of ``slots`` counters.

    Each task writes its table in parts; a part's sums are formed as a stream, so no
    task holds more than its own table.
    """
    parts, size = 64, slots // 64

    def own(batches):
        table = np.zeros(slots, np.uint32)
        count(batches, table)
        at = [i for i in range(parts) if table[i * size : (i + 1) * size].any()]
        data = [packed(table[i * size : (i + 1) * size]) for i in at]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    def together(batches):
        held: dict[int, np.ndarray] = {}
        for part, data in tokens.rows(batches, "part", "data"):
            held[part] = held.get(part, 0) + unpacked(data, size).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([np.minimum(v, 2**31).astype(np.uint32).tobytes() for v in held.values()], pa.binary())], names=["part", "data"])

    kind = "part int, data binary"
    out = np.zeros(slots, np.uint32)
    for r in df.mapInArrow(own, kind).repartition(parts, "part").mapInArrow(together, kind).collect():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(bytes(r.data), np.uint32)
    return out


def frequencies(docs: DataFrame, seed: int, words: int = WORDS) -> np.ndarray:
    """How many documents have a shingle, by slot: all documents count."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = table_size(size // BYTES_A_SLOT, MOST_SLOTS)

    def count(batches, table):
        known = WordHashes(seed)
        for (text,) in tokens.rows(batches, "text"):
            np.add.at(table, slot_of(shingles(text, known, words), slots), np.uint32(1))

    return summed_slots(docs.select("text"), slots, count)


# -- profiles ------------------------------------------------------------------------------


def prefix(h: np.ndarray, rarity: np.ndarray, turn: int, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a set under a global order. Two sets that link share one.

    The order is by rarity, then by a mix of the hash that differs from order to order.
    The first order takes the counts, the others their powers of two.
    """
    by = rarity if turn == 0 else np.floor(np.log2(np.maximum(rarity, 1)))
    size = len(h) - least_shared(len(h), percent) + 1
    return h[np.lexsort((mixed(h, turn), by))[:size]]


def bits_of(h: np.ndarray) -> np.ndarray:
    """Parities of the shingles in two to four cells for each, as bytes.

    Two sets' parities differ in at most as many cells as the sets in shingles.
    """
    cells = 1 << max(6, int(2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount(slot_of(mixed(h, 9), cells), minlength=cells) & 1)


def fold(bits: np.ndarray) -> np.ndarray:
    """The parities in half as many cells: a slot is the low bits of a hash, so cell i meets cell i + half."""
    return bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]


def profiles(docs: DataFrame, rarity: np.ndarray, seed: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, row_key, n, node, check, prefix, hot, others, bits of each document, written down.

    node stands for the set of shingles. A set that comes again in the task has no
    more than its node, so that many equal texts are few from here on. prefix and hot are
    the tokens under the first order, hot those that very many documents have; others
    has the tokens under each further order, sorted, as 32-bit numbers (a clash of two
    may let a pair through to the exact count, and never drops one).
    """
    held = docs.sparkSession.sparkContext.broadcast(rarity)
    others = [f"other{i}" for i in range(MORE_ORDERS)]
    schema = pa.schema(
        [*((c, pa.int64()) for c in ("doc_id", "row_key", "n", "node", "check")), ("prefix", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64())), *((o, pa.binary()) for o in others), ("bits", pa.binary())]
    )

    def describe(batches):
        known, counts, seen = WordHashes(seed), held.value, set()
        rows: list[tuple] = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        for doc_id, row_key, text in tokens.rows(batches, "doc_id", "row_key", "text"):
            h = shingles(text, known, words)
            node, check = (xxhash.xxh3_64_intdigest(h.tobytes(), seed + i) - (1 << 63) for i in (0, 1))
            if node in seen or not len(h):
                rows.append((doc_id, row_key, len(h), node, check, *[None] * (3 + MORE_ORDERS)))
            else:
                if len(seen) < 100_000:
                    seen.add(node)
                rare = counts[slot_of(h, len(counts))]
                first = prefix(h, rare, 0, percent)
                hot = counts[slot_of(first, len(counts))] >= HOT_TOKEN
                further = (short_tokens(prefix(h, rare, t + 1, percent)).tobytes() for t in range(MORE_ORDERS))
                rows.append((doc_id, row_key, len(h), node, check, first[~hot].view(np.int64), first[hot].view(np.int64), *further, bits_of(h).tobytes()))
            if len(rows) >= 1000:
                yield flush()
        yield flush()

    kind = "doc_id long, row_key long, n long, node long, check long, prefix array<long>, hot array<long>, " + "".join(f"{o} binary, " for o in others) + "bits binary"
    found = common.materialise(docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text").mapInArrow(describe, kind), "profiles")
    held.destroy()
    return found


def short_tokens(h: np.ndarray) -> np.ndarray:
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


# -- groups that share a prefix token ----------------------------------------------------------


def sharing_groups(rows: DataFrame) -> DataFrame:
    """gid, node, tokens: the nodes that share a token of ``rows`` (token, node), once for each
    different group of nodes, with the number of tokens that this group shares."""

    def groups(batches):
        """Streams of rows sorted by token; a group may span batches."""
        token, nodes = None, []

        def close():
            members = np.unique(np.concatenate(nodes)) if nodes else np.zeros(0, np.int64)
            if len(members) < 2:
                return None
            m = members.view(np.uint64)
            gid = mixed(np.array([len(m)], np.uint64) + mixed(m, 3).sum())[0]
            return np.full(len(m), gid, np.uint64).view(np.int64), members

        for batch in batches:
            t, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(t):
                continue
            edges = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]])
            out = []
            # Most groups are one set alone and are passed over at once.
            wide = np.flatnonzero(np.diff(edges) > 1)
            for i in sorted({0, len(edges) - 2, *wide.tolist()}):
                a, b = edges[i], edges[i + 1]
                if t[a] != token:
                    done = close()
                    if done:
                        out.append(done)
                    token, nodes = t[a], []
                nodes.append(n[a:b])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["gid", "node"])
        done = close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in done], names=["gid", "node"])

    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(groups, "gid long, node long").groupBy("gid", "node").agg(F.count(F.lit(1)).alias("tokens"))


def memberships(found: DataFrame) -> DataFrame:
    """gid, node, tokens: the groups of sets that share tokens of the first order's prefix.

    A hot token is a group's name as it stands, so its sets meet in no task here.
    """
    hot = found.select(F.explode("hot").alias("gid"), "node").distinct().withColumn("tokens", F.lit(1).cast("long"))
    return sharing_groups(found.select(F.explode("prefix").alias("token"), "node")).unionByName(hot)


def strongest_groups(members: DataFrame) -> DataFrame:
    """Of each set its group that shares most tokens, the largest of equals."""
    sizes = common.materialise(members.groupBy("gid").agg(F.count(F.lit(1)).alias("sets")), "sizes")
    best = common.with_groups(members, sizes, ["gid"], "sets").groupBy("node").agg(F.max(F.struct("tokens", "sets", "gid")).alias("best"))
    return best.select("best.gid", "node")


def group_sizes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members by group and component; groups of several components with all their members."""
    sizes = common.materialise(members.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("of_comp")), "sizes")
    groups = sizes.groupBy("gid").agg(F.sum("of_comp").alias("of_all"), F.count(F.lit(1)).alias("comps"))
    return sizes, common.materialise(groups.filter("comps > 1"), "groups")


def refined(members: DataFrame, sets: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """gid, node, comp: very large groups cut by the tokens under the order ``turn``.

    Two sets that link share a token under every order, so within a group of the first
    order they share a group of the second. Other groups stay as they are.
    """
    groups = group_sizes(members)[1]
    rows = common.with_groups(members, groups, ["gid"], "of_all")
    other = f"other{turn}"

    def cut(batches):
        out, size = [], 0
        for gid, node, data in tokens.rows(batches, "gid", "node", other):
            t = np.frombuffer(data, np.uint32).astype(np.uint64)
            out.append((mixed(t + mixed(np.array([gid], np.int64).view(np.uint64), 4)).view(np.int64), np.full(len(t), node, np.int64)))
            size += len(t)
            if size >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["token", "node"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["token", "node"])

    exploded = rows.filter(F.col("of_all") > CUT_FROM).select("gid", "node").join(sets.select("node", other), "node").mapInArrow(cut, "token long, node long")
    new = sharing_groups(exploded).select("gid", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return common.materialise(rows.filter(F.col("of_all") <= CUT_FROM).select("gid", "node", "comp").unionByName(new), "refined")


def comparisons(members: DataFrame, sets: DataFrame, labels: DataFrame, across: bool) -> DataFrame:
    """task, node: who is compared in which task, at most TOGETHER sets or two blocks of them.

    ``members`` has gid, node, comp. A large group is cut into blocks: blocks of one
    component each for components with many members, mixed blocks for the rest. With
    ``across`` all blocks meet but those of one and the same component; without it a
    block stays alone.
    """
    for turn in range(MORE_ORDERS + 1):
        sizes, groups = group_sizes(members)
        largest = groups.agg(F.max("of_all")).first()[0] or 0
        if not across or largest <= CUT_FROM or turn == MORE_ORDERS:
            break
        members = refined(members, sets, labels, turn)
    rows = common.with_groups(members, groups, ["gid"], "of_all")
    small = rows.filter(F.col("of_all") <= TOGETHER).select(F.xxhash64("gid").alias("task"), "node")
    if largest <= TOGETHER:
        return small
    large = common.materialise(rows.filter(F.col("of_all") > TOGETHER), "large")
    large = common.with_groups(large, sizes, ["gid", "comp"], "of_comp")
    own = F.col("of_comp") >= BLOCK // 2
    blocks = F.ceil(F.when(own, F.col("of_comp")).otherwise(F.col("of_all")) / BLOCK)
    large = large.select("gid", "node", F.when(own, F.col("comp")).alias("pure"), F.pmod(F.xxhash64("node", "gid"), blocks).alias("block"))
    if not across:
        return small.unionByName(large.select(F.xxhash64("gid", "pure", "block").alias("task"), "node"))
    labels = large.select("gid", "pure", "block").distinct()
    a, b = (labels.select("gid", *(F.col(c).alias(f"{c}_{side}") for c in ("pure", "block"))) for side in "ab")
    order = F.struct(F.col("pure_a").isNull(), F.coalesce("pure_a", F.lit(0)), "block_a") <= F.struct(F.col("pure_b").isNull(), F.coalesce("pure_b", F.lit(0)), "block_b")
    pairs = a.join(b, "gid").filter(order & ~F.coalesce(F.col("pure_a") == F.col("pure_b"), F.lit(False)))
    pairs = pairs.withColumn("task", F.xxhash64("gid", "pure_a", "block_a", "pure_b", "block_b"))
    sides = pairs.select("gid", "task", F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"pure_{s}").alias("pure"), F.col(f"block_{s}").alias("block")) for s in "ab")))).alias("side"))
    sides = sides.select("gid", "task", "side.pure", "side.block")
    on = (large["gid"] == sides["gid"]) & large["pure"].eqNullSafe(sides["pure"]) & (large["block"] == sides["block"])
    return small.unionByName(large.join(sides, on).select("task", "node"))


class Forest:
    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def sharing(sets: list[np.ndarray]) -> np.ndarray:
    """Which of some token sets share a token with which, as a matrix."""
    out = np.zeros((len(sets), len(sets)), bool)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    length = np.diff(edges)
    two = edges[:-1][length == 2]
    out[owner[two], owner[two + 1]] = True
    known = set()
    for at in np.flatnonzero(length > 2):
        group = owner[edges[at] : edges[at + 1]]
        if (key := group.tobytes()) not in known:
            known.add(key)
            out[np.ix_(group, group)] = True
    return out | out.T


def candidates(node: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: list[np.ndarray], others: list[list[np.ndarray]], forest: bool, percent: int = PERCENT) -> list[tuple[int, int]]:
    """The pairs of a task, which share a token of the first order, that pass all filters.

    They share a token under each of the other orders too (``others``: every member's tokens
    under each), are of different components, near in size, with few differing parities.
    With ``forest`` only those that connect components not yet connected, likeliest first.
    """
    a, b = np.triu_indices(len(node), 1)
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    keep = (comp[a] != comp[b]) & (100 * low >= percent * high)
    a, b = a[keep], b[keep]
    for sets in others:
        if len(a):
            keep = sharing(sets)[a, b]
            a, b = a[keep], b[keep]
    if not len(a):
        return []
    # At similarity s = o / (na + nb - o) the sets differ in na + nb - 2 o shingles.
    total = n[a] + n[b]
    most = total - 2 * (-(-percent * total // (100 + percent)))
    differ = np.zeros(len(a), np.int64)
    width = np.array([len(x) for x in bits])
    common_width = np.minimum(width[a], width[b])
    for w in np.unique(common_width):
        at = np.flatnonzero(common_width == w)
        used = np.unique(np.concatenate([a[at], b[at]]))
        table = np.zeros((len(node), w), np.uint8)
        for i in used:
            x = bits[i]
            while len(x) > w:
                x = fold(x)
            table[i] = x
        step = max(1, 8_000_000 // int(w))
        for s in range(0, len(at), step):
            part = at[s : s + step]
            differ[part] = np.bitwise_count(table[a[part]] ^ table[b[part]]).sum(1)
    keep = differ <= most
    a, b, rank = a[keep], b[keep], differ[keep] / total[keep]
    if not forest:
        return list(zip(node[a].tolist(), node[b].tolist(), strict=True))
    known, tree = np.unique(comp, return_inverse=True)
    trees, out = Forest(len(known)), []
    for i in np.argsort(rank, kind="stable"):
        if trees.join(int(tree[a[i]]), int(tree[b[i]])):
            out.append((int(node[a[i]]), int(node[b[i]])))
    return out


def candidate_pairs(tasks: DataFrame, sets: DataFrame, labels: DataFrame, forest: bool, percent: int = PERCENT) -> DataFrame:
    """a, b (a < b) from the comparisons of all tasks."""
    others = [f"other{i}" for i in range(MORE_ORDERS)]
    labelled = sets.select("node", "n", *others, "bits").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = tasks.join(labelled, "node").select("task", "node", "comp", "n", *others, "bits")

    def compare(batches):
        out: list[tuple[int, int]] = []
        held: list[tuple] = []
        task = None

        def close():
            if len(held) > 1:
                node, comp, n = (np.array(c, np.int64) for c in zip(*(r[:3] for r in held), strict=True))
                further = [[np.frombuffer(r[3 + i], np.uint32) for r in held] for i in range(MORE_ORDERS)]
                out.extend(candidates(node, comp, n, [np.frombuffer(r[-1], np.uint8) for r in held], further, forest, percent))

        def flush():
            pairs = {(min(p), max(p)) for p in out}
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*pairs, strict=True) if pairs else ([], []))], names=["a", "b"])

        for row in tokens.rows(batches, "task", "node", "comp", "n", *others, "bits"):
            if row[0] != task:
                close()
                task, held = row[0], []
                if len(out) > 20_000:
                    yield flush()
            held.append(row[1:])
        close()
        yield flush()

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "a long, b long").distinct()


# -- verification and components -------------------------------------------------------------


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def verified(pairs: DataFrame, sets_of: DataFrame, docs: DataFrame, seed: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs whose whole sets link, by an exact count, written down.

    Only documents whose ids are marked are read again as sets; a mark may stand for
    more than one id.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = common.materialise(sets_of.select("node", "doc_id").join(ends, "node", "left_semi"), "ends")
    marks = table_size(32 * ids.count(), MOST_MARKS)
    place = lambda ids: slot_of(mixed(ids.fill_null(-1).to_numpy().view(np.uint64)), marks)

    def mark(batches, table):
        for batch in batches:
            table[place(batch.column(0))] = 1

    fetch = docs.sparkSession.sparkContext.broadcast(summed_slots(ids.select("doc_id"), marks, mark) > 0)

    def sets(batches):
        known, wanted, seen = WordHashes(seed), fetch.value, set()
        for batch in batches:
            hits = batch.filter(pa.array(wanted[place(batch.column(0))]))
            for s in range(0, hits.num_rows, 500):
                rows = []
                for (text,) in tokens.rows([hits.slice(s, 500)], "text"):
                    h = shingles(text, known, words)
                    node = xxhash.xxh3_64_intdigest(h.tobytes(), seed) - (1 << 63)
                    if len(h) and node not in seen:
                        if len(seen) < 100_000:
                            seen.add(node)
                        rows.append((node, h.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 2, (pa.int64(), pa.binary()), strict=True)], names=["node", "shingles"])

    whole = docs.select("doc_id", "text").mapInArrow(sets, "node long, shingles binary").join(ends, "node", "left_semi").dropDuplicates(["node"])
    whole = common.materialise(whole, "sets")
    fetch.destroy()
    side = lambda p: whole.select(F.col("node").alias(p), F.col("shingles").alias(f"of_{p}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b")

    def check(batches):
        for batch in batches:
            keep = [links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in tokens.rows([batch], "of_a", "of_b")]
            good = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([good.column("a"), good.column("b")], names=["a", "b"])

    good = common.materialise(both.mapInArrow(check, "a long, b long"), "verified")
    common.discard(ids, whole)
    return good


def components(pairs: DataFrame) -> DataFrame:
    """node, comp for every node of a link: comp is the smallest node of its component.

    Alternates large-star and small-star steps, which shorten every path to a star;
    each step is written down. Nodes' neighbours are never gathered in a list.
    """
    mark = lambda edges: edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = common.materialise(pairs.select("a", "b").filter("a <> b").distinct(), "links")
    before = mark(edges)
    while before[0]:
        # Large star: larger neighbours go to the smallest of the neighbourhood.
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = common.materialise(large, "large-star")
        # Small star: a node and its smaller neighbours go to the smallest of these.
        smaller = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = smaller.groupBy("u").agg(F.min("v").alias("m"))
        small = smaller.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).filter("a <> b").distinct()
        edges = common.materialise(small, "small-star")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, row_key, n, node) and the sets (node, rows, comp, low: smallest doc_id)."""
    docs = docs.select("doc_id", "text")
    common.small_batches(docs.sparkSession)
    seed = 0
    while True:
        rarity = frequencies(docs, seed, words)
        found = profiles(docs, rarity, seed, words, percent)
        # A node stands for one set: where two hashes disagree, all are made anew.
        if not found.groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).filter("x <> y").take(1):
            break
        seed += 2
    rows = common.materialise(found.select("doc_id", "row_key", "n", "node"), "rows")
    sets = common.materialise(found.filter("bits IS NOT NULL").drop("row_key", "check").dropDuplicates(["node"]), "sets")
    common.discard(found)
    members = common.materialise(memberships(sets), "members")
    labels = rows.sparkSession.createDataFrame([], "node long, comp long")
    # A forest within each group and block, a forest across blocks, then every pair that is
    # left between components: the first two join what is clearly one, so few are left.
    for across, forest in ((False, True), (True, True), (True, False)):
        with_comp = (members if across else strongest_groups(members)).join(labels, "node", "left").select("gid", "node", F.coalesce("comp", "node").alias("comp"))
        with_comp = common.materialise(with_comp, "labelled")
        tasks = common.materialise(comparisons(with_comp, sets, labels, across), "tasks")
        pairs = common.materialise(candidate_pairs(tasks, sets, labels, forest, percent), "pairs")
        common.discard(with_comp, tasks)
        if pairs.isEmpty():
            continue
        good = verified(pairs, sets, docs, seed, words, percent)
        # What was joined before is a star for each component.
        labels = components(good.unionByName(labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
        common.discard(pairs)
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows")).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = common.materialise(classes.select("node", "rows", "comp", "low"), "classes")
    common.discard(sets, members)
    return rows, classes


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Sets are the distinct shingles of ``words`` words of the whole text, A-Z lower-cased;
    a text with fewer words is one shingle, null and blank texts have none and link with nothing.
    Links are exact: every pair of sets that can link shares a prefix token under each
    order, and pairs that pass are counted on whole sets. Pairs already known to be in one
    component are not compared. component_id is the smallest doc_id of the component,
    null ids aside (null if it has no other). Repeated rows are in one component; rows of
    one id with different texts are told apart by their sets. No rows in, no rows out;
    other columns are ignored.
    """
    rows, classes = linked(docs, words, percent)
    lowest = classes.groupBy("comp").agg(F.min("low").alias("component"))
    groups = common.materialise(classes.select("node", "rows", "comp").join(lowest, "comp").select("node", "rows", "component"), "components")
    out = common.with_groups(rows, groups, ["node"], "rows")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, with the columns of ``docs`` under any names: of each component
    the one with the smallest id (null last), and all that link with nothing.

    Of rows that repeat both id and text one stays, always the same. Null and blank texts link with
    nothing and stay; no rows in, no rows out.
    """
    rows, classes = linked(docs, words, percent)
    labelled = common.with_groups(rows, classes.select("node", "rows", "comp"), ["node"], "rows")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    stays = labelled.filter("n > 0").groupBy("comp").agg(first).select("first.doc_id", "first.row_key")
    stays = common.materialise(stays.union(rows.filter("n = 0").select("doc_id", "row_key").distinct()), "stays").toDF("stays", "stays_key")
    packed_rows = docs.select(common.whole_row(docs).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    found = packed_rows.join(stays, F.col("id").eqNullSafe(F.col("stays")) & (F.col("key") == F.col("stays_key")), "left_semi")
    if rows.groupBy("doc_id", "row_key").count().filter("count > 1").take(1):
        found = common.first_of_each(found, ["id", "key"])
    return found.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), WORDS, PERCENT)
