"""Operator 3: class-based bigram model with exchange clustering."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Words that every task holds with their counts; the others are joined.
COMMON_WORDS = 131_072
#: The exchange moves the most frequent words one by one. The other common words then
#: take the class that fits their neighbours best, in Spark; words that are not common
#: (unknown ones too) are moved in groups by their last letters. Numbers of units are fixed.
OWN_UNITS, ENDING_GROUPS = 12_288, 4_096
CLASSES, ROUNDS, BATCHES = 64, 3, 4
WIDTH = CLASSES + 1
#: Weight of a class's overall share against its share after the class before.
BACK_OFF = 5.0
HELD = 250_000

FOLDS, HELD_OUT = 7, 2
END = COMMON_WORDS + ENDING_GROUPS  # the end token's unit, which has a class of its own


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: bytes know only the ASCII letters and blanks."""
    return (text or "").encode().lower().split()


def ending_group(word: bytes) -> int:
    """A group by the word's last three letters (of UTF-8, so whole ones)."""
    ending = word[-3:] if word.isascii() else word.decode(errors="replace")[-3:].encode()
    return COMMON_WORDS + xxhash.xxh3_64_intdigest(ending) % ENDING_GROUPS


@dataclass(frozen=True)
class Vocabulary:
    """The common words by rank of frequency, as tasks hold them."""

    index: dict[bytes, int]
    counts: np.ndarray

    def units_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For each word its index (-1: not common) and its unit; and the words not common."""
        index = np.fromiter(map(_Index(self.index).__getitem__, words), np.int64, len(words))
        units = index.copy()
        rare = np.flatnonzero(index < 0)
        rest = [words[i] for i in rare]
        units[rare] = list(map(ending_group, rest))
        return index, units, rest


class _Index:
    def __init__(self, index: dict[bytes, int]):
        self.get = index.get

    def __getitem__(self, word: bytes) -> int:
        return self.get(word, -1)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n, unit over the training documents (the end token is not among them)."""

    def count(batches):
        held: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return batch

        for doc_id, text in tokens.rows(batches, "doc_id", "text"):
            if fold(doc_id) != HELD_OUT:
                held.update(words_of(text))
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, common_words: int = COMMON_WORDS) -> Vocabulary:
    found = common.most_frequent(counts.select("word", "n"), "n", common_words).toArrow()
    most = sorted(zip(found.column("n").to_pylist(), found.column("word").to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    words = [w for _, w in most]
    return Vocabulary({w: i for i, w in enumerate(words)}, np.array([*(n for n, _ in most), 0], dtype=np.int64))


def unit_totals(counts: DataFrame, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of every unit over the training documents."""
    held = counts.sparkSession.sparkContext.broadcast(known)

    def attach(batches):
        for batch in batches:
            _, units, _ = held.value.units_of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(units), batch.column(1)], names=["unit", "n"])

    rows = counts.select("word", "n").mapInArrow(attach, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toArrow()
    n, words = np.zeros(END + 1, np.int64), np.zeros(END + 1, np.int64)
    at = rows.column("unit").to_numpy()
    n[at], words[at] = rows.column("n").to_numpy(), rows.column("words").to_numpy()
    return n, words


def unit_sequences(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """seq: the units of training documents, each closed by END, many documents in a row."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def encode(batches):
        parts, size = [], 0
        for doc_id, text in tokens.rows(batches, "doc_id", "text"):
            if fold(doc_id) == HELD_OUT:
                continue
            units = held.value.units_of(words_of(text))[1]
            parts += [units.astype("<u4"), np.array([END], "<u4")]
            size += len(units) + 1
            if size >= 200_000:
                yield pa.RecordBatch.from_pydict({"seq": pa.array([np.concatenate(parts).tobytes()], pa.binary())})
                parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_pydict({"seq": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(encode, "seq binary")


def summed(df: DataFrame, size: int, count) -> np.ndarray:
    """The sum over all tasks of the tables of ``size`` cells that ``count(batches)`` makes."""

    def own(batches):
        table = count(batches)
        at = np.flatnonzero(table)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part])], names=["cell", "n"])

    rows = df.mapInArrow(own, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size, np.int64)
    table[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return table


def contexts(sequences: DataFrame, classes: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class bigrams, and how often each unit of ``batch`` follows, and precedes, each class."""
    cells, square = len(batch) * WIDTH, WIDTH * WIDTH
    place = np.full(END + 1, -1, np.int32)
    place[batch] = np.arange(len(batch))
    held = sequences.sparkSession.sparkContext.broadcast((classes.astype(np.uint8), place))

    def count(batches):
        of, at = held.value
        table = np.zeros(square + 2 * cells, np.int64)
        for (seq,) in tokens.rows(batches, "seq"):
            unit = np.frombuffer(seq, "<u4").astype(np.int64)
            last = np.concatenate([[END], unit[:-1]])
            now, then = of[unit].astype(np.int64), of[last].astype(np.int64)
            table[:square] += np.bincount(then * WIDTH + now, minlength=square)
            for shift, who, near in ((square, unit, then), (square + cells, last, now)):
                rows = at[who].astype(np.int64)
                mine = rows >= 0
                table[shift : shift + cells] += np.bincount(rows[mine] * WIDTH + near[mine], minlength=cells)
        return table

    table = summed(sequences, square + 2 * cells, count)
    held.destroy()
    return table[:square].reshape(WIDTH, WIDTH), table[square : square + cells].reshape(-1, WIDTH), table[square + cells :].reshape(-1, WIDTH)


def first_classes(totals: np.ndarray) -> np.ndarray:
    """The most frequent units have a class each, all others share the last one."""
    classes = np.full(END + 1, CLASSES - 1)
    classes[np.argsort(-totals[:END], kind="stable")[: CLASSES - 1]] = np.arange(CLASSES - 1)
    classes[END] = CLASSES
    return classes


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-9))


def likelihood(follows: np.ndarray) -> float:
    """The class model's log-likelihood, but for a part that no exchange changes."""
    follows = follows.astype(float)
    return float(_xlogx(follows).sum() - _xlogx(follows.sum(0)).sum() - _xlogx(follows.sum(1)).sum())


def gains(follows: np.ndarray, sums: np.ndarray, n: float, ins: np.ndarray, outs: np.ndarray) -> np.ndarray:
    """What the likelihood gains if a unit that is in no class now joins each class.

    ``ins[c]`` and ``outs[c]`` count it behind and ahead of class c. Cells of a row and a
    column change, and where they cross by both counts.
    """
    i, o, same = np.flatnonzero(ins), np.flatnonzero(outs), np.diagonal(follows)
    column = _xlogx(follows[i, :] + ins[i, None]) - _xlogx(follows[i, :])
    row = _xlogx(follows[:, o] + outs[None, o]) - _xlogx(follows[:, o])
    gain = column.sum(0) + row.sum(1)
    gain[i] -= column[np.arange(len(i)), i]
    gain[o] -= row[o, np.arange(len(o))]
    return gain + _xlogx(same + ins + outs) - _xlogx(same) - 2 * (_xlogx(sums + n) - _xlogx(sums))


def exchange(classes: np.ndarray, totals: np.ndarray, follows: np.ndarray, batch: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Moves each unit of a batch, most frequent first, to the class that makes the text likeliest.

    ``after`` and ``before`` are counted for the classes at the batch's begin; class
    bigrams and totals follow every move. Neighbours within a batch may move too, so
    whoever calls this has to see whether the likelihood has risen.
    """
    classes, follows = classes.copy(), follows.astype(float)
    sums = np.bincount(classes, totals, WIDTH).astype(float)
    for k in np.argsort(-totals[batch], kind="stable"):
        u, n, ins, outs = batch[k], totals[batch[k]], after[k], before[k]
        if not n:
            break
        old = classes[u]
        follows[:, old] -= ins
        follows[old, :] -= outs
        np.maximum(follows, 0, out=follows)
        sums[old] -= n
        new = int(np.argmax(gains(follows, sums, n, ins, outs)[:CLASSES]))
        classes[u] = new
        follows[:, new] += ins
        follows[new, :] += outs
        sums[new] += n
    return classes


def best_classes(sequences: DataFrame, classes: np.ndarray, totals: np.ndarray, follows: np.ndarray, first: int, last: int) -> np.ndarray:
    """Classes in which the units from ``first`` to ``last`` - 1 are each moved to the one that fits best.

    Every unit is judged by itself, in Spark, with all others where they are; its
    neighbours' classes are summed by unit. Only the new classes come to the driver.
    """
    held = sequences.sparkSession.sparkContext.broadcast((classes.astype(np.uint8), follows.astype(float), np.bincount(classes, totals, WIDTH).astype(float)))
    near = 2 * WIDTH

    def count(batches):
        of = held.value[0]
        for (seq,) in tokens.rows(batches, "seq"):
            unit = np.frombuffer(seq, "<u4").astype(np.int64)
            before = np.concatenate([[END], unit[:-1]])
            cells = []
            for who, beside, shift in ((unit, before, 0), (before, unit, WIDTH)):
                mine = (who >= first) & (who < last)
                cells.append(who[mine] * near + shift + of[beside[mine]])
            cell, n = np.unique(np.concatenate(cells), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell // near), pa.array(cell % near), pa.array(n)], names=["unit", "cell", "n"])

    def choose(batches):
        of, table, totals_of = held.value
        unit, ins_outs = None, np.zeros(near)

        def best():
            old, ins, outs = int(of[unit]), ins_outs[:WIDTH], ins_outs[WIDTH:]
            n, left, sums = ins.sum(), table.copy(), totals_of.copy()
            left[:, old] -= ins
            left[old, :] -= outs
            sums[old] -= n
            return int(unit), int(np.argmax(gains(np.maximum(left, 0), np.maximum(sums, 0), n, ins, outs)[:CLASSES]))

        for batch in batches:
            units, cell, n = (c.to_numpy() for c in batch.columns)
            found, edges = [], np.concatenate([[0], np.flatnonzero(units[1:] != units[:-1]) + 1, [len(units)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if units[a] != unit:
                    if unit is not None:
                        found.append(best())
                    unit, ins_outs = units[a], np.zeros(near)
                ins_outs += np.bincount(cell[a:b], n[a:b], minlength=near)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["unit", "class"])
        if unit is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in best()], names=["unit", "class"])

    cells = sequences.mapInArrow(count, "unit long, cell long, n long").groupBy("unit", "cell").agg(F.sum("n").alias("n"))
    found = cells.repartition("unit").sortWithinPartitions("unit").mapInArrow(choose, "unit long, class long").toArrow()
    held.destroy()
    out = classes.copy()
    out[found.column("unit").to_numpy()] = found.column("class").to_numpy()
    return out


def clustered(sequences: DataFrame, totals: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all units, their bigrams, and the likelihood after each step that was kept.

    Every step's exact likelihood is counted, and a step that lowers it is undone.
    """
    own = np.array([u for u in np.argsort(-totals[:END], kind="stable") if totals[u] and (u < OWN_UNITS or u >= COMMON_WORDS)], dtype=np.int64)
    batches = [own[i::BATCHES] for i in range(BATCHES)]
    classes = kept = first_classes(totals)
    # Steps in turn: batches of the exchange, and before the last round the other common words.
    steps = [b for r in range(rounds) for b in (*([None] if r == rounds - 1 and totals[OWN_UNITS:COMMON_WORDS].any() else []), *batches)]
    follows, history = None, []
    for batch in [*steps, np.zeros(0, np.int64)]:
        while True:
            found = contexts(sequences, classes, np.zeros(0, np.int64) if batch is None else batch)
            risen = not history or likelihood(found[0]) >= history[-1] - 1e-6
            if risen:
                follows, kept = found[0], classes
                history.append(likelihood(follows))
                break
            classes = kept
            history.pop()
        if batch is None:
            classes = best_classes(sequences, classes, totals, follows, OWN_UNITS, COMMON_WORDS)
        elif len(batch):
            classes = exchange(classes, totals, follows, batch, *found[1:])
    return kept, follows, history


@dataclass(frozen=True)
class Model:
    """What scoring needs, all of a fixed size."""

    known: Vocabulary
    classes: np.ndarray  # by unit
    transition: np.ndarray  # log10 P(class | class before)
    room: np.ndarray  # log10 of each class's tokens + words + 1, by class; 0 for the end token
    n: int  # training tokens, ends counted
    v: int  # distinct training tokens
    ends: int


def train(docs: DataFrame, common_words: int = COMMON_WORDS, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the table of all training words with their counts (word, n).

    Counts, classes and transitions come from every training document. Tables whose
    size depends on the corpus stay in Spark; the driver gets the common words and
    tables of (units x classes), whose sizes are fixed.
    """
    counts = common.materialise(word_counts(docs), "words")
    known = vocabulary(counts, common_words)
    totals, distinct = unit_totals(counts, known)
    sequences = common.materialise(unit_sequences(docs, known), "sequences")
    ends = docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT).count()
    totals[END], distinct[END] = ends, int(ends > 0)
    classes, follows, _ = clustered(sequences, totals, rounds)
    width = WIDTH
    tokens_in, words_in = np.bincount(classes, totals, width), np.bincount(classes, distinct, width)
    # One more for each class, as an unknown word can be of any but the end's.
    share = (tokens_in + 1) / (tokens_in.sum() + width)
    transition = np.log10((follows + BACK_OFF * share[None, :]) / (follows.sum(1, keepdims=True) + BACK_OFF))
    room = np.log10(tokens_in + words_in + 1)
    room[CLASSES] = 0.0
    return Model(known, classes, transition, room, int(totals.sum()), int(distinct.sum()), ends), counts


def score(docs: DataFrame, common_words: int = COMMON_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    score is the sum of log10 P(class | class before) + log10 P(word | class); a word
    of class k has (count + 1) / (tokens + words + 1 of k), an unknown word the last 1. The
    end token has a class of its own, which also stands before the first word.
    Null text counts as empty, which is one token. A null id has the empty string for
    its text, so it is a training document. Repeated rows are documents of their own.
    No rows in, no rows out; with no training documents all words are unknown.
    Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    common.small_batches(docs.sparkSession)
    model, counts = train(docs, common_words, rounds)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def local(batches):
        m = held.value
        log_count = np.log10(m.known.counts + 1.0)
        rows: list[tuple] = []
        words_left: list[bytes] = []
        times: list[int] = []
        ends = [0]

        def flush():
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)]
            rare = pa.StructArray.from_arrays([pa.array(words_left, pa.binary()), pa.array(times, pa.int64())], names=["word", "times"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)
            for c in (rows, words_left, times):
                c.clear()
            ends[:] = [0]
            return pa.RecordBatch.from_arrays([*columns, lists], names=[*schema.names, "rare"])

        for doc_id, text in tokens.rows(batches, "doc_id", "text"):
            words = words_of(text)
            index, units, rest = m.known.units_of(words)
            classes = np.concatenate([[CLASSES], m.classes[units], [CLASSES]])
            # What is left out here is log10(count + 1) of the words that are not common.
            emitted = float(log_count[index].sum())
            end = float(np.log10(m.ends + 1.0))
            base = emitted + end - (len(words) + 1) * float(np.log10(m.n + m.v + 1.0))
            value = emitted + float(m.transition[classes[:-1], classes[1:]].sum()) - float(m.room[classes[1:]].sum())
            same = xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63)
            # No word holds a blank, so the row of a text without other words finds no partner.
            counted = Counter(rest) or {b" %d" % same: 0}
            words_left.extend(counted.keys())
            times.extend(counted.values())
            ends.append(len(words_left))
            rows.append((doc_id, same, len(words) + 1, len(words) - len(rest) + int(m.ends > 0), base, value))
            if len(words_left) >= 50_000:
                yield flush()
        yield flush()

    # A row for each text, its other words as a list; the first of them carries the text's own sums.
    found = docs.mapInArrow(local, "doc_id long, same long, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, times: long>>")
    sums = ("n_tokens", "n_known", "base", "score")
    rows = found.select("doc_id", "same", *sums, F.posexplode("rare").alias("at", "other"))
    first = F.col("at") == 0
    rows = rows.select("doc_id", "same", "other.word", "other.times", F.when(first, 1).alias("is_row"), *(F.when(first, F.col(c)).alias(c) for c in sums))
    joined = rows.join(counts.select("word", F.col("n").alias("count")), "word", "left")
    more = F.sum(F.col("times") * F.coalesce(F.log10(F.col("count") + 1), F.lit(0.0)))
    known = F.sum("n_known") + F.sum(F.when(F.col("count").isNotNull(), F.col("times")).otherwise(0))
    # Rows that repeat id and text share a group; each has its part of the sums.
    repeats = F.sum("is_row")
    summed = joined.groupBy("doc_id", "same").agg(
        repeats.cast("int").alias("repeats"), (F.sum("n_tokens") / repeats).cast("long").alias("n_tokens"), (known / repeats).cast("long").alias("n_known"),
        ((F.sum("base") + more) / repeats).alias("base_score"), ((F.sum("score") + more) / repeats).alias("score"),
    )
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    each = common.repeated(summed, "repeats")
    return each.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
