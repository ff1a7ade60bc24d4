"""Operator 4: token counts from pieces counted once per distinct pre-token."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

LIMIT = 1024
#: The pre-tokens whose piece counts every task holds. The others are joined.
COMMON_PIECES = 131_072
#: Distinct pre-tokens that a task counts before it hands them on.
HELD = 250_000


def pre_token_counts(docs: DataFrame, path: str) -> DataFrame:
    """piece, occurrences: every distinct pre-token of all texts."""

    def count(batches):
        cut, held = tokens.splitter(path), Counter()

        def flush():
            batch = pa.RecordBatch.from_pydict({"piece": list(held), "occurrences": pa.array(held.values(), pa.int64())}, schema=out)
            held.clear()
            return batch

        out = pa.schema([("piece", pa.string()), ("occurrences", pa.int64())])
        for (text,) in tokens.rows(batches, "text"):
            held.update(cut.parts(text or "")[0])
            if len(held) >= HELD:
                yield flush()
        yield flush()

    partial = docs.select("text").mapInArrow(count, "piece string, occurrences long")
    return partial.groupBy("piece").agg(F.sum("occurrences").alias("occurrences"))


def piece_lengths(counts: DataFrame, path: str) -> DataFrame:
    """Adds ``ids``: how many ids a pre-token has, found once for each."""

    def measure(batches):
        cut = tokens.splitter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut.lengths(batch.column(0).to_pylist()), pa.int64())], names=["piece", "occurrences", "ids"])

    return counts.mapInArrow(measure, "piece string, occurrences long, ids long")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, common_pieces: int = COMMON_PIECES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Counts equal those of the tokenizers library with the file at ``path``, without
    added special tokens; special strings inside a text are one token each. Null text
    counts as empty (0 bytes, 0 tokens). Repeated rows and null ids are counted like
    any other; other columns are ignored; no rows in, no rows out.

    Distinct pre-tokens are counted over all texts and measured once. The
    ``common_pieces`` most frequent lengths (a fixed number) go to every task, which
    also keeps frequent ones out of the join; documents' frequencies of all others are
    joined to their lengths and summed. No ids of a document are ever made.
    """
    path = path or tokens.default_path()
    lengths = common.materialise(piece_lengths(pre_token_counts(docs, path), path), "pieces")
    most = common.most_frequent(lengths, "occurrences", common_pieces).select("piece", "ids").toPandas()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(most["piece"].tolist(), most["ids"].tolist(), strict=True)))
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("piece", pa.string()), ("times", pa.int64()), ("is_row", pa.int64()), ("n_bytes", pa.int64()), ("n", pa.int64())])

    def frequencies(batches):
        cut, lengths = tokens.splitter(path), known.value
        get = lengths.get
        out: list[list] = [[] for _ in schema]

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            for c in out:
                c.clear()
            return batch

        for doc_id, text in tokens.rows(batches, "doc_id", "text"):
            raw = (text or "").encode()
            same = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
            found, n = cut.parts(text or "")
            rest = []
            for piece in found:
                k = get(piece)
                if k is None:
                    rest.append(piece)
                else:
                    n += k
            # No pre-token is a zero byte with digits, so the row of a text whose
            # pre-tokens are all common finds no partner.
            times = Counter(rest) or {f"\x00{same}": 0}
            m = len(times)
            for c, values in zip(out, ([doc_id] * m, [same] * m, times.keys(), times.values(), [1] + [0] * (m - 1), [len(raw)] * m, [n] + [0] * (m - 1)), strict=True):
                c.extend(values)
            if len(out[0]) >= 50_000:
                yield flush()
        yield flush()

    rows = docs.select("doc_id", "text").mapInArrow(frequencies, "doc_id long, same long, piece string, times long, is_row long, n_bytes long, n long")
    joined = rows.join(lengths.select("piece", "ids"), "piece", "left")
    n = F.sum(F.col("n") + F.col("times") * F.coalesce("ids", F.lit(0)))
    # Rows that repeat id and text share a group; each has its part of the sum.
    summed = joined.groupBy("doc_id", "same").agg(F.max("n_bytes").alias("n_bytes"), n.alias("n"), F.sum("is_row").cast("int").alias("repeats"))
    each = common.repeated(summed, "repeats").select("doc_id", "n_bytes", F.expr("n div repeats").alias("n_tokens"))
    return each.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
