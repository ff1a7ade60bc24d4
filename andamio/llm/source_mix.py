"""Operator 8: mixing sources to target weights by blocks of tokens (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words in a block, slots in an output shard, rows in a bucket of a source's stream.
BLOCK_WORDS, SHARD_SLOTS, BUCKET_ROWS = 64, 4096, 500
#: How often a source may be repeated, and the weights that sources take in turn.
MOST_COPIES, WEIGHTS = 3, (1, 2, 3)
#: What draws and permutations start from; rounds of a permutation.
SEED, ROUNDS = 7, 12
#: A prime below 2^31 and a factor, for the bit that decides a round.
PRIME, FACTOR = 2_147_483_629, 1_103_515_245
#: Shards, or sources, that one window sums up at a time; slots for each part of the draw's look-up.
TOGETHER, SLOTS_A_PART = 1024, 4096


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Hexadecimal digits that put the documents of a source in order, at random."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def number(*parts: Column) -> Column:
    """A number below 2^48, at random, that these parts decide."""
    digits = F.md5(F.concat_ws("-", *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digits, 1, 12), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), row_key().alias("key"))


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target``: shares of all words by weight, at most MOST_COPIES x size each.

    What a capped source cannot take goes to the others by weight, until none is above
    its cap. Each round sends two sums to the driver, never the sources.
    """
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    cap, level = F.col("source_size") * float(MOST_COPIES), 0.0
    while True:
        held = cap <= F.col("weight") * level
        fixed, weight = sources.agg(F.sum(F.when(held, cap).otherwise(0.0)), F.sum(F.when(held, 0).otherwise(F.col("weight")))).first()
        following = (total - fixed) / weight if weight else level
        if not weight or following <= level * (1 + 1e-12):
            return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(following if weight else float("inf"))))
        level = following


def permuted(index: Column, size: Column, keys: Column) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0..size-1.

    Swap-or-not rounds: a key pairs every index with another, and a bit that the pair
    decides tells whether the two change places. Each round, and so the whole, is a
    permutation for any size. (A fold over the keys, as nested columns would double in
    size with each round.)
    """

    def changed(at: Column, key: Column) -> Column:
        partner = F.pmod(F.pmod(key, size) - at, size)
        bit = F.shiftright((F.greatest(at, partner) % PRIME * FACTOR + key % PRIME) % PRIME, 9) % 2
        return F.when(bit == 1, partner).otherwise(at)

    return F.aggregate(keys, index.cast("long"), changed)


def summed_before(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same keys before this one.

    A running sum in two levels, so no key has to fit in a task: within chunks, then
    over the chunks' sums. Chunks have to rise with the order.
    """
    rows = rows.withColumn("chunk", chunk)
    before = Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "chunk").agg(F.sum(value).alias("in_chunk")).select(*keys, "chunk", F.coalesce(F.sum("in_chunk").over(over), F.lit(0)).alias("ahead"))
    inner = rows.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    return inner.join(sums, [*keys, "chunk"]).withColumn(name, F.col(name) + F.col("ahead")).drop("chunk", "ahead")


def stream_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: the words of the same source before this document, by their keys."""
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    bucket = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets, 32)
    return summed_before(rows, ["rank"], bucket, ["key", "size"], "size", "start")


def prepared(docs: DataFrame, block_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sources with what the deal needs of them; the documents in streams.

    A source's stream is cut into ``full`` blocks of ``block_words`` words and a short one
    of what is left. ``passes`` times it is taken whole, then ``rest`` words more.
    """
    rows = common.materialise(sizes(docs), "sizes")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1)
    sources = targets(common.materialise(sources.withColumn("weight", weight), "sources"))
    words, size = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    sources = sources.withColumn("full", F.floor(F.col("source_size") / block_words)).withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    sources = sources.withColumn("passes", F.floor(words / size)).withColumn("rest", words - F.col("passes") * F.col("source_size"))
    sources = sources.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block_words))
    sources = sources.withColumn("keys", F.array(*(number(F.lit(f"key-{seed}"), F.col("rank"), F.lit(r)) for r in range(ROUNDS))))
    sources = common.materialise(summed_before(sources, [], F.floor(F.col("rank") / TOGETHER), ["rank"], "slots", "first_slot"), "targets")
    named = sources.select(F.col("source").alias("of"), "rank", "rows")
    ranked = ranked_rows(rows, named)
    return sources, common.materialise(stream_starts(ranked), "streams")


def ranked_rows(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds a document's source's rank; null is a source too."""
    known = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    groups = sources.select(F.struct(F.col("of").isNull().alias("none"), F.coalesce("of", F.lit("")).alias("name")).alias("which"), "rank", "rows")
    return common.with_groups(rows.withColumn("which", known), groups, ["which"], "rows").drop("which", "rows")


def draws(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """shard, rank, n: how many of its slots each output shard draws for each source.

    Every slot of a shard draws a source with the odds of the sources' slots, so a
    shard's counts are one multinomial draw; seed and shard decide it.
    """
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    parts = max(1, -(-total // SLOTS_A_PART))
    width = max(1, -(-total // parts))
    slots = sources.sparkSession.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), (F.col("id") % shard_slots).alias("nth"))
    slots = slots.select("shard", F.pmod(number(F.lit(f"draw-{seed}"), F.col("shard"), F.col("nth")), F.lit(max(1, total))).alias("drawn"))
    slots = slots.withColumn("part", F.floor(F.col("drawn") / width))
    last = F.col("first_slot") + F.col("slots")
    spans = sources.filter("slots > 0").select("rank", "first_slot", last.alias("last_slot"), F.explode(F.sequence(F.floor(F.col("first_slot") / width), F.floor((last - 1) / width))).alias("part"))
    met = slots.hint("merge").join(spans, "part").filter("drawn >= first_slot AND drawn < last_slot")
    return met.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n"))


def deal(sources: DataFrame, shard_slots: int, seed: int, block_words: int) -> DataFrame:
    """shard, rank, k, block, words: which block of which source fills a slot of a shard.

    The draws of all shards together give a source about as many slots as its target
    asks for. To meet the target and never pass MOST_COPIES, what a source draws beyond its
    slots is drawn again, in the order of the shards, for those that drew too few.
    A source's k-th slot has the block at k in its permutation, pass by pass, the short
    block last in each; the very last slot may take the first words of its block only.
    """
    drawn = common.materialise(draws(sources, shard_slots, seed), "draws")
    wanted = sources.select("rank", F.col("slots").alias("of_source"))
    rows = summed_before(common.with_groups(drawn, wanted, ["rank"], "of_source"), ["rank"], F.floor(F.col("shard") / TOGETHER), ["shard"], "n", "k")
    own = F.greatest(F.lit(0), F.least("n", F.col("of_source") - F.col("k")))
    rows = common.materialise(rows.select("shard", "rank", "k", own.alias("own"), (F.col("n") - own).alias("spare")), "own")
    spare = summed_before(rows.filter("spare > 0").select("shard", "rank", "spare"), [], F.floor(F.col("shard") / TOGETHER), ["shard", "rank"], "spare", "i")
    spare = spare.select("shard", F.explode(F.expr("sequence(i, i + spare - 1)")).alias("i"))
    held = rows.groupBy("rank").agg(F.sum("own").alias("held"))
    few = sources.select("rank", "slots").join(held, "rank", "left").select("rank", F.coalesce("held", F.lit(0)).alias("held"), (F.col("slots") - F.coalesce("held", F.lit(0))).alias("short")).filter("short > 0")
    few = summed_before(few, [], F.floor(F.col("rank") / TOGETHER), ["rank"], "short", "i")
    few = few.select("rank", F.posexplode(F.expr("sequence(i, i + short - 1)")).alias("nth", "i"), "held").select("rank", (F.col("held") + F.col("nth")).alias("k"), "i")
    again = spare.hint("merge").join(few, "i").select("shard", "rank", "k")
    slots = rows.filter("own > 0").select("shard", "rank", F.explode(F.expr("sequence(k, k + own - 1)")).alias("k")).unionByName(again)
    slots = common.materialise(slots, "slots")
    of = sources.select("rank", "source_size", "full", "blocks", "passes", "rest", "keys", F.col("slots").alias("of_source"))
    slots = common.with_groups(slots, of, ["rank"], "of_source").withColumn("block", F.col("k") % F.col("blocks"))
    block = F.when(F.col("block") < F.col("full"), permuted(F.col("block"), F.col("full"), F.col("keys"))).otherwise(F.col("full"))
    length = F.when(F.col("block") < F.col("full"), F.lit(block_words)).otherwise(F.col("source_size") - F.col("full") * block_words)
    words = F.when(F.col("k") >= F.col("passes") * F.col("blocks"), F.least(length, F.col("rest") - F.col("block") * block_words)).otherwise(length)
    return slots.select("shard", "rank", "k", block.alias("block"), words.cast("long").alias("words"))


def block_pieces(streams: DataFrame, block_words: int) -> DataFrame:
    """rank, block, start, key, doc_id, at, skip, words: the part of a document in each block it meets.

    ``at`` is where in the block the part begins, ``skip`` where in the document.
    """
    met = streams.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))
    )
    begin = F.greatest("start", F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return met.select("rank", "block", "start", "key", "doc_id", "source", "size", (begin - F.col("block") * block_words).alias("at"), (begin - F.col("start")).alias("skip"), (end - begin).alias("words"))


def taken_pieces(sources: DataFrame, streams: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """The pieces of documents, each with the slots that take words of it: copy, shard, got.

    A block has MOST_COPIES slots at most, so these are short lists; copy counts the
    passes over the source.
    """
    slots = deal(sources, shard_slots, seed, block_words).groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("k", "shard", "words"))).alias("slots"))
    joined = block_pieces(streams, block_words).hint("merge").join(slots, ["rank", "block"])
    each = joined.select(*(c for c in joined.columns if c != "slots"), F.posexplode("slots").alias("copy", "slot"))
    got = F.least(F.col("words"), F.col("slot.words") - F.col("at"))
    return each.select("rank", "start", "key", "doc_id", "source", "size", "copy", F.col("slot.shard").alias("shard"), "skip", got.alias("got")).filter("got > 0")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_shard.

    size counts the words of the text (null or empty: 0, never taken); a null source
    is a source of its own that ranks last. Repeated rows are documents of their own; null ids
    are put in order by their texts. No rows in, no rows out; other columns are ignored.
    A source's taken words are its target, rounded. A document is taken at most
    MOST_COPIES times its size, and reruns take the same. first_shard is the first output
    shard that holds words of the document (-1: none).
    """
    sources, streams = prepared(docs, block_words, seed)
    taken = taken_pieces(sources, streams, block_words, shard_slots, seed).groupBy("rank", "start").agg(F.sum("got").alias("taken"), F.min("shard").alias("first_shard"))
    # Documents without words share their start with the next one.
    rows = streams.withColumn("of", F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.col("start")))
    rows = rows.hint("merge").join(taken.withColumnRenamed("start", "of"), ["rank", "of"], "left")
    rows = common.with_groups(common.materialise(rows, "taken"), sources.select("rank", "source_size", "target", "rows"), ["rank"], "rows")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_shard", F.lit(-1)).cast("long").alias("first_shard"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as documents with the columns of ``docs`` under any names, dealt by output shard.

    A document comes once for each pass that takes a part of it (0 to MOST_COPIES times);
    a copy's text is the taken words with the blanks between them, the whole text in
    all passes but a source's last. n_chars, where there is one, follows the text. Documents
    without words are left out. Repeated rows are documents of their own, a null source is
    a source, null ids go by their texts; no rows in, no rows out.
    """
    sources, streams = prepared(docs, block_words, seed)
    pieces = taken_pieces(sources, streams, block_words, shard_slots, seed)
    spans = pieces.groupBy("rank", "start", "key", "doc_id", "source", "size", "copy").agg(F.array_sort(F.collect_list(F.struct("skip", "got"))).alias("spans"), F.sum("got").alias("got"), F.min("shard").alias("shard"))
    spans = spans.select(
        F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), F.col("key").alias("of_key"), "start", "copy", "shard", F.when(F.col("got") < F.col("size"), F.col("spans")).alias("spans")
    )
    rows = docs.select(common.whole_row(docs).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("from_source"), F.col("text").alias("whole"), row_key().alias("key"))
    if streams.filter("size > 0").groupBy("doc_id", "source", "key").count().filter("count > 1").take(1):
        # Rows that repeat id, source and text: pair them off.
        rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("id", "from_source", "key").orderBy(F.xxhash64("row"))))
        spans = spans.withColumn("of_turn", F.dense_rank().over(Window.partitionBy("of_id", "of_source", "of_key").orderBy("start")))
    else:
        rows, spans = rows.withColumn("turn", F.lit(1)), spans.withColumn("of_turn", F.lit(1))
    on = F.col("id").eqNullSafe(F.col("of_id")) & F.col("from_source").eqNullSafe(F.col("of_source")) & (F.col("key") == F.col("of_key")) & (F.col("turn") == F.col("of_turn"))
    words = F.regexp_extract_all("whole", F.lit(r"[\x20\x09-\x0D]*" + common.WORD), F.lit(0))
    cut = F.array_join(F.transform("spans", lambda s: F.array_join(F.slice(words, s["skip"].cast("int") + 1, s["got"].cast("int")), "")), "")
    made = {"text": F.when(F.col("spans").isNull(), F.col("whole")).otherwise(cut)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.char_length("new_text").cast(docs.schema["n_chars"].dataType)
    out = rows.hint("merge").join(spans, on).select("row", "shard", made.pop("text").alias("new_text")).repartition("shard")
    return out.select(*(F.col("new_text").alias(c) if c == "text" else made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


def _number_sql(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '-' || ".join(parts) + "), 1, 12))::BIGINT"


def _permuted_sql() -> str:
    """The rounds of ``permuted`` over the rows of s0 (index, most, keys)."""
    out, last = "", "slot"
    for r in range(ROUNDS):
        key = f"keys[{r + 1}]"
        out += f"""), p{r} AS (
  SELECT * EXCLUDE (partner, larger, index), CASE WHEN (((larger % {PRIME} * {FACTOR} + {key} % {PRIME}) % {PRIME}) >> 9) % 2 = 1 THEN partner ELSE index END AS index
  FROM (SELECT *, greatest(index, partner) AS larger FROM (SELECT *, ((({key} % most) - index) % most + most) % most AS partner FROM {last}))
"""
        last = f"p{r}"
    return out


#: The same in SQL. The level is found at the first source, by cap over weight, that it
#: leaves below its cap.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight, sum(source_size) OVER () AS total FROM s0
), s2 AS (
  SELECT arg_min((total - fixed) / weight, cap) AS level
  FROM (
    SELECT x.rank, x.total, x.source_size * 3.0 / x.weight AS cap,
      coalesce(sum(CASE WHEN y.source_size * 3.0 / y.weight < x.source_size * 3.0 / x.weight THEN y.source_size * 3.0 END), 0) AS fixed,
      sum(CASE WHEN y.source_size * 3.0 / y.weight < x.source_size * 3.0 / x.weight THEN 0 ELSE y.weight END) AS weight
    FROM s1 x CROSS JOIN s1 y GROUP BY x.rank, x.total, x.source_size, x.weight
  ) WHERE (total - fixed) / weight <= cap * (1 + 1e-12)
), s3 AS (
  SELECT s1.*, least(source_size * 3.0, s1.weight * level) AS target FROM s1 CROSS JOIN s2
), s4 AS (
  SELECT *, source_size // {BLOCK_WORDS} AS "full", ceil(source_size / {BLOCK_WORDS}.0)::BIGINT AS blocks,
    round(target)::BIGINT // greatest(source_size, 1) AS passes, round(target)::BIGINT % greatest(source_size, 1) AS rest FROM s3
), s5 AS (
  SELECT *, passes * blocks + ceil(rest / {BLOCK_WORDS}.0)::BIGINT AS slots,
    list_transform(range({ROUNDS}), lambda r : {_number_sql(f"'key-{SEED}'", "rank::VARCHAR", "r::VARCHAR")}) AS keys FROM s4
), s AS (
  SELECT *, (sum(slots) OVER (ORDER BY rank) - slots)::BIGINT AS first_slot FROM s5
), t AS (
  SELECT sum(slots)::BIGINT AS total FROM s
), drawn AS (
  SELECT id // {SHARD_SLOTS} AS shard, {_number_sql(f"'draw-{SEED}'", f"(id // {SHARD_SLOTS})::VARCHAR", f"(id % {SHARD_SLOTS})::VARCHAR")} % total AS u
  FROM (SELECT total, unnest(range(total)) AS id FROM t)
), counts AS (
  SELECT shard, rank, count(*) AS n FROM drawn JOIN s ON u >= first_slot AND u < first_slot + slots GROUP BY ALL
), own AS (
  SELECT shard, rank, k, greatest(0, least(n, slots - k)) AS own, n - greatest(0, least(n, slots - k)) AS spare
  FROM (SELECT shard, rank, n, slots, (sum(n) OVER (PARTITION BY rank ORDER BY shard) - n)::BIGINT AS k FROM counts JOIN s USING (rank))
), spare AS (
  SELECT shard, row_number() OVER (ORDER BY shard, rank) AS i FROM (SELECT shard, rank, unnest(range(spare)) FROM own)
), few AS (
  SELECT rank, k, row_number() OVER (ORDER BY rank, k) AS i
  FROM (SELECT rank, unnest(range(coalesce(held, 0)::BIGINT, slots)) AS k FROM s LEFT JOIN (SELECT rank, sum(own) AS held FROM own GROUP BY rank) USING (rank))
), taken_slots AS (
  SELECT shard, rank, unnest(range(k, k + own)) AS k FROM own UNION ALL SELECT shard, rank, k FROM spare JOIN few USING (i)
), slot AS (
  SELECT shard, rank, k, k % blocks AS nth, k % blocks AS index, greatest("full", 1) AS most, "full", blocks, passes, rest, source_size, keys FROM taken_slots JOIN s USING (rank)
{_permuted_sql()}), dealt AS (
  SELECT shard, rank, CASE WHEN nth < "full" THEN index ELSE "full" END AS block,
    CASE WHEN k >= passes * blocks THEN least(length, rest - nth * {BLOCK_WORDS}) ELSE length END AS words
  FROM (SELECT *, CASE WHEN nth < "full" THEN {BLOCK_WORDS} ELSE source_size - "full" * {BLOCK_WORDS} END AS length FROM p{ROUNDS - 1})
), streams AS (
  SELECT d.*, rank, source_size, target, (sum(size) OVER (PARTITION BY rank ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), met AS (
  SELECT *, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM streams WHERE size > 0
), pieces AS (
  SELECT rank, start, block, greatest(start, block * {BLOCK_WORDS}) - block * {BLOCK_WORDS} AS ahead, least(start + size, (block + 1) * {BLOCK_WORDS}) - greatest(start, block * {BLOCK_WORDS}) AS words FROM met
), taken AS (
  SELECT rank, start, sum(got)::BIGINT AS taken, min(shard) AS first_shard
  FROM (SELECT p.rank, p.start, shard, least(p.words, x.words - ahead) AS got FROM pieces p JOIN dealt x ON p.rank = x.rank AND p.block = x.block) WHERE got > 0 GROUP BY ALL
)
SELECT doc_id, size, source_size, target::DOUBLE AS target, CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END::BIGINT AS taken, CASE WHEN size > 0 THEN coalesce(first_shard, -1) ELSE -1 END::BIGINT AS first_shard
FROM streams LEFT JOIN taken ON streams.rank = taken.rank AND streams.start = taken.start
"""
