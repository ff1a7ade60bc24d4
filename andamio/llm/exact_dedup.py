"""Operator 6: exact duplicates by recipes of content-defined chunks (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A chunk ends behind a line end, a sentence end before one of some letters, a blank
#: between some letters, a pair of letters and digits that prose seldom has, or one of some
#: characters of other scripts, so a boundary depends on the text around it and not on its
#: place. Where no boundary comes within LONGEST characters the chunk is cut there.
SHORTEST, LONGEST = 512, 8192


def boundary_letters() -> str:
    """Every 16th character of the alphabets from U+0370 to U+1FFF and every 61st from U+2000 to U+FFEF."""
    found = [*range(0x372, 0x2000, 16), *(c for c in range(0x2000, 0xFFF0, 61) if not 0xD800 <= c < 0xE000)]
    return "".join(rf"\x{{{c:04X}}}" for c in found)


def chunk_pattern(shortest: int = SHORTEST, longest: int = LONGEST) -> str:
    ends = rf"\n|[.!?;,] ?(?=[a-h])|[aeiou\d] (?=[a-c])|[jqxz](?=[jqxz\d])|(?=[^\x00-\x{{36F}}])[{boundary_letters()}]|\z"
    return rf"(?s).{{{shortest},{longest}}}?(?:{ends})|.{{1,{longest}}}"


def chunks_of(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The chunks of a text in order; joined they are the text. Empty text: none."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(shortest, longest)), F.lit(0))


#: Chunks in a recipe that may go by broadcast, for the largest groups.
SHORT_RECIPE = 64


def chunk_id(chunk: Column, seed: int) -> Column:
    salted = chunk if seed == 0 else F.concat(chunk, F.lit(f"\x00{seed}"))
    return F.unhex(F.substring(F.sha2(salted, 256), 1, 32))


def ids_are_verified(docs: DataFrame, seed: int, shortest: int = SHORTEST, longest: int = LONGEST, text: str = "norm") -> bool:
    """True if no two different chunks of the whole corpus share an identifier.

    Chunks are made distinct by their text, with map-side combining, so a text that
    repeats moves once per task; the identifiers of distinct texts are then counted.
    """
    distinct = docs.select(F.explode(chunks_of(F.col(text), shortest, longest)).alias("chunk")).distinct()
    clash = distinct.groupBy(chunk_id(F.col("chunk"), seed).alias("id")).count().filter("count > 1")
    return not clash.take(1)


def recipes(docs: DataFrame, seed: int = 0, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """doc_id, text_sha256, recipe: the ordered chunk identifiers of each whole text."""
    norm = docs.select("doc_id", common.ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("norm"))
    ids = F.transform(chunks_of(F.col("norm"), shortest, longest), lambda c: chunk_id(c, seed))
    return norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), ids.alias("recipe"))


def exact_duplicates(docs: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the largest
    doc_id of equal texts stays. Null text counts as empty, empty texts are equal to
    each other (an empty recipe). Where the largest id comes on several rows, one of
    them stays. Null ids rank below all others; a group of null ids keeps one row,
    with a null keep_id. Other columns are ignored; no rows in, no rows out.
    Long texts move once, as chunks, to verify the identifiers; the comparison itself
    moves recipes of 16 bytes a chunk.
    """
    norm = docs.select(common.ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("norm"))
    seed = 0
    while not ids_are_verified(norm, seed, shortest, longest):
        seed += 1
    rows = common.materialise(
        recipes(docs, seed, shortest, longest).groupBy("recipe", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.min("text_sha256").alias("text_sha256")), "recipes"
    )
    groups = common.materialise(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")), "groups")
    out = common.with_groups(rows, groups, ["recipe"], "group_size", F.size("recipe") <= SHORT_RECIPE)
    out = common.repeated(out, "times")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of ``docs`` under any names.

    Of rows that repeat both id and text one stays, always the same. Null and empty texts are equal,
    and one of them stays; no rows in, no rows out.
    """
    decided = common.materialise(exact_duplicates(docs).select("doc_id", "kept", "text_sha256"), "decided")
    stays = decided.filter("kept").select(F.col("doc_id").alias("stays"), F.col("text_sha256").alias("stays_sha"))
    sha = F.sha2(common.ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    rows = docs.select(common.whole_row(docs).alias("row"), F.col("doc_id").alias("id"), sha.alias("sha"))
    found = rows.join(stays, F.col("id").eqNullSafe(F.col("stays")) & (F.col("sha") == F.col("stays_sha")), "left_semi")
    if decided.groupBy("doc_id", "text_sha256").count().filter("count > 1").take(1):
        found = common.first_of_each(found, ["id", "sha"])
    return found.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
