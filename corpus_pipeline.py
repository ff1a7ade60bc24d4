"""A corpus pipeline over documents: quality, exact and near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on what the stage before kept. All but
the last return the columns of documents, whatever other columns there are and whatever
their names. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from andamio.llm import common, exact_dedup, packing, quality_gam, shingle_join, source_mix

#: Words in a shingle, and similarity from which documents are near copies, in hundredths.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text is judged as an empty one; repeated rows are each kept or each dropped.
    """
    return quality_gam.accepted(docs, common.table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays.

    Null and empty texts are equal. Ties: of rows that repeat id and text the one whose whole
    row hashes lowest. Null ids rank below all others.
    """
    return exact_dedup.keep_one_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar shingle sets connect, the one with the smallest id stays.

    Null and blank texts link with nothing and stay. Ties as before; null ids rank last.
    """
    return shingle_join.keep_one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target asks for, up to three times.

    A null source is a source. Repeated rows are documents of their own. Texts without words
    are left out, as nothing of them can be taken.
    """
    return source_mix.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    Copies from the mix and repeated rows are documents of their own; an empty text has its end alone.
    """
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]

#: The classifier is learnt and the tokenizer is a library, so SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
