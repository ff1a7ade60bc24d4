"""Reports over the log of automatic suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from andamio.functions.vocabulary import CONFIDENCE_LEVELS

ADDED, ACCEPTED, REPLACED, REMOVED = "item_agregado", "seleccion_aceptada", "seleccion_reemplazada", "seleccion_eliminada"
DECISIONS = (ACCEPTED, REPLACED, REMOVED)


def automatic() -> Column:
    """An automatic suggestion: from a plan, with a confidence."""
    return (F.col("origin") == "plano") & F.col("confidence").isNotNull()


def recent(events: DataFrame, as_of: Column, days: int | None = None) -> DataFrame:
    return events if days is None else events.filter(F.col("created") >= as_of - F.make_dt_interval(F.lit(days)))


def by_confidence(events: DataFrame) -> DataFrame:
    return events.filter((F.col("kind") == ADDED) & automatic()).groupBy("confidence").agg(F.count(F.lit(1)).alias("suggested"))


def decisions(events: DataFrame) -> DataFrame:
    """Decisions by kind and confidence; also those not on automatic suggestions."""
    return events.filter(F.col("kind").isin(*DECISIONS)).groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))


def acceptance(events: DataFrame) -> DataFrame:
    """Acceptance and precision by confidence level, levels without events too, and in total.

    One scan and one aggregation give all counts; the total sums the fixed levels only.
    """
    count = lambda kind, extra=F.lit(True): F.count(F.when((F.col("kind") == kind) & extra, 1))
    found = events.filter(F.col("confidence").isin(*CONFIDENCE_LEVELS)).groupBy("confidence").agg(
        count(ADDED, F.col("origin") == "plano").alias("suggested"), count(ACCEPTED).alias("accepted"), count(REPLACED).alias("replaced"), count(REMOVED).alias("removed"),
        F.avg(F.when(F.col("kind") == ACCEPTED, F.col("seconds"))).alias("seconds"),
    )
    levels = events.sparkSession.createDataFrame([(x,) for x in CONFIDENCE_LEVELS], "confidence string")
    names = ("suggested", "accepted", "replaced", "removed")
    rows = levels.join(found, "confidence", "left").select("confidence", *(F.coalesce(n, F.lit(0)).alias(n) for n in names), F.bround("seconds", 1).alias("accept_seconds"))
    total = rows.agg(*(F.sum(n).alias(n) for n in names)).select(F.lit("total").alias("confidence"), *names, F.lit(None).cast("double").alias("accept_seconds"))
    decided = F.col("accepted") + F.col("replaced") + F.col("removed")
    ratio = lambda of: F.when(of != 0, F.bround(F.col("accepted") / of, 4))
    pending = F.greatest(F.col("suggested") - decided, F.lit(0)).alias("pending")
    return rows.unionByName(total).select("confidence", *names, pending, ratio(F.col("suggested")).alias("acceptance"), ratio(decided).alias("precision"), "accept_seconds")


def hardest(events: DataFrame, column: str, least: int, limit: int) -> DataFrame:
    """Values of a column whose suggestions are most often turned down."""
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    rows = events.filter(F.col(column).isNotNull() & automatic() & F.col("kind").isin(ADDED, *DECISIONS)).groupBy(column)
    rows = rows.agg(count(ADDED).alias("suggested"), count(ACCEPTED).alias("accepted"), count(REPLACED).alias("replaced"), count(REMOVED).alias("removed")).filter(F.col("suggested") >= least)
    rows = rows.withColumn("rejection", F.bround((F.col("replaced") + F.col("removed")) / F.col("suggested"), 4))
    return rows.orderBy(F.desc("rejection"), F.desc("suggested"), column).limit(limit)
