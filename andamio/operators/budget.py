"""Cheaper confirmed alternatives for the pending items of all projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import matching, projects
from .common import ensure_checkpoints

CONFIRMED, PROBABLE = matching.LEAST_CONFIDENCE["budget"], matching.LEAST_CONFIDENCE["comparison"]


def alternatives(products: DataFrame, similar: DataFrame, prints: DataFrame) -> DataFrame:
    """id, alternative, place, price, level of each similar product that has a price.

    Pairs of products with the same prints but for id and supplier are scored once, however many
    products and items ask for them.
    """
    ensure_checkpoints(products)
    told, members = matching.classes(prints.checkpoint())
    told, members = told.checkpoint(), members.select("id", "class").checkpoint()
    side = lambda p: members.select(F.col("id").alias(f"id_{p}"), F.col("class").alias(p))
    pairs = similar.select(F.col("target_id").alias("id_a"), F.col("id").alias("id_b"), "place").join(side("a"), "id_a").join(side("b"), "id_b").checkpoint()
    rows = matching.compared(pairs.select("a", "b").distinct(), told)
    scores = matching.confidence(rows).select("a", "b", "score", "veto").join(rows.select("a", "b", F.size("spec.one_sided").alias("one_sided")), ["a", "b"])
    level = F.when((F.col("score") >= CONFIRMED) & (F.col("one_sided") == 0), "confirmed").when(F.col("score") >= PROBABLE, "probable").otherwise("different")
    priced = products.filter(F.col("price") > 0).select(F.col("id").alias("id_b"), "price")
    return pairs.join(scores, ["a", "b"]).join(priced, "id_b").select(F.col("id_a").alias("id"), F.col("id_b").alias("alternative"), "place", "price", "score", level.alias("level"))


def item_costs(items: DataFrame, choices: DataFrame) -> DataFrame:
    """Cost and saving of every item (id, quantity, price): only a strictly cheaper confirmed
    alternative saves; an unknown price saves nothing and costs nothing."""
    best = choices.filter("level = 'confirmed'").groupBy("id").agg(F.min(F.struct("price", "place", "alternative")).alias("best"))
    rows = items.join(best, "id", "left")
    known = F.col("price") > 0
    cheaper = F.coalesce(known & (F.col("best.price") < F.col("price")), F.lit(False))
    cost = F.when(known, projects.amount_of("quantity", "price")).otherwise(F.lit(0).cast("decimal(31,12)"))
    lowest = F.when(cheaper, projects.amount_of("quantity", "best.price")).otherwise(cost)
    return rows.select(*items.columns, F.when(cheaper, F.col("best.alternative")).alias("alternative"), cost.alias("cost"), lowest.alias("lowest"), F.when(known, cost - lowest).alias("saving"), F.col("best").isNull().alias("unmatched"))


def project_budgets(costs: DataFrame) -> DataFrame:
    sums = costs.groupBy("project_id").agg(F.count(F.lit(1)).alias("items"), projects.rounded_sum(F.col("cost")).alias("cost"), projects.rounded_sum(F.col("lowest")).alias("lowest"), F.count(F.when(F.col("unmatched"), 1)).alias("unmatched"))
    saving = F.bround(F.col("cost") - F.col("lowest"), 2)
    return sums.withColumn("saving", saving).withColumn("saving_pct", F.when(F.col("cost") > 0, F.bround(saving / F.col("cost") * 100, 2)))
