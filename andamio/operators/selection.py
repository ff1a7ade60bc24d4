"""Automatic choice of a product for a term of a plan, and quotes from plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from andamio.functions import specs, text, vocabulary

from . import ledger, search
from .common import ensure_checkpoints

CANDIDATES, LEAST_WORDS = 8, 2


def relaxed(terms: DataFrame) -> DataFrame:
    """term_id, query_id, words, query: each term with ever fewer of its leading words.

    The first try is the term itself; then prefixes of the words left after stop words,
    from one word less down to LEAST_WORDS. All are searched at once and the longest
    with hits is kept.
    """
    rows = terms.filter(~text.is_negation(F.col("term"))).withColumn("tokens", text.tokens(text.normalize(F.col("term"))))
    n = F.size("tokens")
    shorter = F.when(n - 1 >= LEAST_WORDS, F.sequence(n - 1, F.lit(LEAST_WORDS))).otherwise(F.array().cast("array<int>"))
    tries = F.concat(F.array(F.struct(F.lit(1_000_000).alias("words"), F.col("term").alias("query"))), F.transform(shorter, lambda k: F.struct(k.alias("words"), F.array_join(F.slice("tokens", 1, k), " ").alias("query"))))
    rows = rows.select("term_id", F.explode(tries).alias("t")).select("term_id", "t.words", "t.query")
    return rows.withColumn("query_id", F.xxhash64("term_id", "words"))


def longest_with_hits(tries: DataFrame, scored: DataFrame) -> DataFrame:
    """term_id, id, rank: the best CANDIDATES of the longest try that found something; ``scored`` has query, id, score."""
    met = tries.select("term_id", "words", "query").join(scored.select("query").distinct(), "query", "left_semi")
    longest = met.groupBy("term_id").agg(F.max_by("query", "words").alias("query"))
    found = longest.join(scored, "query")
    rank = F.row_number().over(Window.partitionBy("term_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= CANDIDATES).select("term_id", "id", (F.col("rank") - 1).alias("rank"))


def _contains_any(category: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(category, w))


def choose(terms: DataFrame, products: DataFrame, index: DataFrame, stats: DataFrame) -> DataFrame:
    """term_id, id, confidence of the first candidate that no rule turns down.

    ``terms`` has term_id, term, width and height in centimetres, expected and forbidden
    (arrays of category words) and anchor (the word that a name has to begin with, else
    the term's own first). Turned down: parts, names that begin otherwise, forbidden
    categories, sizes in conflict.
    """
    ensure_checkpoints(terms)
    tries = relaxed(terms)
    ranked = longest_with_hits(tries, search.best_of_many(tries, index, stats, CANDIDATES).checkpoint())
    rows = ranked.join(terms, "term_id").join(products.select("id", "name", "category", "subcategory", "price"), "id")
    kind = text.normalize(F.concat_ws(" ", "category", "subcategory"))
    concept = F.coalesce(F.col("anchor"), text.first_significant(F.col("term")))
    starts = F.coalesce(text.shares_prefix(text.first_significant(F.col("name")), concept), F.lit(False))
    conflict = specs.sizes_conflict(F.col("name"), F.col("width"), F.col("height"))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"sized": F.coalesce(~conflict, F.lit(False)), "expected_kind": _contains_any(kind, F.coalesce("expected", none)), "priced": F.coalesce(F.col("price") > 0, F.lit(False))})
    kept = rows.filter(~text.is_part(F.col("name")) & starts & ~_contains_any(kind, F.coalesce("forbidden", none)) & ~F.coalesce(conflict, F.lit(False)))
    first = kept.groupBy("term_id").agg(F.min_by(F.struct("id", "rank", "sized", "expected_kind", "priced"), "rank").alias("c")).select("term_id", "c.*")
    top = F.col("rank") == 0
    level = F.when(F.col("sized") | (top & F.col("expected_kind") & F.col("priced")), "alta").when(top & F.col("priced"), "media").otherwise("baja")
    return first.select("term_id", "id", level.alias("confidence"))


def plan_terms(openings: DataFrame, finishes: DataFrame, pieces: DataFrame) -> DataFrame:
    """Search terms for what a plan lists, with what is known of size and category.

    openings: key, kind (puerta or ventana), material, width_m, height_m, quantity;
    finishes: key, place, description, quantity; pieces: key, description, quantity, and may have
    width_mm and height_mm, whose section is sought in centimetres (lengths are not in names).
    """
    section = lambda c: (F.col(c) / 10 if c in pieces.columns else F.lit(None)).cast("double")
    measured = section("width_mm").isNotNull() & section("height_mm").isNotNull()
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    table = F.create_map(*(x for k, v in vocabulary.EXPECTED_CATEGORIES.items() for x in (F.lit(k), lit(v))))
    none = F.lit(None).cast("array<string>")
    a = openings.select("key", F.concat_ws(" ", "kind", "material").alias("term"), (F.col("width_m") * 100).alias("width"), (F.col("height_m") * 100).alias("height"), F.try_element_at(table, F.col("kind")).alias("expected"), none.alias("forbidden"), F.col("kind").alias("anchor"), "quantity")
    b = finishes.select("key", F.col("description").alias("term"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"), F.try_element_at(table, F.col("place")).alias("expected"), none.alias("forbidden"), F.lit(None).cast("string").alias("anchor"), F.lit(1.0).alias("quantity"))
    c = pieces.select("key", F.col("description").alias("term"), F.when(measured, section("width_mm")).alias("width"), F.when(measured, section("height_mm")).alias("height"), none.alias("expected"), lit(vocabulary.FORBIDDEN_FOR_PIECES).alias("forbidden"), F.lit(None).cast("string").alias("anchor"), "quantity")
    return a.unionByName(b).unionByName(c).withColumn("term_id", F.xxhash64("key", "term"))


def automatic_quote(terms: DataFrame, chosen: DataFrame) -> DataFrame:
    """Items to add, marked for review, and the terms that found nothing (id null)."""
    return terms.join(chosen, "term_id", "left").select("key", "term", "id", "quantity", "confidence", F.lit("plano").alias("origin"), F.lit(0).alias("reviewed"))


def quoted(materials: DataFrame, chosen: DataFrame, items: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items after a plan's materials are added in the order of ``seq``, and counters for each project.

    ``materials`` has project_id, term_id, seq, rule, quantity, page, text, source_confidence and
    now; ``chosen`` is of ``choose``; ``items`` has the columns of transitions. A product that
    waits in the project gets the sum, one in another state starts again, and both keep what
    they were added with; a new one is of the plan, to be reviewed. Counters: added (materials
    with a product, each time it is added) and unfound. Materials without a product change nothing.
    """
    rows = materials.join(chosen.select("term_id", "id", F.col("confidence").alias("match")), "term_id", "left")
    counters = rows.groupBy("project_id").agg(F.count("id").alias("added"), F.count_if(F.col("id").isNull()).alias("unfound"))
    named = products.select("id", F.col("supplier").alias("new_supplier"), F.col("supplier_id").alias("new_supplier_id"))
    commands = rows.join(named, "id").select(
        "project_id", "seq", F.lit("add").alias("kind"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), "new_supplier", "new_supplier_id",
        F.coalesce("quantity", F.lit(1.0)).alias("new_quantity"), "now", "rule", "page", "text", "source_confidence", "match",
    )
    done = ledger.ran(items.select("project_id", "item_id", "supplier", "supplier_id", "quantity", "state", "bought", "amount", "bought_on"), commands, products)
    keys = ["project_id", "supplier", "supplier_id"]
    last = done.filter("refused IS NULL").groupBy("project_id", F.col("new_supplier").alias("supplier"), F.col("new_supplier_id").alias("supplier_id")).agg(F.max_by("after_quantity", "seq").alias("last"), F.min_by(F.struct("fresh", "product", "rule", "page", "text", "source_confidence", "match", "now"), "seq").alias("first"))
    met = items.join(last.select(*keys, "last"), keys, "left")
    stay = met.select(*(F.coalesce("last", c).alias(c) if c == "quantity" else F.when(F.col("last").isNotNull(), ledger.PENDING).otherwise(F.col(c)).alias(c) if c == "state" else F.col(c) for c in items.columns))
    new = {
        "quantity": F.col("last"), "state": F.lit(ledger.PENDING), "category": F.col("first.product.category"), "section": text.suggested_section(F.col("first.product.category")), "added": F.col("first.now"), "origin": F.lit("plano"),
        "reviewed": F.lit(0), "bought": F.lit(0.0), "confidence": F.col("first.match"), "text": F.col("first.text"), "rule": F.col("first.rule"), "page": F.col("first.page"), "source_confidence": F.col("first.source_confidence"),
    }
    made = last.filter("first.fresh").select(*(F.col(c) if c in keys else new.get(c, F.lit(None)).cast(items.schema[c].dataType).alias(c) for c in items.columns))
    return stay.unionByName(made), counters
