"""Catalogue filters, checks and the upsert of supplier batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A new batch overwrites these; the others keep their old value where the new one is null.
OVERWRITTEN = ("name", "category", "price", "vat", "tax_code", "image", "url", "online", "updated")
KEPT = ("sku", "brand", "subcategory", "description", "weight", "images")


def like(column: Column, query: str) -> Column:
    """Substring search that folds ASCII case only; % and _ in the query stay wildcards."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower(column).like("%" + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query) + "%")


def search_by_price(products: DataFrame, query: str, limit: int) -> DataFrame:
    """Cheapest products with the text in their names; those without a price come first."""
    return products.filter(like(F.col("name"), query)).orderBy(F.asc_nulls_first("price"), "id").limit(limit)


def without_words(products: DataFrame, words: list[str]) -> DataFrame:
    kept = products.filter(F.col("name").isNotNull())
    for w in words:
        kept = kept.filter(~like(F.col("name"), w))
    return kept


def count_by_supplier(products: DataFrame) -> DataFrame:
    bad = F.col("price").isNull() | (F.col("price") <= 0)
    blank = F.col("name").isNull() | (F.trim("name") == "")
    return products.groupBy("supplier").agg(F.count(F.lit(1)).alias("products"), F.count(F.when(bad, 1)).alias("bad_prices"), F.count(F.when(blank, 1)).alias("blank_names"))


def duplicate_keys(products: DataFrame, keys: list[str]) -> DataFrame:
    return products.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def reconciliation(products: DataFrame, postings: DataFrame) -> DataFrame:
    """Products, products in the index, and whether the two agree."""
    a = products.agg(F.countDistinct("id").alias("products"))
    b = postings.agg(F.countDistinct("id").alias("indexed"))
    return a.join(b).withColumn("agrees", F.col("products") == F.col("indexed"))


def upserted(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The catalogue after a batch: (supplier, supplier_id) is the key.

    A batch may hold a key several times, by ``seq``: the last row wins, but for KEPT
    columns the last value that is not null. Null there keeps the old value. Columns that
    only one side has are null on the other, and without ``seq`` a batch has one row of
    a key. Rows with a null key match no other and stay; columns beyond these are left out.
    """
    kinds = {f.name: f.dataType for df in (batch, current) for f in df.schema}
    over, kept = ([c for c in names if c in kinds] for names in (OVERWRITTEN, KEPT))
    filled = lambda df, more: df.select("supplier", "supplier_id", *((F.col(c) if c in df.columns else F.lit(None).cast(kinds[c])).alias(c) for c in (*over, *kept)), *more)
    seq = F.col("seq") if "seq" in batch.columns else F.lit(0)
    last = filled(batch, [seq.alias("seq")]).groupBy("supplier", "supplier_id").agg(
        *(F.max_by(c, "seq").alias(f"new_{c}") for c in over), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in kept), F.lit(True).alias("fresh")
    )
    both = filled(current, []).join(last, ["supplier", "supplier_id"], "full")
    taken = [F.when(F.coalesce("fresh", F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in over]
    return both.select("supplier", "supplier_id", *taken, *(F.coalesce(f"new_{c}", c).alias(c) for c in kept))
