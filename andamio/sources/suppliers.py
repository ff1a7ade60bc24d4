"""Supplier feeds, landed as JSON, projected onto the catalogue's columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from andamio.functions import text

COLUMNS = ("supplier", "supplier_id", "sku", "name", "brand", "category", "subcategory", "price", "vat", "tax_code", "description", "image", "images", "url", "online", "weight", "updated")
TYPES = {"online": "boolean", "price": "double", "vat": "double", "updated": "timestamp_ntz"}


def shaped(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*(columns.get(c, F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in COLUMNS))


def graph_feed(rows: DataFrame, supplier: str) -> DataFrame:
    """Nested categories and prices; the gallery without the main image."""
    image = F.col("image.url")
    return shaped(
        rows, supplier=F.lit(supplier), supplier_id=F.col("id"), sku=F.col("sku"), name=F.col("name"), category=F.try_element_at("categories", F.lit(1))["name"], subcategory=F.try_element_at("categories", F.lit(-1))["name"],
        price=F.bround("price_range.minimum_price.final_price.value", 0), description=text.html_text(F.col("description.html")), image=image, images=text.image_list(F.array_except(F.col("media_gallery.url"), F.array(image))), online=F.col("stock_status") == "IN_STOCK", weight=F.col("weight"),
    )


def store_feed(rows: DataFrame, supplier: str) -> DataFrame:
    """Prices in minor units; names with HTML entities; the first brand and the last category."""
    unit = F.pow(F.lit(10.0), F.coalesce(F.col("prices.currency_minor_unit"), F.lit(2)))
    return shaped(
        rows, supplier=F.lit(supplier), supplier_id=F.col("id"), sku=F.nullif("sku", F.lit("")), name=text.html_text(F.col("name")), brand=F.try_element_at("brands", F.lit(1))["name"], category=F.try_element_at("categories", F.lit(1))["name"],
        subcategory=F.try_element_at("categories", F.lit(-1))["name"], price=F.bround(F.col("prices.price").cast("double") / unit, 0), description=text.html_text(F.col("description")), image=F.try_element_at("images", F.lit(1))["src"], images=text.image_list(F.slice(F.col("images.src"), 2, F.greatest(F.size("images"), F.lit(1)))), url=F.col("permalink"), online=F.col("is_in_stock"),
    )


def variant_feed(rows: DataFrame, supplier: str, site: str) -> DataFrame:
    """The first variant; a default category; images after the first."""
    first = F.try_element_at("variants", F.lit(1))
    return shaped(
        rows, supplier=F.lit(supplier), supplier_id=F.col("id"), sku=first["sku"], name=F.col("title"), brand=F.col("vendor"), category=F.coalesce(F.nullif("product_type", F.lit("")), F.lit("General")), price=F.bround(first["price"].cast("double"), 0),
        description=text.html_text(F.col("body_html")), image=F.try_element_at("images", F.lit(1))["src"], images=text.image_list(F.slice(F.col("images.src"), 2, F.greatest(F.size("images"), F.lit(1)))), url=F.concat(F.lit(f"{site}/products/"), "handle"), online=first["available"], weight=first["grams"],
    )


# A department of services, and one whose listed subcategories are no products for a building.
SERVICES, MIXED, NOT_FOR_BUILDING = "Servicios", "Organización", ("auto", "alimento")


def index_feed(rows: DataFrame, supplier: str, site: str) -> DataFrame:
    """A search index's hits: what is no product for a building is left out; urls by encoded id."""
    beside = (F.col("category") == MIXED) & F.col("subcategory").isin(*NOT_FOR_BUILDING)
    kept = rows.filter(~F.coalesce(F.col("category") == SERVICES, F.lit(False)) & ~F.coalesce(beside, F.lit(False)))
    return shaped(kept, supplier=F.lit(supplier), supplier_id=F.col("objectID"), name=F.col("name"), brand=F.nullif("brand", F.lit("")), category=F.col("category"), subcategory=F.col("subcategory"), price=F.bround("price", 0), url=F.concat(F.lit(f"{site}/P/"), F.base64(F.encode("objectID", "UTF-8"))))


def department_feed(rows: DataFrame, supplier: str, site: str) -> DataFrame:
    """Departments by their catalogue names; availability may be unknown."""
    category = F.when(F.col("department") == "Pintura", "Pinturas").otherwise(F.col("department"))
    return shaped(rows, supplier=F.lit(supplier), supplier_id=F.col("code"), sku=F.col("code"), name=F.col("name"), brand=F.col("brand"), category=category, subcategory=F.col("family"), price=F.bround("price", 0), online=F.when(F.col("stock").isNotNull(), F.col("stock") > 0), url=F.concat(F.lit(f"{site}/p/"), text.slug(F.col("name")), F.lit("-"), "code"))


#: Departments that have nothing for a building.
OTHER_DEPARTMENTS = ("Electrodomésticos", "Cocina", "Comedor y bar", "Decoración", "Outdoors", "Mascotas", "Muebles", "Automotriz")


def discovered_categories(homes: DataFrame, site: str, excluded: tuple[str, ...] = OTHER_DEPARTMENTS) -> DataFrame:
    """page_id, name, category_id, slug, department: what a site's home page (page_id, html) links to.

    Departments are links to two digits, categories to six whose first two are their department's.
    A menu may come twice, once without names: a department's first name counts. Categories
    of ``excluded`` departments are left out, of equal names the last link counts, and a category without
    a known department is General. Null or other html has none.
    """
    link = lambda digits: re.escape(f"{site}/catalogo/") + rf"(\d{{{digits}}})/"
    of_department = rf'<a[^>]*href="{link(2)}[^"]+\.html"[^>]*>([^<]*)<'
    of_category = rf'<a title="([^"]*)" href="{link(6)}([^"]+)\.html"'

    def found(pattern: str, **groups: int) -> DataFrame:
        each = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(pattern), F.lit(i)).alias(n) for n, i in groups.items()))
        return homes.select("page_id", F.posexplode(each).alias("at", "link")).select("page_id", "at", "link.*")

    departments = found(of_department, code=1, department=2).withColumn("department", F.trim("department")).filter("department <> ''")
    departments = departments.groupBy("page_id", "code").agg(F.min_by("department", "at").alias("department"))
    rows = found(of_category, name=1, category_id=2, slug=3).withColumn("code", F.left("category_id", F.lit(2))).join(departments, ["page_id", "code"], "left")
    kept = rows.filter(~F.coalesce(F.col("department").isin(*excluded), F.lit(False))).withColumn("department", F.coalesce("department", F.lit("General")))
    return kept.groupBy("page_id", F.trim("name").alias("name")).agg(F.max_by(F.struct("category_id", "slug", "department"), "at").alias("c")).select("page_id", "name", "c.*")


def detail_feed(listing: DataFrame, details: DataFrame, supplier: str, site: str) -> DataFrame:
    """A listing with a page of details for each product; prices stay as they are."""
    rows = listing.join(details, "id", "left")
    return shaped(rows, supplier=F.lit(supplier), supplier_id=F.col("id"), name=F.col("name"), brand=F.coalesce("detail.brand", F.lit("")), category=F.coalesce("detail.category", F.lit("General")), subcategory=F.col("detail.subcategory"), price=F.col("price"), description=text.html_text(F.col("detail.html")), url=F.concat(F.lit(f"{site}/"), text.slug(F.col("name"))), online=F.col("detail.online") == 1)


def not_done(listing: DataFrame, done: DataFrame) -> DataFrame:
    """What an interrupted enrichment has still to fetch."""
    return listing.join(done.select("id"), "id", "left_anti")


def in_batch_order(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``seq``, the arrival order that an upsert needs."""
    return rows.withColumn("seq", F.struct(*order))
