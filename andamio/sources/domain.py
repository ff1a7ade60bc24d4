"""The domain's views, built from the provided tables by fixed projections.

A catalogue of seven suppliers comes from ``part``, projects from ``orders``, their items
from ``lineitem`` and the log of suggestions from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPLIERS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.concat(F.lit("S"), (key % SUPPLIERS).cast("string")).alias("supplier"),
        key.cast("string").alias("supplier_id"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("mm"), F.concat(F.lit("DW"), (1000 + key % 500).cast("string"))).alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.element_at(F.split("p_name", " "), -1).alias("subcategory"),
        F.when(key % 41 != 0, F.col("p_retailprice")).alias("price"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "O", "activo").when(F.col("o_orderstatus") == "P", "completado").otherwise("archivado")
    return table(spark, sf_dir, "orders").select(
        key.alias("project_id"), F.col("o_custkey").alias("owner_id"), state.alias("state"), F.col("o_orderdate").alias("created"),
        (key % 12).cast("double").alias("indirect_pct"), (key % 7).cast("double").alias("contingency_pct"), (key % 20).cast("double").alias("margin_pct"),
        F.when(key % 5 != 0, (key % 50 + 10).cast("double")).alias("area_m2"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, open_line = F.col("l_returnflag"), F.col("l_linestatus") == "O"
    state = F.when(flag == "R", "descartado").when(flag == "A", "comprado").when(open_line, "pendiente").otherwise("parcial")
    bought = F.when(state == "comprado", F.col("l_quantity")).when(state == "parcial", F.floor(F.col("l_quantity") / 2).cast("double")).otherwise(0.0)
    section = F.when(F.col("l_linenumber") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("Partida "), (F.col("l_linenumber") % 4).cast("string")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project_id"),
        F.concat(F.lit("S"), (F.col("l_partkey") % SUPPLIERS).cast("string")).alias("supplier"),
        F.col("l_partkey").cast("string").alias("supplier_id"),
        F.col("l_suppkey").alias("line"),
        F.col("l_quantity").alias("quantity"),
        state.alias("state"),
        bought.alias("bought"),
        F.when(state.isin("comprado", "parcial") & (F.col("l_linenumber") % 2 == 0), F.col("l_extendedprice")).alias("amount"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_when_added"),
        section.alias("section"),
        F.col("l_shipdate").alias("added"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(
        F.create_map(*(F.lit(x) for kv in (("signup", "item_agregado"), ("click", "seleccion_aceptada"), ("view", "seleccion_reemplazada"), ("purchase", "seleccion_eliminada"), ("error", "item_eliminado")) for x in kv)),
        F.col("event_type"),
    )
    level = F.element_at(F.array(F.lit("alta"), F.lit("media"), F.lit("baja"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", kind.alias("kind"), level.alias("confidence"), F.when(F.col("event_id") % 3 == 0, "manual").otherwise("plano").alias("origin"),
        F.concat(F.lit("m"), (F.col("user_id") % 50).cast("string")).alias("material"), F.concat(F.lit("c"), (F.col("user_id") % 8).cast("string")).alias("category"),
        F.col("value").alias("seconds"), F.col("ts").alias("created"),
    )


#: The same projections in SQL, as common table expressions.
SQL = {
    "products": """products AS (SELECT p_partkey AS id, 'S' || (p_partkey % 7) AS supplier, p_partkey::VARCHAR AS supplier_id,
  p_name || ' ' || p_size || ' mm DW' || (1000 + p_partkey % 500) AS name, p_brand AS brand, p_type AS category,
  split_part(p_name, ' ', -1) AS subcategory, CASE WHEN p_partkey % 41 <> 0 THEN p_retailprice END AS price FROM part)""",
    "projects": """projects AS (SELECT o_orderkey AS project_id, o_custkey AS owner_id,
  CASE o_orderstatus WHEN 'O' THEN 'activo' WHEN 'P' THEN 'completado' ELSE 'archivado' END AS state, o_orderdate AS created,
  (o_orderkey % 12)::DOUBLE AS indirect_pct, (o_orderkey % 7)::DOUBLE AS contingency_pct, (o_orderkey % 20)::DOUBLE AS margin_pct,
  CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 50 + 10)::DOUBLE END AS area_m2 FROM orders)""",
    "items": """items0 AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'descartado' WHEN l_returnflag = 'A' THEN 'comprado' WHEN l_linestatus = 'O' THEN 'pendiente' ELSE 'parcial' END AS state FROM lineitem),
items AS (SELECT l_orderkey AS project_id, 'S' || (l_partkey % 7) AS supplier, l_partkey::VARCHAR AS supplier_id, l_suppkey AS line, l_quantity AS quantity, state,
  CASE state WHEN 'comprado' THEN l_quantity WHEN 'parcial' THEN floor(l_quantity / 2) ELSE 0.0::DOUBLE END AS bought,
  CASE WHEN state IN ('comprado', 'parcial') AND l_linenumber % 2 = 0 THEN l_extendedprice END AS amount,
  l_extendedprice / l_quantity AS price_when_added, CASE WHEN l_linenumber % 4 <> 0 THEN 'Partida ' || (l_linenumber % 4) END AS section, l_shipdate AS added FROM items0)""",
    "events": """log AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'item_agregado' WHEN 'click' THEN 'seleccion_aceptada' WHEN 'view' THEN 'seleccion_reemplazada' WHEN 'purchase' THEN 'seleccion_eliminada' WHEN 'error' THEN 'item_eliminado' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' WHEN 2 THEN 'baja' END AS confidence, CASE WHEN event_id % 3 = 0 THEN 'manual' ELSE 'plano' END AS origin,
  'm' || (user_id % 50) AS material, 'c' || (user_id % 8) AS category, value AS seconds, ts AS created FROM events)""",
}


def with_views(names: str, body: str) -> str:
    """SQL text: the named views, then ``body`` (its own expressions first, if any)."""
    views = ",\n".join(SQL[n] for n in names.split())
    return f"WITH {views}{',' if body.lstrip()[:2] == ', ' else ''}\n{body.lstrip().removeprefix(', ')}"
