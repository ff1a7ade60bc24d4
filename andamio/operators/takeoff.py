"""Material and labour take-off from rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rule library. Material lines are system, material, quantity per unit, waste
# factor, rounding (ceil or two decimals), fixed, derived from, optional.
MATERIALS = (
    ("muro_block", "bloque", 12.5, 1.05, "int", False, None, False),
    ("muro_block", "cemento_pega", 0.11, 1.0, "int", False, None, False),
    ("muro_block", "arena_pega", 0.12, 1.0, "dec", False, "cemento_pega", False),
    ("muro_gypsum", "lamina", 2.1, 1.05, "dec", False, None, False),
    ("muro_gypsum", "poste", 0.42, 1.0, "int", False, None, False),
    ("muro_gypsum", "canal", 0.13, 1.0, "int", False, None, False),
    ("muro_gypsum", "tornillo", 20.0, 1.0, "int", False, None, False),
    ("muro_gypsum", "cinta", 1.0, 1.0, "dec", False, None, False),
    ("muro_gypsum", "pasta", 0.5, 1.0, "dec", False, None, False),
    ("piso_ceramico", "ceramica", 1.0, 1.10, "dec", False, None, False),
    ("piso_ceramico", "pegamento", 0.2, 1.0, "dec", False, None, False),
    ("piso_ceramico", "fragua", 0.4, 1.0, "dec", False, None, False),
    ("techo_lamina", "lamina", 1.0, 1.15, "dec", False, None, False),
    ("techo_lamina", "tornillo", 6.0, 1.0, "int", False, None, False),
    ("techo_cumbrera", "cumbrera", 1.0, 1.10, "dec", False, None, False),
    ("instalacion_sanitaria_basica", "tubo", 3.0, 1.0, "int", False, None, False),
    ("instalacion_sanitaria_basica", "codo", 2.0, 1.0, "int", False, None, False),
    ("instalacion_sanitaria_basica", "union", 1.0, 1.0, "int", False, None, False),
    ("instalacion_sanitaria_basica", "pegamento", 0.1, 1.0, "dec", False, None, False),
    ("instalacion_sanitaria_basica", "llave_paso", 1.0, 1.0, "int", True, None, True),
    ("instalacion_electrica_basica", "cable", 8.0, 1.0, "int", False, None, False),
    ("instalacion_electrica_basica", "tubo_conduit", 3.0, 1.0, "int", False, None, False),
    ("instalacion_electrica_basica", "caja", 1.0, 1.0, "int", True, None, False),
    ("instalacion_electrica_basica", "tomacorriente", 1.0, 1.0, "int", True, None, True),
    ("instalacion_electrica_basica", "apagador", 1.0, 1.0, "int", True, None, True),
    ("instalacion_electrica_basica", "breaker", 0.1, 1.0, "dec", False, None, False),
    ("tapia", "varilla_refuerzo", 0.5, 1.0, "int", False, None, False),
    ("bano", "inodoro", 1.0, 1.0, "int", True, None, False),
    ("bano", "lavamano", 1.0, 1.0, "int", True, None, False),
    ("bano", "grifo_ducha", 1.0, 1.0, "int", True, None, False),
    ("cocina", "mueble_cocina", 1.0, 1.0, "int", True, None, False),
    ("cocina", "fregadero", 1.0, 1.0, "int", True, None, False),
    ("cocina", "grifo_cocina", 1.0, 1.0, "int", True, None, False),
)
# Region, system, material, quantity per unit in that region.
REGIONAL = (("guanacaste", "techo_lamina", "tornillo", 8.0),)
LABOUR = (("muro_block", "albanileria", 1.0 / 9.0, "dec"),)
# System, part, subsystem, factor of the system's amount (null: a fixed amount), fixed amount.
SUBSYSTEMS = (
    ("tapia", "muro", "muro_block", 1.0, None),
    ("bano", "piso", "piso_ceramico", 1.0, None),
    ("bano", "pared", "piso_ceramico", 2.2, None),
    ("bano", "sanitaria", "instalacion_sanitaria_basica", None, 1.0),
    ("bano", "electrica", "instalacion_electrica_basica", None, 2.0),
    ("cocina", "piso", "piso_ceramico", 1.0, None),
    ("cocina", "sanitaria", "instalacion_sanitaria_basica", None, 1.0),
    ("cocina", "electrica", "instalacion_electrica_basica", None, 3.0),
)
SYSTEMS = ("muro_block", "muro_gypsum", "piso_ceramico", "techo_lamina", "techo_cumbrera", "instalacion_sanitaria_basica", "instalacion_electrica_basica", "tapia", "bano", "cocina")

#: Systems contain systems; the library is two levels deep, so this bound is never met.
DEEPEST = 8


def rules(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "materials": spark.createDataFrame(MATERIALS, "system string, material string, per_unit double, waste double, rounding string, fixed boolean, derived_from string, optional boolean"),
        "regional": spark.createDataFrame(REGIONAL, "region string, system string, material string, regional double"),
        "labour": spark.createDataFrame(LABOUR, "system string, task string, per_unit double, rounding string"),
        "subsystems": spark.createDataFrame(SUBSYSTEMS, "parent string, part string, system string, factor double, amount_fixed double"),
    }


def unfolded(requests: DataFrame, subsystems: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Every system that a request (request_id, system, amount, region) comes to, with its path and amount.

    ``overrides`` (request_id, part, override) set a part's amount. Levels are joined
    until none is left; rule tables are tiny, so each level is a broadcast join of
    the requests.
    """
    if overrides is None:
        overrides = requests.sparkSession.createDataFrame([], "request_id long, part string, override double")
    level = requests.select("request_id", "region", "system", F.col("amount").cast("double").alias("amount"), F.col("system").alias("path"))
    parents = {r.parent for r in subsystems.select("parent").distinct().collect()}
    children = {r.parent: set() for r in subsystems.select("parent").distinct().collect()}
    for r in subsystems.collect():
        children[r.parent].add(r.system)
    found, alive = level, parents
    for _ in range(DEEPEST):
        if not alive:
            return found
        inner = level.withColumnRenamed("system", "parent").join(F.broadcast(subsystems), "parent").join(overrides, ["request_id", "part"], "left")
        amount = F.coalesce("override", F.when(F.col("factor").isNotNull(), F.col("amount") * F.col("factor")).otherwise(F.col("amount_fixed")))
        level = inner.select("request_id", "region", "system", amount.alias("amount"), F.concat_ws("/", "path", "part").alias("path"))
        found = found.unionByName(level)
        alive = {s for p in alive for s in children.get(p, ())} & parents
    raise ValueError("the systems contain each other")


def rounded(quantity: Column, how: Column) -> Column:
    return F.when(how == "int", F.ceil(quantity).cast("double")).otherwise(F.bround(quantity, 2))


def material_lines(requests: DataFrame, tables: dict[str, DataFrame], overrides: DataFrame | None = None, wastes: DataFrame | None = None) -> DataFrame:
    """request_id, path, system, material, quantity of every line.

    A regional rule goes before the national one and ``wastes`` (request_id, material,
    waste_override) before the rule's; fixed lines ignore amount and waste. A derived
    line starts from the rounded quantity of its source, which may be derived itself.
    """
    if wastes is None:
        wastes = requests.sparkSession.createDataFrame([], "request_id long, material string, waste_override double")
    rows = unfolded(requests, tables["subsystems"], overrides).join(F.broadcast(tables["materials"]), "system").join(F.broadcast(tables["regional"]), ["region", "system", "material"], "left").join(wastes, ["request_id", "material"], "left")
    per_unit, waste = F.coalesce("regional", "per_unit"), F.coalesce("waste_override", "waste")
    of = lambda base: rounded(F.when(F.col("fixed"), per_unit).otherwise(base * per_unit * waste), F.col("rounding"))
    columns = ("request_id", "path", "system", "material")
    level = rows.filter("derived_from IS NULL").select(*columns, of(F.col("amount")).alias("quantity"), "optional")
    found = level
    for _ in range(derivation_depth(tables["materials"])):
        source = level.select("request_id", "path", F.col("material").alias("derived_from"), F.col("quantity").alias("source"))
        level = rows.filter("derived_from IS NOT NULL").join(source, ["request_id", "path", "derived_from"]).select(*columns, of(F.col("source")).alias("quantity"), "optional")
        found = found.unionByName(level)
    return found


def derivation_depth(materials: DataFrame) -> int:
    """How many lines in a row derive from each other; the rule table is tiny."""
    source = {(r.system, r.material): r.derived_from for r in materials.select("system", "material", "derived_from").collect()}
    deepest = 0
    for system, material in source:
        depth = 0
        while (material := source.get((system, material))) is not None:
            depth += 1
            if depth > len(source):
                raise ValueError(f"materials of {system!r} derive from each other in a circle")
        deepest = max(deepest, depth)
    return deepest


def labour_lines(requests: DataFrame, tables: dict[str, DataFrame], overrides: DataFrame | None = None) -> DataFrame:
    rows = unfolded(requests, tables["subsystems"], overrides).join(F.broadcast(tables["labour"]), "system")
    return rows.select("request_id", "path", "system", "task", rounded(F.col("amount") * F.col("per_unit"), F.col("rounding")).alias("days"))
