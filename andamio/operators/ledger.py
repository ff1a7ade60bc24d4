"""Commands to projects in the order in which they came: add, delete and replace items.

A command may depend on any earlier one of its project: a refused one leaves its product
free, and a product that was replaced or deleted may come back. Spark brings each command
together with what it meets: its product in the catalogue by a join, its item and its product
in the project by windows where commands and items are dealt to tasks by project. There commands
are sorted, and the task passes over them once.
It holds the items and products that the current project's commands have named, never
a project's items or its log.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a command may do, and the state that an added item has.
KINDS, PENDING = ("add", "delete", "replace"), "pendiente"
#: What a decision needs of a command's row; what it adds to it.
NEEDS = ("project_id", "item_id", "kind", "supplier", "supplier_id", "quantity", "state", "bought_any", "new_supplier", "new_supplier_id", "new_quantity", "there_quantity", "there_state", "sold")
#: What ``after`` needs of a command's row.
AFTER = ("project_id", "seq", "kind", "item_id", "supplier", "supplier_id", "new_supplier", "new_supplier_id")
DECIDES = ("supplier", "supplier_id", "quantity", "state", "bought", "amount", "bought_on")
MADE = T.StructType([T.StructField("refused", T.StringType()), T.StructField("after_quantity", T.DoubleType()), T.StructField("fresh", T.BooleanType())])


def met(items: DataFrame, commands: DataFrame, products: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Every command with its item's columns (null if there is none), ``there_`` for its product in the project, ``sold`` and ``product``.

    Commands have project_id, seq, kind, item_id (of what goes; null where something is
    added), new_supplier, new_supplier_id, new_quantity (null: as before) and now. An unknown kind stops the job.
    Items and commands go to their project once; there windows bring together what has
    one item or one product. Of the items' columns those in ``kept`` (all, if it is null) and what decides are moved.
    """
    target = ["project_id", "new_supplier", "new_supplier_id"]
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown command: "), F.coalesce("kind", F.lit("null")))))
    sold = products.groupBy(F.col("supplier").alias("new_supplier"), F.col("supplier_id").alias("new_supplier_id")).agg(F.min(F.struct("name", "category", "price")).alias("product"))
    asked = commands.withColumn("kind", kind).join(sold, target[1:], "left").withColumn("sold", F.col("product").isNotNull())
    if kept is not None and "product" not in kept:
        asked = asked.drop("product")
    own = [c for c in items.columns if c not in ("project_id", "item_id") and (kept is None or c in kept or c in DECIDES)]
    there = items.select("project_id", "item_id", F.col("supplier").alias("new_supplier"), F.col("supplier_id").alias("new_supplier_id"), F.struct(*own, F.col("item_id").alias("there_item")).alias("held"))
    both = asked.unionByName(there, allowMissingColumns=True).repartition("project_id")
    # Null keys meet nothing.
    of = lambda keys: F.when(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)), F.first("held", ignorenulls=True).over(Window.partitionBy(*keys)))
    rows = both.withColumn("own", of(["project_id", "item_id"])).withColumn("there", of(target)).filter("held IS NULL")
    found = rows.select(*asked.columns, *(F.col(f"own.{c}").alias(c) for c in own), *(F.col(f"there.{c}").alias(n) for c, n in (("quantity", "there_quantity"), ("state", "there_state"), ("there_item", "there_item"))))
    spent = (F.coalesce("bought", F.lit(0.0)) != 0) | F.col("amount").isNotNull() | F.col("bought_on").isNotNull()
    return found.withColumn("bought_any", F.coalesce(spent, F.lit(False)))


def _decide(c: dict, held: dict, gone: set) -> tuple[str | None, float | None, bool | None]:
    """Why a command is refused, else the quantity that its product has after it and whether it came anew.

    ``held`` has (quantity, state) of products that commands touched, None where one is free
    again; ``gone`` the items that are no longer there.
    """
    own, new = (c["supplier"], c["supplier_id"]), (c["new_supplier"], c["new_supplier_id"])
    there = held.get(new, None if c["there_state"] is None else (c["there_quantity"], c["there_state"]))
    if c["kind"] != "add":
        if c["supplier"] is None:
            return "no such item", None, None
        if c["item_id"] in gone:
            return "done before", None, None
    if c["kind"] == "replace" and c["bought_any"]:
        return "bought already", None, None
    if c["kind"] == "replace" and there is not None:
        return "already in the project", None, None
    if c["kind"] != "delete" and not c["sold"]:
        return "not in the catalogue", None, None
    quantity = c["new_quantity"]
    if c["kind"] != "add":
        before = held.get(own) or (c["quantity"], c["state"])
        held[own] = None
        gone.add(c["item_id"])
        quantity = before[0] if quantity is None else quantity
        if c["kind"] == "delete":
            return None, None, None
    elif there is not None and there[1] == PENDING:
        quantity = (there[0] or 0.0) + (quantity or 0.0)
    held[new] = (quantity, PENDING)
    return None, quantity, there is None


def decided(rows: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Adds ``refused``, ``after_quantity`` and ``fresh`` to the rows of ``met``, in the order of seq, then item_id, in each project.

    Of the rows' columns those in ``kept`` are returned (all, if it is null). What neither is kept nor decides is not moved.
    """
    kept = rows.columns if kept is None else kept
    fields = [rows.schema[c] for c in kept]
    # A window's rows are at their project and in order; they go there only if they are not there yet.
    nth = F.row_number().over(Window.partitionBy("project_id").orderBy("seq", "item_id", "new_supplier", "new_supplier_id"))
    ordered = rows.withColumn("nth", nth).select(*dict.fromkeys((*kept, *NEEDS, "nth")))

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, held, gone = object(), {}, set()
        for batch in batches:
            made = []
            for values in zip(*(batch.column(n).to_pylist() for n in NEEDS)):
                c = dict(zip(NEEDS, values))
                if c["project_id"] != project:
                    project, held, gone = c["project_id"], {}, set()
                made.append(_decide(c, held, gone))
            more = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *more], [*(f.name for f in fields), *MADE.names])

    return ordered.mapInArrow(of_partition, T.StructType([*fields, *MADE.fields]))


def ran(items: DataFrame, commands: DataFrame, products: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """What every command did: the rows of ``met`` (of their columns those in ``kept``) with ``decided``'s columns."""
    return decided(met(items, commands, products, kept), kept)


def after(items: DataFrame, done: DataFrame) -> DataFrame:
    """project_id, supplier, supplier_id, quantity, state, item_id of all items once the commands of ``ran`` are done.

    item_id is null for products that came anew.
    """
    good = done.filter("refused IS NULL")
    keys = ["project_id", "supplier", "supplier_id"]
    # A replacement frees one product and takes another; both come from one pass over the commands.
    at = lambda step: F.struct("seq", "item_id", F.lit(step).alias("step")).alias("at")
    freed = F.struct("supplier", "supplier_id", at(0), F.lit(None).cast("double").alias("quantity"), F.lit(True).alias("fresh"), F.lit(False).alias("alive"))
    taken = F.struct(F.col("new_supplier").alias("supplier"), F.col("new_supplier_id").alias("supplier_id"), at(1), F.col("after_quantity").alias("quantity"), "fresh", F.lit(True).alias("alive"))
    moves = F.array_compact(F.array(F.when(F.col("kind") != "add", freed), F.when(F.col("kind") != "delete", taken)))
    last = good.select("project_id", F.explode(moves).alias("move")).select("project_id", "move.*").groupBy(*keys).agg(F.max_by(F.struct("quantity", "alive"), "at").alias("last"), F.max("fresh").alias("anew"))
    rows = items.select(*keys, "quantity", "state", "item_id").join(last, keys, "full")
    touched = F.col("last").isNotNull()
    kept = rows.filter(~touched | F.col("last.alive"))
    return kept.select(*keys, F.when(touched, F.col("last.quantity")).otherwise(F.col("quantity")).alias("quantity"), F.when(touched, PENDING).otherwise(F.col("state")).alias("state"), F.when(touched & F.col("anew"), None).otherwise(F.col("item_id")).alias("item_id"))
