"""Project money: totals, sections, quotes, purchases and cost control."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from andamio.functions import text, vocabulary

OPEN_STATES = ("pendiente", "parcial")


def exact(c: str | Column, kind: str = "decimal(18,4)") -> Column:
    """Money and quantities as decimals, whose sums do not depend on the order of the rows."""
    return (F.col(c) if isinstance(c, str) else c).cast(kind)


def amount_of(quantity: str | Column, price: str | Column) -> Column:
    return exact(quantity, "decimal(12,4)") * exact(price, "decimal(18,8)")


def rounded_sum(amounts: Column, digits: int = 2) -> Column:
    """The sum with ties to even, as a double again."""
    return F.bround(F.coalesce(F.sum(amounts), F.lit(0).cast("decimal(38,12)")), digits).cast("double")


def live_over_snapshot(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with today's price and name where the product is still sold, else what was kept.

    A catalogue row with a null key meets no item. Keys are unique in the catalogue, as the
    upsert leaves them; repeated items stay repeated.
    """
    live = products.select("supplier", "supplier_id", F.col("name").alias("live_name"), F.col("price").alias("live_price"), F.lit(True).alias("found"))
    joined = items.join(live, ["supplier", "supplier_id"], "left")
    return joined.withColumn("price", F.coalesce("live_price", "price_when_added", F.lit(0.0))).withColumn("available", F.coalesce("found", F.lit(False))).drop("found")


def remaining(floor: float = 0.0) -> Column:
    return F.greatest(F.col("quantity") - F.coalesce("bought", F.lit(0.0)), F.lit(floor))


def totals(projects: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Items, pending and bought amounts of each project, in whole units; projects without items too.

    What is bought counts at the amount paid, or at its price where none was noted. The
    items are summed before they meet the projects, so the wide join is one row a project.
    """
    known = live_over_snapshot(items, products).filter("state <> 'descartado'")
    pending = F.when(F.col("state").isin(*OPEN_STATES), amount_of(remaining(), F.col("price")))
    spent = F.when(F.col("state").isin("comprado", "parcial"), F.coalesce(exact("amount"), amount_of("bought", "price")))
    sums = known.groupBy("project_id").agg(F.count(F.lit(1)).alias("items"), rounded_sum(pending, 0).alias("pending"), rounded_sum(spent, 0).alias("spent"))
    money = lambda c: F.coalesce(c, F.lit(0.0)).cast("long").alias(c)
    return projects.join(sums, "project_id", "left").select("project_id", "owner_id", "state", F.coalesce("items", F.lit(0)).alias("items"), money("pending"), money("spent"))


def section_order(name: Column) -> Column:
    """Sort key: fixed sections in their order, then others by name, then those without."""
    fixed = reduce(lambda rest, i: F.when(name == vocabulary.SECTIONS[i], i).otherwise(rest), range(len(vocabulary.SECTIONS)), F.lit(None).cast("int"))
    bucket = F.when(name == vocabulary.NO_SECTION, 2).when(fixed.isNotNull(), 0).otherwise(1)
    return F.struct(bucket.alias("bucket"), F.coalesce(fixed, F.lit(0)).alias("at"), F.when(bucket == 1, F.lower(name)).otherwise("").alias("name"))


def section_subtotals(items: DataFrame, products: DataFrame) -> DataFrame:
    """Subtotal of each section of a project at full quantities; sections whose names differ by
    accents or case are one, shown as first added."""
    known = live_over_snapshot(items, products).filter("state <> 'descartado'")
    label = F.coalesce(F.nullif("section", F.lit("")), F.lit(vocabulary.NO_SECTION))
    rows = known.withColumn("label", label).withColumn("key", text.normalize(label))
    first = F.min_by("label", F.struct("added", "supplier", "supplier_id", "line"))
    subtotal = rounded_sum(amount_of("quantity", "price")).alias("subtotal")
    return rows.groupBy("project_id", "key").agg(first.alias("section"), subtotal, F.count(F.lit(1)).alias("items")).withColumn("order", section_order(F.col("section")))


def quotes(projects: DataFrame, sections: DataFrame) -> DataFrame:
    """Materials and three percentages of them, the total, and the cost of a square metre."""
    cents = "decimal(20,2)"
    sums = sections.groupBy("project_id").agg(F.sum(exact("subtotal", cents)).alias("materials"))
    rows = projects.join(sums, "project_id", "left").withColumn("materials", F.coalesce("materials", F.lit(0)).cast(cents))
    hundredth = F.lit("0.01").cast("decimal(3,2)")
    share = lambda c: F.bround(F.col("materials") * exact(F.coalesce(c, F.lit(0.0)), "decimal(9,4)") * hundredth, 2).cast(cents)
    rows = rows.withColumns({"indirect": share("indirect_pct"), "contingency": share("contingency_pct"), "margin": share("margin_pct")})
    rows = rows.withColumn("total", F.col("materials") + F.col("indirect") + F.col("contingency") + F.col("margin"))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in ("materials", "indirect", "contingency", "margin", "total")})
    cost = F.when(F.col("area_m2") != 0, F.bround(F.col("total") / F.col("area_m2"), 2))
    return rows.select("project_id", "materials", "indirect", "contingency", "margin", "total", cost.alias("cost_m2"))


def pending_by_supplier(items: DataFrame, products: DataFrame) -> DataFrame:
    """What is still to be bought of each supplier in each project."""
    rows = live_over_snapshot(items, products).filter(F.col("state").isin(*OPEN_STATES)).withColumn("left", remaining()).filter("left > 0")
    return rows.groupBy("project_id", "supplier").agg(F.count(F.lit(1)).alias("items"), rounded_sum(amount_of("left", "price")).alias("subtotal"))


def latest_baseline(baselines: DataFrame) -> DataFrame:
    """The last frozen budget of each project: by date, then by id. No sort, one pass."""
    row = F.struct("created", "baseline_id", "total")
    return baselines.groupBy("project_id").agg(F.max(row).alias("last")).select("project_id", "last.*")


def cost_control(totals: DataFrame, baselines: DataFrame) -> DataFrame:
    """Spending against the last frozen budget; projects without one have no status."""
    rows = totals.select("project_id", "spent").join(latest_baseline(baselines).select("project_id", F.col("total").alias("budget")), "project_id", "left")
    done = F.when(F.col("budget") != 0, F.bround(F.col("spent") / F.col("budget") * 100, 2)).when(F.col("budget") == 0, 0.0)
    rows = rows.withColumn("balance", F.bround(F.col("budget") - F.col("spent"), 2)).withColumn("executed_pct", done)
    status = F.when(F.col("budget").isNull(), F.lit(None)).when(F.col("spent") > F.col("budget"), "excedido").when((F.col("budget") != 0) & (F.col("executed_pct") >= 90), "por_agotarse").otherwise("en_curso")
    return rows.withColumn("status", status)


def next_order_number(orders: DataFrame) -> DataFrame:
    """The next ``OC-project-n`` of each project; numbers of another form do not count."""
    n = F.regexp_extract(F.col("number"), r"^OC-(\d+)-(\d+)$", 2).try_cast("long")
    mine = F.regexp_extract(F.col("number"), r"^OC-(\d+)-(\d+)$", 1) == F.col("project_id").cast("string")
    last = orders.groupBy("project_id").agg(F.coalesce(F.max(F.when(mine, n)), F.lit(0)).alias("last"))
    return last.select("project_id", F.concat(F.lit("OC-"), F.col("project_id").cast("string"), F.lit("-"), (F.col("last") + 1).cast("string")).alias("number"))


def numbered_orders(lines: DataFrame, taken: DataFrame) -> DataFrame:
    """Order numbers for new orders (project_id, supplier), after those that are taken."""
    n = F.regexp_extract(F.col("number"), r"^OC-\d+-(\d+)$", 1).try_cast("long")
    last = taken.groupBy("project_id").agg(F.coalesce(F.max(n), F.lit(0)).alias("last"))
    nth = F.row_number().over(Window.partitionBy("project_id").orderBy("supplier"))
    rows = lines.withColumn("nth", nth).join(last, "project_id", "left")
    number = F.concat(F.lit("OC-"), F.col("project_id").cast("string"), F.lit("-"), (F.col("nth") + F.coalesce("last", F.lit(0))).cast("string"))
    return rows.withColumn("number", number).drop("nth", "last")


def frozen_budgets(quotes: DataFrame, sections: DataFrame, created: Column) -> DataFrame:
    """A row to append for each project: its quote and its sections as JSON."""
    listed = sections.groupBy("project_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("order", "section", "subtotal"))), lambda s: F.struct(s["section"].alias("section"), s["subtotal"].alias("subtotal")))).alias("snapshot"))
    return quotes.join(listed, "project_id", "left").select("*", created.alias("created"))


# -- commands in their order ---------------------------------------------------------------


def folded(rows: DataFrame, keys: list[str], columns: list[str], start: Column, step, commands=None) -> DataFrame:
    """Folds the commands of each key in the order of their fields; a key's commands are few.

    A row is a command, or ``commands`` makes an array of them from its ``columns``. Rows go to
    their key's task as they are, once, and are gathered there: keys repeat too seldom to gather
    them before, and commands would be several times as long. They are dealt by the first two
    keys: a constant one drops out of the grouping, and dealt by it rows would move again.
    """
    gathered = F.collect_list(F.struct(*columns))
    log = F.array_sort(gathered if commands is None else F.flatten(F.transform(gathered, commands)))
    return rows.select(*keys, *columns).repartition(*keys[:2]).groupBy(*keys).agg(F.aggregate(log, start, step).alias("state")).select(*keys, "state.*")


def added_items(commands: DataFrame) -> DataFrame:
    """Adds to an item: sums while it is pending, else the quantity starts again.

    Commands have seq, action (add, or another state to set), quantity, section, origin.
    Section and origin stay those of the first add.
    """
    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0.0).alias("quantity"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("origin"), F.lit(False).alias("there"))

    def step(a: Column, c: Column) -> Column:
        add = c["action"] == "add"
        quantity = F.when(add & (a["state"] == "pendiente"), a["quantity"] + c["quantity"]).when(add, c["quantity"]).otherwise(a["quantity"])
        keep = lambda n: F.when(add & ~a["there"], c[n]).otherwise(a[n]).alias(n)
        return F.struct(F.when(add, F.lit("pendiente")).otherwise(F.when(a["there"], c["action"]).otherwise(a["state"])).alias("state"), quantity.alias("quantity"), keep("section"), keep("origin"), (a["there"] | add).alias("there"))

    return folded(commands, ["project_id", "supplier", "supplier_id"], ["seq", "action", "quantity", "section", "origin"], start, step)


PURCHASE = ("seq", "wanted", "price", "bought", "amount")


def registered_purchases(rows: DataFrame, columns: tuple[str, ...] = PURCHASE, commands=None) -> DataFrame:
    """Purchases of an item in order: amounts and quantities add up, over-buying is refused.

    Commands have seq, wanted, price, bought, amount (null: estimated from the price), in this
    order. They are the rows, or ``commands`` makes a row's from its ``columns``.
    """
    start = F.struct(F.lit(0.0).alias("bought"), F.lit(0.0).alias("amount"), F.lit(0).alias("refused"), F.lit(None).cast("double").alias("wanted"))

    def step(a: Column, c: Column) -> Column:
        good = (c["bought"] > 0) & (a["bought"] + c["bought"] <= c["wanted"] + 1e-9)
        paid = F.coalesce(c["amount"], F.bround(c["bought"] * F.coalesce(c["price"], F.lit(0.0)), 2))
        return F.struct(
            F.when(good, a["bought"] + c["bought"]).otherwise(a["bought"]).alias("bought"), F.when(good, F.bround(a["amount"] + paid, 2)).otherwise(a["amount"]).alias("amount"),
            (a["refused"] + F.when(good, 0).otherwise(1)).alias("refused"), c["wanted"].alias("wanted"),
        )

    rows = folded(rows, ["project_id", "supplier", "supplier_id", "line"], list(columns), start, step, commands)
    state = F.when(F.col("bought") <= 0, "pendiente").when(F.abs(F.col("bought") - F.col("wanted")) <= 1e-9, "comprado").otherwise("parcial")
    return rows.withColumn("state", state)
