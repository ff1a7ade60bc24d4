"""Queries of changes: item updates, deletions, replacements, events, patches and look-ups.

Items are the lines of an order by product; what happens to them follows from columns
of theirs, over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from andamio.operators import ledger, projects, selection, transitions
from andamio.sources import domain
from andamio.sources.domain import with_views

from .queries import AS_OF, _LIVE, amount_sql, half_even_exact_sql, query, sold

def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def placed(s: SparkSession, d: str, by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """The items, dealt to tasks by ``by`` (of project_id and item_id), so what meets them by these columns does not move them again."""
    line = domain.table(s, d, "lineitem").withColumn("project_id", F.col("l_orderkey")).withColumn("item_id", F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).repartition(*by)
    none = lambda kind: F.lit(None).cast(kind)
    rows = line.groupBy("project_id", "item_id", "l_partkey").agg(
        F.max("l_quantity").alias("quantity"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.min("l_linenumber").alias("n"), F.min("l_tax").alias("tax"),
        F.min("l_discount").alias("low"), F.max("l_discount").alias("high"), F.min("l_shipdate").alias("added"),
    )
    return rows.select(
        "project_id", "item_id", F.concat(F.lit("S"), (F.col("l_partkey") % 7).cast("string")).alias("supplier"), F.col("l_partkey").cast("string").alias("supplier_id"), "quantity",
        F.when(F.col("flag") == "A", "comprado").otherwise("pendiente").alias("state"), none("string").alias("priority"), none("string").alias("comment"), none("string").alias("section"), F.when(F.col("status") == "O", 1).otherwise(0).alias("reviewed"),
        F.when(F.col("flag") == "A", F.col("quantity")).otherwise(0.0).alias("bought"), none("double").alias("amount"), none("timestamp_ntz").alias("bought_on"), F.when(F.col("n") == 1, "manual").otherwise("plano").alias("origin"),
        F.when(F.col("tax") <= 0.04, "alta").alias("confidence"), F.lit("Pinturas").alias("category"), none("string").alias("text"), F.col("added").cast("timestamp_ntz").alias("added"), "low", "high", "tax", "l_partkey",
    )


ITEM_KEY = ("project_id", "item_id")
ITEM = ("project_id", "item_id", "supplier", "supplier_id", "quantity", "state", "priority", "comment", "section", "reviewed", "bought", "amount", "bought_on", "origin", "confidence", "category", "text", "added")

_PLACED = """, placed AS (SELECT *, flag = 'A' AS was_bought, CASE WHEN flag = 'A' THEN 'comprado' ELSE 'pendiente' END AS state, (status = 'O')::INTEGER AS reviewed, CASE WHEN flag = 'A' THEN quantity ELSE 0.0::DOUBLE END AS bought,
  CASE WHEN n = 1 THEN 'manual' ELSE 'plano' END AS origin, CASE WHEN tax <= 0.04 THEN 'alta' END AS confidence, project_id * 1000000 + l_partkey AS item_id, 'S' || (l_partkey % 7) AS supplier, l_partkey::VARCHAR AS supplier_id
  FROM (SELECT l_orderkey AS project_id, l_partkey, max(l_quantity) AS quantity, max(l_returnflag) AS flag, max(l_linestatus) AS status, min(l_linenumber) AS n, min(l_tax) AS tax, min(l_discount) AS low, max(l_discount) AS high, min(l_shipdate) AS added
    FROM lineitem GROUP BY l_orderkey, l_partkey) x)"""
_OPEN = "(reviewed = 0 AND origin = 'plano' AND confidence IS NOT NULL)"
_AGE = "epoch({now} - added)"


def _with_owner(s, d, rows: DataFrame) -> DataFrame:
    """Commands of the owner, but for items of a high tax, where a stranger gives them."""
    owners = domain.projects(s, d).select("project_id", F.col("owner_id").alias("real"))
    return rows.join(owners, "project_id").withColumn("owner_id", F.when(F.col("tax") < 0.07, F.col("real")).otherwise(-1))


def _updates(s, d) -> DataFrame:
    rows = _with_owner(s, d, placed(s, d))
    none = lambda kind: F.lit(None).cast(kind)
    both = [none("string").alias(c) for c in ("priority", "comment", "section")]
    state = F.when(F.col("low") < 0.03, "comprado").when(F.col("low") < 0.05, "pendiente")
    given = lambda seq, quantity, state, reviewed, at: F.struct(F.lit(seq).alias("seq"), quantity.alias("quantity"), state.alias("state"), *both, reviewed.alias("reviewed"), at.alias("now"))
    first = given(1, none("double"), state, none("int"), now())
    second = given(2, F.when(F.col("low") > 0.05, F.col("quantity") + 1), none("string"), F.when(F.col("high") > 0.08, 1), now() + F.expr("INTERVAL 1 DAY"))
    commands = rows.select("project_id", "owner_id", "item_id", F.explode(F.array(first, second)).alias("c")).select("project_id", "owner_id", "item_id", "c.*")
    return transitions.updates(placed(s, d, ITEM_KEY).select(*ITEM), commands, domain.projects(s, d))


_MINE = "tax < 0.07"
_S1 = f"CASE WHEN {_MINE} THEN CASE WHEN low < 0.03 THEN 'comprado' WHEN low < 0.05 THEN 'pendiente' END END"


@query("item_updates", with_views("projects", _PLACED + f""", c AS (SELECT *, {_S1} AS s1 FROM placed)
SELECT item_id, CASE WHEN {_MINE} AND low > 0.05 THEN quantity + 1 ELSE quantity END AS quantity, coalesce(s1, state) AS state, CASE WHEN {_MINE} AND high > 0.08 THEN 1 ELSE reviewed END AS reviewed,
  CASE s1 WHEN 'comprado' THEN quantity WHEN 'pendiente' THEN 0 ELSE bought END AS bought, CASE WHEN s1 = 'comprado' THEN TIMESTAMP '{AS_OF}' END AS bought_on FROM c"""))
def _(s, d):
    items = placed(s, d, ITEM_KEY).select(*ITEM)
    return transitions.updated(items, _updates(s, d)).select("item_id", "quantity", "state", "reviewed", "bought", "bought_on")


@query("acceptance_events", with_views("projects", _PLACED + f""", c AS (SELECT *, {_S1} AS s1 FROM placed WHERE {_OPEN}),
e AS (SELECT *, TIMESTAMP '{AS_OF}' AS created FROM c WHERE s1 IS NOT NULL UNION ALL SELECT *, TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY FROM c WHERE {_MINE} AND high > 0.08)
SELECT 'seleccion_aceptada' AS kind, item_id, supplier, supplier_id, {_AGE.format(now="created")}::DOUBLE AS seconds, created FROM e"""))
def _(s, d):
    return transitions.checked_events(transitions.acceptances(_updates(s, d))).select("kind", "item_id", "supplier", "supplier_id", "seconds", "created")


def _deletions(s, d) -> tuple[DataFrame, DataFrame]:
    rows = _with_owner(s, d, placed(s, d)).filter("high >= 0.08").select("project_id", "owner_id", "item_id", now().alias("now"))
    return transitions.deleted(placed(s, d, ITEM_KEY).select(*ITEM), rows, domain.projects(s, d))


@query("deleted_items", with_views("projects", _PLACED + f" SELECT item_id, quantity, state FROM placed WHERE NOT (high >= 0.08 AND {_MINE})"))
def _(s, d):
    return _deletions(s, d)[0].select("item_id", "quantity", "state")


@query("deletion_events", with_views("projects", _PLACED + f""" SELECT item_id, CASE WHEN {_OPEN} THEN 'seleccion_eliminada' ELSE 'item_eliminado' END AS kind,
  CASE WHEN {_OPEN} THEN {_AGE.format(now=f"TIMESTAMP '{AS_OF}'")}::DOUBLE END AS seconds FROM placed WHERE high >= 0.08 AND {_MINE}"""))
def _(s, d):
    return transitions.checked_events(_deletions(s, d)[1]).select("item_id", "kind", "seconds")


def _replacements(s, d) -> DataFrame:
    target = F.col("l_partkey") + 1
    rows = _with_owner(s, d, placed(s, d)).filter("low <= 0.02")
    commands = rows.select("project_id", "owner_id", "item_id", F.lit(1).alias("seq"), F.concat(F.lit("S"), (target % 7).cast("string")).alias("new_supplier"), target.cast("string").alias("new_supplier_id"), F.when(F.col("high") > 0.05, 2.0).alias("new_quantity"), now().alias("now"))
    return transitions.replacements(placed(s, d).select(*ITEM), commands, domain.projects(s, d), sold(s, d))


_SWAPS = _PLACED + f""", swaps AS (SELECT a.*, CASE WHEN a.bought <> 0 THEN 'bought already' WHEN b.item_id IS NOT NULL THEN 'already in the project' WHEN p.p_partkey IS NULL THEN 'not in the catalogue' END AS refused
  FROM placed a LEFT JOIN placed b ON a.project_id = b.project_id AND a.l_partkey + 1 = b.l_partkey LEFT JOIN part p ON p.p_partkey = a.l_partkey + 1 AND p.p_size <= 45 WHERE a.low <= 0.02 AND a.{_MINE})"""


@query("item_replacements", with_views("projects", _SWAPS + " SELECT item_id, (l_partkey + 1)::VARCHAR AS new_supplier_id, refused FROM swaps"))
def _(s, d):
    return _replacements(s, d).select("item_id", "new_supplier_id", "refused")


@query("replaced_items", with_views("projects", _SWAPS + """ SELECT item_id, supplier, supplier_id, quantity, state, origin, reviewed FROM placed WHERE item_id NOT IN (SELECT item_id FROM swaps WHERE refused IS NULL)
UNION ALL SELECT item_id, 'S' || ((l_partkey + 1) % 7), (l_partkey + 1)::VARCHAR, CASE WHEN high > 0.05 THEN 2.0 ELSE quantity END, 'pendiente', 'manual', 1 FROM swaps WHERE refused IS NULL"""))
def _(s, d):
    return transitions.replaced(placed(s, d).select(*ITEM), _replacements(s, d))[0].select("item_id", "supplier", "supplier_id", "quantity", "state", "origin", "reviewed")


@query("replacement_events", with_views("projects", _SWAPS + f""" SELECT item_id, 'seleccion_reemplazada' AS kind, (l_partkey + 1)::VARCHAR AS supplier_id, supplier_id AS supplier_id_before,
  CASE WHEN {_OPEN} THEN {_AGE.format(now=f"TIMESTAMP '{AS_OF}'")}::DOUBLE END AS seconds FROM swaps WHERE refused IS NULL"""))
def _(s, d):
    return transitions.checked_events(transitions.replaced(placed(s, d).select(*ITEM), _replacements(s, d))[1]).select("item_id", "kind", "supplier_id", "supplier_id_before", "seconds")


# -- commands in their order ---------------------------------------------------------------------------

_CHAINS = _PLACED + """, links AS (SELECT *, coalesce(lead(l_partkey) OVER w, l_partkey + 1) AS target, lead(l_partkey) OVER w IS NOT NULL AS held FROM placed WINDOW w AS (PARTITION BY project_id ORDER BY l_partkey)),
known AS (SELECT l.*, p.p_partkey IS NOT NULL AS listed FROM links l LEFT JOIN part p ON p.p_partkey = target AND p.p_size <= 45),
free AS (SELECT *, bool_and(bought = 0 AND listed) OVER (PARTITION BY project_id ORDER BY l_partkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS freed FROM known)"""


@query("replacement_chains", with_views("projects", _CHAINS + """ SELECT item_id, target::VARCHAR AS new_supplier_id,
  CASE WHEN bought <> 0 THEN 'bought already' WHEN held AND NOT freed THEN 'already in the project' WHEN NOT listed THEN 'not in the catalogue' END AS refused FROM free"""))
def _(s, d):
    """Every item takes the product of the next one, which is free if that one was replaced before."""
    rows = placed(s, d).join(domain.projects(s, d).select("project_id", "owner_id"), "project_id")
    target = F.coalesce(F.lead("l_partkey").over(Window.partitionBy("project_id").orderBy("l_partkey")), F.col("l_partkey") + 1)
    commands = rows.select("project_id", "owner_id", "item_id", (-F.col("l_partkey")).alias("seq"), F.concat(F.lit("S"), (target % 7).cast("string")).alias("new_supplier"), target.cast("string").alias("new_supplier_id"), F.lit(None).cast("double").alias("new_quantity"), now().alias("now"))
    return transitions.replacements(placed(s, d).select(*ITEM), commands, domain.projects(s, d), sold(s, d), ["item_id", "new_supplier_id"]).select("item_id", "new_supplier_id", "refused")


@query("project_ledger", "WITH " + _PLACED.lstrip(", ") + """, c AS (SELECT p.*, high >= 0.08 AS goes, CASE WHEN part.p_partkey IS NULL THEN NULL WHEN low <= 0.02 THEN 2.0 WHEN low >= 0.05 THEN 3.0 END AS more FROM placed p LEFT JOIN part ON part.p_partkey = l_partkey AND part.p_size <= 45)
SELECT project_id, supplier_id, CASE WHEN more IS NULL THEN quantity WHEN goes OR state <> 'pendiente' THEN more ELSE quantity + more END::DOUBLE AS quantity, CASE WHEN more IS NULL THEN state ELSE 'pendiente' END AS state, CASE WHEN NOT goes THEN item_id END AS item_id
FROM c WHERE NOT goes OR more IS NOT NULL""")
def _(s, d):
    """Items are deleted, then some of their products are added again or once more."""
    rows = placed(s, d)
    none = lambda kind: F.lit(None).cast(kind)
    goes = F.struct(F.lit(1).alias("seq"), F.lit("delete").alias("kind"), "item_id", none("string").alias("new_supplier"), none("string").alias("new_supplier_id"), none("double").alias("new_quantity"), now().alias("now"))
    more = F.when(F.col("low") <= 0.02, 2.0).when(F.col("low") >= 0.05, 3.0)
    adds = F.struct(F.lit(2).alias("seq"), F.lit("add").alias("kind"), none("long").alias("item_id"), F.col("supplier").alias("new_supplier"), F.col("supplier_id").alias("new_supplier_id"), more.alias("new_quantity"), now().alias("now"))
    given = F.array_compact(F.array(F.when(F.col("high") >= 0.08, goes), F.when(more.isNotNull(), adds)))
    commands = rows.select("project_id", F.explode(given).alias("c")).select("project_id", "c.*")
    items = rows.select(*ITEM)
    return ledger.after(items, ledger.ran(items, commands, sold(s, d), list(ledger.AFTER))).drop("supplier")


def _quoted(s, d) -> tuple[DataFrame, DataFrame]:
    """Materials of 200 plans by part; what is chosen for them, and what the projects hold already, from columns of theirs."""
    part, size, key = domain.table(s, d, "part"), F.col("p_size"), F.col("p_partkey")
    none = lambda kind: F.lit(None).cast(kind)
    rule = F.when(F.col("p_type") == "SMALL", "cuadro_puertas").otherwise("computo_estructural")
    materials = part.select((key % 200).alias("project_id"), key.alias("term_id"), key.alias("seq"), rule.alias("rule"), F.when(size % 4 != 0, size.cast("double")).alias("quantity"), size.alias("page"), F.col("p_name").alias("text"), F.lit("alta").alias("source_confidence"), now().alias("now"))
    chosen = part.filter(size > 10).select(key.alias("term_id"), (key % 97 + 1).alias("id"), F.when(size > 30, "alta").otherwise("baja").alias("confidence"))
    held = part.groupBy((key % 200).alias("project_id"), (key * 7 % 97 + 1).alias("p")).agg(F.min(size).alias("least"), F.max(size).cast("double").alias("quantity"))
    product = F.col("p")
    values = {"item_id": F.col("project_id") * 1000 + product, "supplier": F.concat(F.lit("S"), (product % 7).cast("string")), "supplier_id": product.cast("string"), "state": F.when(F.col("least") < 25, "pendiente").otherwise("descartado"), "reviewed": F.lit(1), "bought": F.lit(0.0), "origin": F.lit("manual")}
    kinds = {"amount": "double", "bought_on": "timestamp_ntz", "added": "timestamp_ntz", "page": "int"}
    items = held.select(*(F.col(c) if c in ("project_id", "quantity") else values[c].alias(c) if c in values else none(kinds.get(c, "string")).alias(c) for c in (*ITEM, "rule", "page", "source_confidence")))
    return selection.quoted(materials, chosen, items, domain.products(s, d))


_MATERIALS = """WITH m AS (SELECT p_partkey % 200 AS project_id, p_partkey AS seq, CASE WHEN p_type = 'SMALL' THEN 'cuadro_puertas' ELSE 'computo_estructural' END AS rule, CASE WHEN p_size % 4 <> 0 THEN p_size::DOUBLE ELSE 1.0 END AS quantity, CASE WHEN p_size > 10 THEN p_partkey % 97 + 1 END AS id, CASE WHEN p_size > 30 THEN 'alta' ELSE 'baja' END AS match, p_size AS page FROM part),
held AS (SELECT p_partkey % 200 AS project_id, p_partkey * 7 % 97 + 1 AS id, CASE WHEN min(p_size) < 25 THEN 'pendiente' ELSE 'descartado' END AS state, max(p_size)::DOUBLE AS quantity FROM part GROUP BY ALL),"""


@query("quote_upsert", _MATERIALS + """ a AS (SELECT project_id, id, sum(quantity) AS more, min_by(rule, seq) AS rule, min_by(match, seq) AS match, min_by(page, seq) AS page FROM m WHERE id IS NOT NULL GROUP BY ALL)
SELECT project_id, id::VARCHAR AS supplier_id, (coalesce(CASE WHEN h.state = 'pendiente' OR a.id IS NULL THEN h.quantity END, 0) + coalesce(more, 0))::DOUBLE AS quantity, CASE WHEN a.id IS NULL THEN h.state ELSE 'pendiente' END AS state, CASE WHEN h.id IS NULL THEN 'plano' ELSE 'manual' END AS origin,
  (h.id IS NOT NULL)::INTEGER AS reviewed, CASE WHEN h.id IS NULL THEN rule END AS rule, CASE WHEN h.id IS NULL THEN match END AS confidence, CASE WHEN h.id IS NULL THEN page END AS page
FROM a FULL JOIN held h USING (project_id, id)""")
def _(s, d):
    return _quoted(s, d)[0].select("project_id", "supplier_id", "quantity", "state", "origin", "reviewed", "rule", "confidence", "page")


@query("quote_counters", _MATERIALS.rstrip(",") + " SELECT project_id, count(id) AS added, count(*) - count(id) AS unfound FROM m GROUP BY project_id")
def _(s, d):
    return _quoted(s, d)[1]


# -- patches, look-ups, limits ---------------------------------------------------------------------


@query("patched_projects", with_views("projects", """ SELECT p.project_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'activo' ELSE state END AS state, CASE WHEN o_orderpriority = '5-LOW' THEN 99.0 WHEN o_orderpriority = '1-URGENT' THEN 7.0 ELSE area_m2 END AS area_m2, owner_id
FROM projects p JOIN orders ON o_orderkey = project_id"""))
def _(s, d):
    rank = domain.table(s, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_orderpriority").alias("p"))
    none = lambda kind: F.lit(None).cast(kind)
    # Owners are no field of a patch; the second patch of an urgent project leaves its area alone.
    a = rank.select("project_id", F.lit(1).alias("seq"), F.when(F.col("p") == "1-URGENT", "activo").alias("state"), F.when(F.col("p") == "5-LOW", 99.0).when(F.col("p") == "1-URGENT", 7.0).alias("area_m2"), F.lit(-5).cast("long").alias("owner_id"))
    b = rank.select("project_id", F.lit(2).alias("seq"), none("string").alias("state"), none("double").alias("area_m2"), F.lit(-5).cast("long").alias("owner_id"))
    return transitions.patched(domain.projects(s, d), a.unionByName(b), "project_id", ("state", "area_m2")).select("project_id", "state", "area_m2", "owner_id")


@query("owned_projects", with_views("projects", " SELECT project_id, state FROM projects WHERE owner_id = 7 AND state <> 'archivado'"))
def _(s, d):
    return transitions.owned(domain.projects(s, d), F.lit(7)).select("project_id", "state")


@query("projects_looked_up", with_views("projects", """ SELECT o_orderkey AS request_id, project_id, state, area_m2 FROM orders JOIN projects ON o_orderkey = project_id WHERE o_orderstatus = 'P' OR o_orderpriority <> '1-URGENT'"""))
def _(s, d):
    rows = domain.projects(s, d).withColumn("token", F.concat(F.lit("T"), F.col("project_id").cast("string")))
    key, urgent = F.col("o_orderkey"), F.col("o_orderpriority") == "1-URGENT"
    wanted = domain.table(s, d, "orders").select(key.alias("request_id"), F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("T"), key.cast("string"))).alias("token"), key.alias("project_id"), F.when(urgent, -1).otherwise(F.col("o_custkey")).alias("owner_id"))
    return transitions.shared_view(transitions.looked_up(rows, wanted), transitions.PROJECT_INTERNAL).select("request_id", "project_id", "state", "area_m2")


@query("shared_projects", with_views("projects", " SELECT project_id, state, created, area_m2 FROM projects"))
def _(s, d):
    return transitions.shared_view(domain.projects(s, d), transitions.PROJECT_INTERNAL)


@query("running_plans", "SELECT o_custkey AS owner_id, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS running FROM orders GROUP BY 1")
def _(s, d):
    state = F.when(F.col("o_orderpriority") == "1-URGENT", "procesando").otherwise("listo")
    return transitions.busy(domain.table(s, d, "orders").select(F.col("o_custkey").alias("owner_id"), state.alias("plan_state")))


@query("clamped_limits", "SELECT c_custkey, least(greatest(floor(c_acctbal / 500)::BIGINT, 1), 12) AS similar, least(greatest(floor(c_acctbal / 10)::BIGINT, 1), 200) AS metrics FROM customer")
def _(s, d):
    limit = lambda by, most: transitions.clamped(F.floor(F.col("c_acctbal") / by), 1, most)
    return domain.table(s, d, "customer").select("c_custkey", limit(500, 12).alias("similar"), limit(10, 200).alias("metrics"))


# -- purchases -----------------------------------------------------------------------------------------


@query("purchase_orders", with_views("products items", _LIVE + f""", o AS (SELECT project_id, supplier, count(*) AS lines, {half_even_exact_sql("sum(" + amount_sql("quantity - bought", "price") + ")")} AS total
  FROM live WHERE state IN ('pendiente', 'parcial') AND quantity - bought > 0 GROUP BY ALL)
SELECT project_id, supplier, lines, total, 'OC-' || project_id || '-' || (2 + row_number() OVER (PARTITION BY project_id ORDER BY supplier)) AS number FROM o"""))
def _(s, d):
    live = projects.live_over_snapshot(domain.items(s, d), sold(s, d)).filter(F.col("state").isin(*projects.OPEN_STATES)).withColumn("left", projects.remaining()).filter("left > 0")
    taken = domain.projects(s, d).select("project_id", F.concat(F.lit("OC-"), F.col("project_id").cast("string"), F.lit("-2")).alias("number"))
    return transitions.purchase_orders(live.withColumn("name", F.col("live_name")), taken, now()).select("project_id", "supplier", "lines", "total", "number")


_PURCHASES = """, parts AS (SELECT *, unnest([0.25, 0.5, 0.5]) AS part FROM items),
cmd AS (SELECT project_id, supplier, supplier_id, line, quantity AS wanted, price_when_added AS price, floor(quantity * part)::DOUBLE AS bought, row_number() OVER (PARTITION BY project_id, supplier, supplier_id, line ORDER BY part, added, quantity, price_when_added) AS n FROM parts),
"""


@query("refused_purchases", with_views("products items", _PURCHASES + """fold AS (
  SELECT *, CASE WHEN NOT bought > 0 THEN 'not a quantity' WHEN bought > wanted + 1e-9 THEN 'more than is wanted' END AS reason, CASE WHEN bought > 0 AND bought <= wanted + 1e-9 THEN bought ELSE 0 END AS held FROM cmd WHERE n = 1
  UNION ALL SELECT c.*, CASE WHEN NOT c.bought > 0 THEN 'not a quantity' WHEN f.held + c.bought > c.wanted + 1e-9 THEN 'more than is wanted' END, CASE WHEN c.bought > 0 AND f.held + c.bought <= c.wanted + 1e-9 THEN f.held + c.bought ELSE f.held END
  FROM fold f JOIN cmd c ON c.project_id = f.project_id AND c.supplier = f.supplier AND c.supplier_id = f.supplier_id AND c.line = f.line AND c.n = f.n + 1)
SELECT project_id, supplier_id, line, wanted, bought, reason FROM fold WHERE reason IS NOT NULL""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(s, d):
    rows = domain.items(s, d).withColumn("part", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.5))))
    commands = rows.select("project_id", "supplier", "supplier_id", "line", F.struct("part", "added").alias("seq"), F.col("quantity").alias("wanted"), F.floor(F.col("quantity") * F.col("part")).cast("double").alias("bought"))
    return transitions.refused_purchases(commands).select("project_id", "supplier_id", "line", "wanted", "bought", "reason")
