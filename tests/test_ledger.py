"""Commands in their order, against one loop over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from andamio.operators import ledger, transitions
from andamio.plans.changes import ITEM

KINDS = {"project_id": "long", "item_id": "long", "quantity": "double", "reviewed": "int", "bought": "double", "amount": "double", "bought_on": "timestamp_ntz", "added": "timestamp_ntz"}
ITEMS = ", ".join(f"{c} {KINDS.get(c, 'string')}" for c in ITEM)
COMMANDS = "project_id long, seq long, kind string, item_id long, new_supplier string, new_supplier_id string, new_quantity double, now timestamp_ntz"
PRODUCTS = "supplier string, supplier_id string, name string, category string, price double"


def item(project, i, product, quantity=1.0, state="pendiente", bought=0.0):
    row = {"project_id": project, "item_id": i, "supplier": "S", "supplier_id": product, "quantity": quantity, "state": state, "bought": bought}
    return tuple(row.get(c) for c in ITEM)


def frames(spark, items, commands, catalogue):
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(commands, COMMANDS), spark.createDataFrame([("S", p, p, "c", 1.0) for p in catalogue], PRODUCTS)


def by_loop(items, commands, catalogue):
    """The answers, and the items that are left, of a loop over all commands."""
    of = {c: ITEM.index(c) for c in ITEM}
    there = {(r[0], r[of["supplier_id"]]): [r[1], r[of["quantity"]], r[of["state"]], r[of["bought"]]] for r in items}
    started, answers = {(r[0], r[1]) for r in items}, {}
    for project, seq, kind, i, _, product, quantity, _ in sorted(commands, key=lambda c: (c[0], c[1])):
        own = next((k for k, v in there.items() if k[0] == project and v[0] == i), None) if i is not None else None
        why, new = None, (project, product)
        if kind != "add":
            why = None if own else "done before" if (project, i) in started else "no such item"
        if not why and kind == "replace":
            why = "bought already" if there[own][3] else "already in the project" if new in there else None
        if not why and kind != "delete" and product not in catalogue:
            why = "not in the catalogue"
        answers[seq] = why
        if why:
            continue
        before = there.pop(own) if kind != "add" else None
        if kind == "replace":
            there[new] = [None, before[1] if quantity is None else quantity, "pendiente", 0.0]
        if kind == "add":
            old = there.get(new)
            there[new] = [old and old[0], (old[1] if old and old[2] == "pendiente" else 0.0) + quantity, "pendiente", old[3] if old else 0.0]
    return answers, sorted((k[0], k[1], v[1], v[2]) for k, v in there.items())


@pytest.mark.parametrize("seed", range(3))
def test_against_a_loop(spark, seed):
    rng = random.Random(seed)
    items = [item(p, 100 * p + n, f"p{n}", float(n + 1), rng.choice(["pendiente", "descartado"]), rng.choice([0.0, 0.0, 0.0, 2.0])) for p in range(6) for n in range(6)]
    commands = []
    for seq in range(400):
        p, kind = rng.choice([0, 0, 0, 1, 2, 3]), rng.choice(["add", "delete", "replace", "replace", "replace"])
        commands.append((p, seq, kind, None if kind == "add" else 100 * p + rng.randrange(7), None if kind == "delete" else "S", None if kind == "delete" else f"p{rng.randrange(12)}", 2.0 if kind == "add" else rng.choice([None, 5.0]), None))
    catalogue = [f"p{n}" for n in range(11)]
    a, b, c = frames(spark, items, commands, catalogue)
    done = ledger.ran(a, b.repartition(5), c).checkpoint(eager=True) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else ledger.ran(a, b.repartition(5), c)
    answers, left = by_loop(items, commands, catalogue)
    assert {r.seq: r.refused for r in done.collect()} == answers
    assert sorted((r.project_id, r.supplier_id, r.quantity, r.state) for r in ledger.after(a, done).collect()) == left


def test_refused_commands_take_nothing_and_replaced_products_return(spark):
    items = [item(1, 1, "a"), item(1, 2, "b"), item(1, 3, "c", bought=1.0), item(2, 4, "a")]
    swap = lambda p, seq, i, product: (p, seq, "replace", i, "S", product, None, None)
    commands = [swap(1, 1, 1, "p"), swap(1, 2, 1, "q"), swap(1, 3, 2, "q"), swap(1, 4, 3, "r"), swap(2, 5, 4, "b"), swap(1, 6, 9, "r")]
    a, b, c = frames(spark, items, commands, "abcpqr")
    assert {r.seq: r.refused for r in ledger.ran(a, b, c).collect()} == {1: None, 2: "done before", 3: None, 4: "bought already", 5: None, 6: "no such item"}
    # The product of a replaced item is free for another one.
    a, b, c = frames(spark, items, [swap(1, 1, 1, "p"), swap(1, 2, 2, "a"), swap(1, 3, 3, "b")], "abcpqr")
    assert [r.refused for r in ledger.ran(a, b, c).orderBy("seq").collect()] == [None, None, "bought already"]
    projects = spark.createDataFrame([(1, 7), (2, 8)], "project_id long, owner_id long")
    mine = b.withColumn("owner_id", F.lit(7).cast("long")).drop("kind")
    left, events = transitions.replaced(a, transitions.replacements(a, mine, projects, c))
    assert sorted((r.item_id, r.supplier_id) for r in left.filter("project_id = 1").collect()) == [(1, "p"), (2, "a"), (3, "c")]
    assert sorted((e.supplier_id_before, e.supplier_id) for e in events.collect()) == [("a", "p"), ("b", "a")]


def test_odd_commands(spark):
    a, b, c = frames(spark, [item(1, 1, "a")], [], "a")
    assert ledger.ran(a, b, c).collect() == [] and ledger.after(a, ledger.ran(a, b, c)).count() == 1
    none = [(None, 1, "delete", None, None, None, None, None), (1, 2, "add", None, None, None, 1.0, None)]
    a, b, c = frames(spark, [item(1, 1, "a")], none, "a")
    assert {r.seq: r.refused for r in ledger.ran(a, b, c).collect()} == {1: "no such item", 2: "not in the catalogue"}
    with pytest.raises(Exception, match="unknown command"):
        a, b, c = frames(spark, [item(1, 1, "a")], [(1, 1, "burn", 1, None, None, None, None)], "a")
        ledger.ran(a, b, c).collect()
