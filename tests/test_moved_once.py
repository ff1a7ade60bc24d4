"""What operators move between tasks: nothing is written before it is asked for, and rows go to their keys once."""

import pytest

from andamio.operators import drawings, ledger
from andamio.plans import changes  # noqa: F401 (registers its queries)
from andamio.plans.queries import QUERIES

from .test_ledger import frames, item
from .test_tables_of_plans import HEAD, TITLE, page


def exchanges(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_of_finishes_are_brought_together_once(spark):
    words, sc = page(spark, *TITLE, *HEAD, ("F1", 522, 150), ("madera", 600, 150), ("F2", 522, 190), ("REGLAMENTO", 600, 190)), spark.sparkContext
    sc.setJobGroup("finishes", "no job yet")
    rows, warnings = drawings.finishes(words)
    assert not sc.statusTracker().getJobIdsForGroup("finishes")
    sc.setJobGroup("", "")
    assert exchanges(rows) == exchanges(warnings) == 1
    assert [r.description for r in rows.collect()] == ["madera"] and [r.warning for r in warnings.collect()] == ["row F2 is the legal text of the sheet"]


@pytest.mark.parametrize(("name", "most"), [("replacement_chains", 10), ("project_ledger", 12), ("item_updates", 7), ("acceptance_events", 6)])
def test_commands_and_items_go_to_their_project_once(spark, name, most):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert 0 < exchanges(QUERIES[name](spark, "/root/testdata/sf0.001")) <= most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_what_is_kept_or_decides_is_moved(spark):
    items, commands, products = frames(spark, [item(1, 1, "a"), item(1, 2, "b", bought=1.0)], [(1, 1, "replace", 1, "S", "p", None, None), (1, 2, "replace", 2, "S", "q", None, None)], "abpq")
    done = ledger.ran(items, commands, products, ["seq"])
    assert done.columns == ["seq", "refused", "after_quantity", "fresh"] and {r.seq: r.refused for r in done.collect()} == {1: None, 2: "bought already"}


def test_null_keys_of_items_meet_no_command(spark):
    items, commands, products = frames(spark, [item(1, None, "a"), item(None, 2, "b")], [(1, 1, "delete", None, None, None, None, None), (None, 2, "delete", 2, None, None, None, None), (None, 3, "add", None, "S", "b", 4.0, None)], "ab")
    assert {r.seq: (r.refused, r.there_item) for r in ledger.ran(items, commands, products).collect()} == {1: ("no such item", None), 2: ("no such item", None), 3: (None, None)}


def test_rows_move_to_their_fold_once_and_become_commands_there(spark):
    for name in ("purchases_fold", "add_items_fold"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        moved = plan.split("Exchange hashpartitioning")
        assert len(moved) == 2, name
        assert "Generate" not in plan and "ObjectHashAggregate" not in moved[1] and "SortAggregate" not in moved[1], name
