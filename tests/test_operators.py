"""Rules of the catalogue operators on a few rows each."""

import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from andamio import streaming
from andamio.functions import specs, text
from andamio.operators import catalogue, drawings, matching, projects, selection, snapshots, suggestions, takeoff, transitions
from andamio.plans import changes

ITEM = "project_id long, supplier string, supplier_id string, line long, quantity double, state string, bought double, amount double, price_when_added double, section string, added string"
PRODUCT = "id long, supplier string, supplier_id string, name string, brand string, category string, subcategory string, price double"


def products(spark, *rows):
    return spark.createDataFrame([(i, s, str(i), name, brand, "Herramientas", None, 1000.0) for i, s, name, brand in rows], PRODUCT)


def test_pending_is_grouped_by_supplier(spark):
    rows = [(1, "X", "a", 1, 10.0, "pendiente", 0.0, None, 5000.0, None, "1"), (1, "X", "b", 2, 5.0, "pendiente", 0.0, None, 8000.0, None, "1"), (1, "Y", "c", 3, 3.0, "pendiente", 0.0, None, 9000.0, None, "1"), (1, "Y", "d", 4, 2.0, "parcial", 2.0, None, 1.0, None, "1")]
    found = projects.pending_by_supplier(spark.createDataFrame(rows, ITEM), products(spark))
    assert {(r.supplier, r["items"], r.subtotal) for r in found.collect()} == {("X", 2, 90000.0), ("Y", 1, 27000.0)}


def test_sections_that_differ_by_accents_are_one(spark):
    rows = [(1, "X", "a", 1, 1.0, "pendiente", 0.0, None, 10.0, "Eléctrico", "1"), (1, "X", "b", 2, 1.0, "comprado", 1.0, None, 5.0, "ELECTRICO", "2"), (1, "X", "c", 3, 1.0, "pendiente", 0.0, None, 1.0, None, "3")]
    found = projects.section_subtotals(spark.createDataFrame(rows, ITEM), products(spark))
    assert {(r.section, r.subtotal) for r in found.collect()} == {("Eléctrico", 15.0), ("Sin partida", 1.0)}


def test_cost_status(spark):
    totals = spark.createDataFrame([(1, 50), (2, 95), (3, 120), (4, 1)], "project_id long, spent long")
    frozen = spark.createDataFrame([(1, 1, 1, 100.0), (2, 1, 1, 100.0), (3, 1, 1, 10.0), (3, 2, 2, 100.0)], "project_id long, baseline_id long, created long, total double")
    found = {r.project_id: r.status for r in projects.cost_control(totals, frozen).collect()}
    assert found == {1: "en_curso", 2: "por_agotarse", 3: "excedido", 4: None}


def test_malformed_order_numbers_do_not_count(spark):
    orders = spark.createDataFrame([(7, "OC-7-3"), (7, "OC-8-9"), (7, "OC-x"), (9, None)], "project_id long, number string")
    assert {r.number for r in projects.next_order_number(orders).collect()} == {"OC-7-4", "OC-9-1"}


def test_groups_follow_chains_of_codes_across_suppliers(spark):
    rows = products(spark, (1, "A", "taladro DW1234 rojo", None), (2, "B", "taladro DW1234 QX9876", None), (3, "C", "rotomartillo QX9876", None), (4, "A", "sierra ZZ5555", None), (5, "A", "sierra ZZ5555", None))
    found = matching.resolve(rows).collect()
    assert [(r.group_id, r.members, r.suppliers) for r in found] == [(1, 3, 3)]


def test_a_code_of_many_products_is_no_evidence(spark):
    rows = products(spark, *((i, f"S{i % 5}", f"pieza{i} AB1234", None) for i in range(39)))
    assert not matching.resolve(rows).collect()


def test_negations_select_nothing(spark):
    terms = spark.createDataFrame([("sin pintura",), ("pintura blanca",)], "term string").withColumn("term_id", F.xxhash64("term"))
    assert {r.query for r in selection.relaxed(terms).collect()} == {"pintura blanca"}


def test_sizes_fit_either_way_round_within_a_fifth(spark):
    names = spark.createDataFrame([("puerta 90 x 210 cm",), ("puerta 210 x 90 cm",), ("puerta 60 x 210 cm",), ("puerta",)], "name string")
    conflict = specs.sizes_conflict(F.col("name"), F.lit(100.0), F.lit(210.0))
    assert [r.c for r in names.select(conflict.alias("c")).collect()] == [False, False, True, None]


def test_acceptance_counts_only_suggestions_of_plans(spark):
    rows = [("item_agregado", "alta", "plano", None, None, None), ("item_agregado", "alta", "manual", None, None, None)]
    events = spark.createDataFrame(rows, "kind string, confidence string, origin string, material string, category string, seconds double")
    found = {r.confidence: (r.suggested, r.pending, r.precision) for r in suggestions.acceptance(events).collect()}
    assert found == {"alta": (1, 1, None), "media": (0, 0, None), "baja": (0, 0, None), "total": (1, 1, None)}


def test_names_go_to_the_nearest_code_that_is_free(spark):
    codes = spark.createDataFrame([(0, 1, "P1", 10.0), (0, 1, "P2", 20.0), (0, 2, "P1", 5.0), (0, 2, "P2", 50.0)], "project_id long, page int, code string, y0 double")
    names = spark.createDataFrame([(0, 1, "near both", 16.0), (0, 2, "second", 90.0), (0, 2, "first", 70.0)], "project_id long, page int, name string, y0 double")
    found = {(r.page, r.code, r.name) for r in drawings.nearest_names(codes, names).collect()}
    assert found == {(1, "P2", "near both"), (2, "P1", "first"), (2, "P2", "second")}


def test_normalising(spark):
    rows = spark.createDataFrame([("Tubo N° 3/4\" PVC",), ("Lámina 2x3x4",), (None,), ("",)], "t string")
    assert [r.n for r in rows.select(text.normalize(F.col("t")).alias("n")).collect()] == ["tubo n 3 4 pulg pvc", "lamina 2 x 3x4", "", ""]


def test_the_rest_imports_without_the_corpus_operators():
    code = """
        import sys

        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name in ("andamio.llm", "corpus_pipeline"):
                    raise ModuleNotFoundError(f"No module named {name!r}", name=name)

        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert e.queries() and not any(k.startswith("op1") or k == "pipeline" for k in e.queries())
        assert set(e.oracle_sql()) <= set(e.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True)


NAMES = [
    ("tubo 1/2 x 60 cm", {"longitud_cm": 60.0}), ("panel 30x244 centimetros", {"longitud_cm": 30.0}), ("Adaptador macho PVC SCH40 1/2\"", {"diametro_pulg": 0.5, "schedule": 40.0}),
    ("union 2-1/2 pulg", {"diametro_pulg": 2.5}), ("1/16 galon masilla", {"volumen_l": 0.2366}), ("bomba 1/2 Hp", {"potencia_hp": 0.5, "diametro_pulg": None}), ("500 mililitros", {"volumen_l": 0.5}),
    ("aire 12.000 BTU", {"energia_btu": 12000.0}), ("breaker 15A", {"amperaje_a": 15.0}), ("21142A-8H", {"amperaje_a": None}), ("codo 90°", {"angulo_grados": 90.0}), ("termo 90°C", {"angulo_grados": None}),
    ("varilla #3", {"calibre": 3.0}), ("cable 12 AWG", {"calibre_awg": 12.0}), ("foco 220Vac 9w", {"voltaje": 220.0, "potencia_w": 9.0}), ("caja 100 pzas", {"cantidad_unidades": 100.0}), ("lamina 1/0 pulg", {"diametro_pulg": None}), (None, {"peso_kg": None}),
]


def test_numbers_in_names(spark):
    rows = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NAMES)], "i int, name string").select("i", specs.all_specs(F.col("name")).alias("s")).collect()
    for r in rows:
        for key, value in NAMES[r.i][1].items():
            assert r.s[key] == value, (NAMES[r.i][0], key, r.s[key])


def test_upsert_carries_every_column_and_keeps_what_a_batch_does_not_know(spark):
    kind = "supplier string, supplier_id string, sku string, name string, brand string, category string, subcategory string, price double, vat double, tax_code string, description string, image string, images string, url string, online boolean, weight string, updated string"
    old = spark.createDataFrame([("A", "1", "s", "old", "b", "c", "d", 1.0, 0.13, "t", "text", "i", "[1]", "u", True, "w", "1"), ("A", "2", "s", "stays", *[None] * 13), (None, "3", None, "null key", *[None] * 13)], kind)
    new = spark.createDataFrame([("A", "1", None, "new", None, "c2", None, 2.0, None, None, None, None, None, None, None, None, "2"), (None, "3", None, "another", *[None] * 13)], kind)
    out = {(r.supplier, r.name): r for r in catalogue.upserted(old, new).collect()}
    assert set(out) == {("A", "new"), ("A", "stays"), (None, "null key"), (None, "another")}
    r = out["A", "new"]
    assert (r.sku, r.brand, r.subcategory, r.description, r.weight, r.images) == ("s", "b", "d", "text", "w", "[1]")
    assert (r.category, r.price, r.vat, r.tax_code, r.image, r.url, r.online, r.updated) == ("c2", 2.0, None, None, None, None, None, "2")


def test_lines_derive_from_derived_lines(spark):
    tables = takeoff.rules(spark)
    kind = "system string, material string, per_unit double, waste double, rounding string, fixed boolean, derived_from string, optional boolean"
    chain = [("muro_block", "a", 2.0, 1.0, "int", False, None, False), ("muro_block", "b", 0.5, 1.0, "dec", False, "a", False), ("muro_block", "c", 3.0, 1.0, "int", False, "b", False)]
    asked = spark.createDataFrame([(1, "muro_block", 3.0, None)], "request_id long, system string, amount double, region string")
    got = {r.material: r.quantity for r in takeoff.material_lines(asked, tables | {"materials": spark.createDataFrame(chain, kind)}).collect()}
    assert got == {"a": 6.0, "b": 3.0, "c": 9.0}
    with pytest.raises(ValueError, match="circle"):
        takeoff.derivation_depth(spark.createDataFrame([*chain[1:], ("muro_block", "a", 1.0, 1.0, "int", False, "c", False)], kind))


def test_unknown_kinds_and_states_stop_the_job(spark):
    with pytest.raises(Exception, match="unknown kind of event: nonsense"):
        transitions.checked_events(spark.createDataFrame([("item_agregado",), ("nonsense",)], "kind string")).collect()
    items = changes.placed(spark, "/root/testdata/sf0.001").select(*changes.ITEM).limit(1)
    first = items.first()
    owner = spark.createDataFrame([(first.project_id, 5)], "project_id long, owner_id long")
    command = spark.createDataFrame([(first.project_id, 5, first.item_id, 1, None, "sold", None, None, None, None)], "project_id long, owner_id long, item_id long, seq int, quantity double, state string, priority string, comment string, section string, reviewed int").withColumn("now", F.lit("2024-01-01").cast("timestamp_ntz"))
    with pytest.raises(Exception, match="unknown state: sold"):
        transitions.updates(items, command, owner).collect()
    assert transitions.updates(items, command.limit(0), owner).collect() == []


def test_a_pair_without_a_shared_code_has_the_mean_of_its_signals(spark):
    rows = products(spark, (1, "A", "taladro rojo 10 mm", "X"), (2, "B", "taladro azul grande 10 mm", "Y"))
    prints = matching.fingerprints(rows)
    pair = spark.createDataFrame([(1, 2)], "a long, b long")
    (r,) = matching.confidence(matching.compared(pair, prints)).collect()
    assert r.veto == "colour" and r.score == 0.0
    rows = products(spark, (1, "A", "taladro fino 10 mm", "X"), (2, "B", "taladro grande 10 mm", "Y"))
    (r,) = matching.confidence(matching.compared(pair, matching.fingerprints(rows))).collect()
    # Other brand 0, tokens 1 of 3, one category, equal millimetres.
    assert r.score == round((0.20 * 0.3333 + 0.05 + 0.03) / (0.20 + 0.20 + 0.05 + 0.03), 4)


def test_streams(spark, tmp_path):
    kind = "supplier string, supplier_id string, name string, brand string, price double, seq long"
    for n, rows in enumerate([[("A", "1", "one", "b", 1.0, 1), ("A", "2", "two", None, 2.0, 2)], [("A", "1", "uno", None, 3.0, 3)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streaming.upsert_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        got = {r.supplier_id: (r["name"], r.brand, r.price) for r in snapshots.snapshot(spark, f"{tmp_path}/out", n).collect()}
    assert got == {"1": ("uno", "b", 3.0), "2": ("two", None, 2.0)}
    events = spark.createDataFrame([("item_agregado", "alta", "2024-01-01 10:00:00"), ("seleccion_aceptada", "alta", "2024-01-01 23:00:00"), ("item_agregado", "alta", "2024-01-02 01:00:00")], "kind string, confidence string, created string")
    events.write.parquet(f"{tmp_path}/events")
    asked = streaming.suggestion_windows(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    asked.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [(r.suggested, r.accepted) for r in spark.table("windows").orderBy("begin").collect()] == [(1, 1), (1, 0)]
