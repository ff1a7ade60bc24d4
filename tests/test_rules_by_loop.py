"""Queries that have no SQL, against loops in Python over the same tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from andamio.functions import specs
from andamio.operators import selection
from andamio.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def number(text):
    text = text.strip()
    if "/" in text:
        if m := re.fullmatch(r"(\d+)[\s\-]+(\d+)/(\d+)", text):
            return round(int(m[1]) + int(m[2]) / int(m[3]), 4) if int(m[3]) else None
        m = re.fullmatch(r"(\d+)\s*/\s*(\d+)", text)
        return round(int(m[1]) / int(m[2]), 4) if m and int(m[2]) else None
    return float(text.replace(",", "."))


def test_document_specs(spark):
    found = QUERIES["document_specs"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", specs.prepared(F.col("text")).alias("base")), "doc_id").collect()
    assert found
    hits = 0
    for r in found:
        for name, pattern in specs.PATTERNS.items():
            m = re.search(pattern, r.base, re.ASCII)
            want = number(m[1]) if m else None
            hits += m is not None
            assert r.specs[name] == (None if want is None else pytest.approx(want, abs=1e-4)), (r.doc_id, name)
        for w, h, unit in [(m[1], m[2], m[3]) for m in re.finditer(r"(\d+(?:[.,]\d+)?)\s*x\s*(\d+(?:[.,]\d+)?)\s*(mm|cm|m\b|pulg|\"|″)?", r.base, re.ASCII)][:1]:
            factor = {"mm": 0.1, "cm": 1.0, "m": 100.0, None: 100.0 if number(w) < 10 and number(h) < 10 else 1.0}.get(unit, 2.54)
            assert (r.sizes[0].w, r.sizes[0].h) == (pytest.approx(number(w) * factor, abs=1e-3), pytest.approx(number(h) * factor, abs=1e-3))
    assert hits > 0


def test_nearest_names(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").collect()
    pages = {}
    for r in rows:
        code, y = r.l_linenumber % 2 == 0, r.l_linenumber * 70.0 + r.l_partkey % 11 * 40
        pages.setdefault(r.l_orderkey, ([], []))[0 if code else 1].append((y, f"P{r.l_linenumber}" if code else f"w{r.l_suppkey}"))
    want = []
    for page, (codes, names) in pages.items():
        codes, names = sorted(codes), sorted(names)
        if len(codes) == len(names):
            want += [(page, c, n) for (_, c), (_, n) in zip(codes, names, strict=True)]
            continue
        taken = (set(), set())
        for _, i, j in sorted((abs(a - b), i, j) for i, (a, _) in enumerate(codes) for j, (b, _) in enumerate(names)):
            if i not in taken[0] and j not in taken[1]:
                taken[0].add(i), taken[1].add(j)
                want.append((page, codes[i][1], names[j][1]))
    assert sorted((r.page, r.code, r.name) for r in QUERIES["nearest_names"](spark, SF).collect()) == sorted(want)


def test_sections_of_pieces_are_in_centimetres(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    openings = none("key long, kind string, material string, width_m double, height_m double, quantity double")
    finishes = none("key long, place string, description string")
    pieces = spark.createDataFrame([(1, "tabla", 1.0, 50.0, 100.0), (2, "viga", 1.0, None, 100.0)], "key long, description string, quantity double, width_mm double, height_mm double")
    got = {r.key: (r.width, r.height) for r in selection.plan_terms(openings, finishes, pieces).collect()}
    assert got == {1: (5.0, 10.0), 2: (None, None)}
    assert {r.width for r in selection.plan_terms(openings, finishes, pieces.select("key", "description", "quantity")).collect()} == {None}


def test_millimetres_against_inches(spark):
    rows = spark.createDataFrame([("broca 25 mm", 'broca 1"'), ("broca 25 mm", 'broca 2"'), ('broca 1/2"', "broca 13 mm"), ("broca 25 mm", "broca 25 mm"), ("broca", 'broca 1"')], "a string, b string")
    rows = rows.select(specs.all_specs(F.col("a")).alias("a"), specs.all_specs(F.col("b")).alias("b"))
    assert [r[0] for r in rows.select(specs.crossed_diameters(F.col("a"), F.col("b"))).collect()] == ["agree", "conflict", "agree", None, None]




def test_sale_units(spark):
    rows = [("pintura 1/4 galon", "Pinturas"), ("pintura", "Pinturas"), ("sellador 500 ml", "x"), ("cemento 25 kg", "x"), ("clavo 2,5 lb", "x"), ("piso 1.44 m2", "x"), ("taladro", "x"), (None, None)]
    got = spark.createDataFrame(rows, "name string, category string").select(specs.sale_unit(F.col("name"), F.col("category"))).collect()
    assert [r[0] for r in got] == ["Cuarto", None, "0.5 L", "25 kg", "2.5 lb", "1.44 m²", None, None]


def test_sizes_fit_within_a_fifth_either_way_round(spark):
    rows = [("puerta 90 x 210 cm", False), ("puerta 210x90 cm", False), ("puerta 0.9 x 2.1 m", False), ("puerta 100 x 200", False), ("puerta 60 x 210 cm", True), ("puerta", None), ("lamina 900 x 2100 mm", False), ('puerta 36 x 84 "', False)]
    got = spark.createDataFrame(rows, "name string, want boolean").select("want", specs.sizes_conflict(F.col("name"), F.lit(90.0), F.lit(210.0)).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert spark.range(1).select(specs.sizes_conflict(F.lit("puerta 90 x 210"), F.lit(None).cast("double"), F.lit(1.0))).first()[0] is None


def test_numbers_in_long_texts_are_found_near_numbers_alone(spark):
    """The same numbers, units and sizes as in the whole text, from a small part of it."""
    rng = random.Random(11)
    odd = ["5", "3/4", "1", "1/2", "-", "- -", "--", "/", "x", "#", "a#", "sch", "Sch", "barsch", "sÇh", "śch", "́", "mm", "MM", "m", "m2", "m²", "cm", "kg", "lb", "libras", "galón", "l", "ml", "hp", "btu", "awg", "°", "°c", '"', "pulgadas", "v", "vac", "w", "12.5mm", "2,5", "1.200", "40a", "90x210", "1-1/2", "|", "und", "auch,", "ñandú", " ", "İ", "K"]
    joins = [" ", " ", " ", " ", "", "\n", "  ", "\t \r\n"]
    short = ["".join(x + rng.choice(joins) for x in rng.choices(odd, k=rng.randint(1, 16))) for _ in range(3000)]
    prose = " ".join(rng.choices(["und", "the", "auch", "perfil", "casa"], k=200_000))
    rows = spark.createDataFrame([(t,) for t in [*short, f"{prose} 5 mm {prose} sch 40 {prose} 2 x 3 cm", "", None]], "text string")
    rows = rows.repartition(8).select("text", specs.near_numbers(F.col("text")).alias("near"))
    read = lambda c: F.struct(specs.all_specs(F.col(c)), specs.sale_unit(F.col(c), F.lit("")), specs.size_pairs(F.col(c)))
    got = rows.select("text", "near", read("text").alias("a"), read("near").alias("b")).collect()
    assert [r.text for r in got if r.a != r.b] == []
    assert len({str(r.a) for r in got}) > 500
    assert max(len(r.near or "") for r in got) < 200
