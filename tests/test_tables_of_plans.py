"""Tables of finishes from words on a page."""

from andamio.operators import drawings

WORD = "project_id long, page int, text string, x0 double, y0 double, x1 double, y1 double, width double, height double"


def page(spark, *words, number=1):
    return spark.createDataFrame([(1, number, t, float(x), float(y), x + 20.0, y + 10.0, 1000.0, 800.0) for t, x, y in words], WORD)


TITLE = [(w, 600 + 40 * i, 100) for i, w in enumerate("TABLA DE ACABADOS DE PISOS".split())]
HEAD = [("CODIGO", 520, 120), ("ACABADO", 600, 120), ("MARCA", 700, 121), ("MODELO", 800, 120)]


def rows_of(spark, *words):
    rows, warnings = drawings.finishes(page(spark, *words))
    return {r.code: r for r in rows.collect()}, sorted(r.warning for r in warnings.collect())


def test_columns_and_rows_are_found(spark):
    words = [*TITLE, *HEAD, ("F1", 522, 150), ("porcelanato", 598, 150), ("gris", 610, 162), ("Acme", 702, 150), ("60x60", 801, 151), ("F2", 522, 190), ("lejos", 596, 191), ("left", 100, 150)]
    rows, warnings = rows_of(spark, *words)
    assert (rows["F1"].description, rows["F1"].brand, rows["F1"].format, rows["F1"].place) == ("porcelanato gris", "Acme", "60x60", "pisos")
    # A little to the left of its header is its column; the row's words are all there.
    assert rows["F2"].description == "lejos" and rows["F2"].text == "F2 lejos" and rows["F2"].brand is None and not warnings


def test_a_gap_ends_the_table_and_legal_text_is_no_row(spark):
    words = [*TITLE, *HEAD, ("F1", 522, 150), ("madera", 600, 150), ("F2", 522, 190), ("F3", 522, 460), ("F4", 522, 711), ("8", 522, 210), ("REGLAMENTO", 600, 211)]
    rows, warnings = rows_of(spark, *words)
    assert set(rows) == {"F1", "F2", "F3"}  # 250 from the code before is not more than BIG_GAP
    assert warnings == ["row 8 is the legal text of the sheet"]


def test_tables_without_codes_or_headers(spark):
    assert rows_of(spark, *TITLE)[1] == ["a title without rows"]
    assert rows_of(spark, *TITLE, *HEAD[1:], ("F1", 522, 150))[1] == ["a title without rows"]
    assert rows_of(spark, *TITLE, *HEAD, ("word", 522, 150))[1] == ["a title without rows"]
    assert rows_of(spark, *HEAD, ("F1", 522, 150)) == ({}, [])
    none = page(spark)
    assert drawings.finishes(none)[0].collect() == [] and drawings.finishes(none)[1].collect() == []


def test_repeated_tables_are_merged(spark):
    one = [*TITLE, *HEAD, ("F1", 522, 150), ("madera", 600, 150)]
    other = [*TITLE, *HEAD, ("F1", 522, 150), ("piedra", 600, 150), ("F2", 522, 190)]
    words = page(spark, *other, number=2).unionByName(page(spark, *one))
    merged = {r.code: (r.description, r.page, r.disagree) for r in drawings.merged_finishes(drawings.finishes(words)[0]).collect()}
    assert merged == {"F1": ("madera", 1, True), "F2": (None, 2, False)}


def test_the_analysis_is_nested_and_complete(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = make([(1, 1, "A1", "n", "d", "text"), (1, 2, "A2", "n", "d", "text"), (1, 3, "A1", "n", "d", "text"), (1, 4, None, "n", "d", "text"), (2, 1, "A1", "n", "d", "text")], "project_id long, page int, code string, name string, discipline string, kind string")
    levels = make([(1, "N1", 0.5, ["A1", "A9"])], "project_id long, name string, elevation double, sheets array<string>")
    spaces = make([(1, "SALA", None, 2, "sala")], "project_id long, name string, level string, page int, text string")
    openings = make([(1, "puerta", "P1", 0.9, 2.1, "fija", None, 2, 2, "t", "alta"), (1, "ventana", "V1", None, None, None, None, None, 2, "como dice", "baja")], "project_id long, kind string, code string, width double, height double, type string, material string, quantity int, page int, text string, confidence string")
    finishes = make([], "project_id long, code string, description string, brand string, format string, colour string, place string, page int, text string, confidence string")
    pieces = make([], "project_id long, quantity int, width_mm double, height_mm double, length_m double, description string, page int, text string, confidence string")
    warnings = make([(1, 2, 1, "late"), (1, 0, 5, "first")], "project_id long, source int, seq int, warning string")
    out = {r.project_id: r for r in drawings.analysis(found, levels, spaces, openings, finishes, pieces, warnings, make([(1, "Casa")], "project_id long, name string")).collect()}
    one, two = out[1], out[2]
    assert (one.sheet_count, one.project_name, [s.page for s in one.sheets], one.warnings) == (4, "Casa", [2, 3], ["first", "late"])
    assert [d.search_term for d in one.doors] == ["fija"] and [w.search_term for w in one.windows] == ["como dice"] and one.levels[0].sheets == ["A1", "A9"]
    assert (two.sheet_count, two.project_name, two.sheets, two.doors, two.warnings) == (1, None, [], [], [])
