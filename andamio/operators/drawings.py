"""Floor plans from their text blocks: sheets, schedules, levels, references.

PDF bytes are read elsewhere; the input is words and lines with their places on a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How plans write codes, levels, openings, pieces, call-outs, dates, scales and labels.
SHEET_CODE = r"^([A-Z]{1,3}-?\d{1,3}(?:\.\d{1,2})?)$"
OPENING_CODE = r"^([PV]-?\d{1,2}[A-Z]?)$"
LEVEL = r"(?i)N\s+([+-]?\d+(?:\.\d+)?)\s*M\b"
SECTION_CALL, DETAIL_CALL = r"^([A-H])\n(A\d{3})$", r"^DETALLE\n(\d+)\n([AS]\d{3})$"
DATE, SCALE, COLOUR = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"(?i)ESCALA\s*:?\s*1\s*:\s*\d+", r"(?i)COLOR\s+([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ ]{2,30})"
PROJECT_LABEL, FIRST_PAGES = r"(?i)^PROYECTO\s*:\s*$", 3
LABELS = ("PROYECTO", "PROPIETARIO", "UBICACION", "UBICACIÓN", "FECHA", "PÁGINA", "PAGINA", "DP", "IP", "ESCALA", "LAMINA", "LÁMINA", "CONTENIDO", "CONTENIDO DE LAMINA", "CITAS", "CATASTRO")
SPACES_TITLE, LONGEST_SPACE = "PLANTA DE DISTRIBUCION ARQUITECTONICA", 40
NO_SPACE = (
    "NPT", "NCT", "DETALLE", "JARDINERA", "BARANDA", "PROYECCION", "SISA", "MACETERA", "REJILLA", "ACCESO EN", "PIEL EN", "BANCA", "CENEFA", "FECHA", "CONTENIDO", "INFORMACION", "PROPIETARIO",
    "CATASTRO", "CITAS", "VISTAS DE DESCANSO", "PLANO ORIGINAL", "TABLA", "ESCALA", "ACOTADO", "BAÑO", "REGLAMENTO", "N° PROYECTO",
)
HOLE = r"(?i)buque\s+de\s+(\d+[.,]\d+)\s*m?\s*x\s*(\d+[.,]\d+)"
PIECE = r"(?i)^\s*(\d+)\s+(.*?)\s*(\d+)\s*x\s*(\d+)\s*mm\s*x\s*(\d+(?:[.,]\d+)?)\s*m\b"
DISCIPLINES = (("electrica", ("ELECTRIC", "ELÉCTRIC")), ("mecanica", ("MECANIC", "MECÁNIC", "SANITARI", "AGUAS")), ("estructural", ("ESTRUCTUR", "CIMIENTO", "FUNDACI")), ("arquitectonica", ("ARQUITECT", "PLANTA", "FACHADA", "ACABADO", "CORTE")))
BIG_GAP, ROW_MARGIN = 250.0, 3.0
FINISHES = {"TABLA DE ACABADOS DE MUROS Y PAREDES": "muros_y_paredes", "TABLA DE ACABADOS DE PISOS": "pisos", "TABLA DE ACABADOS DE CIELOS": "cielos"}
FINISH_HEADERS, FINISH_CODE = ("CODIGO", "ACABADO", "MARCA", "MODELO", "ESPECIFICACIONES", "DISTRIBUIDOR", "OBSERVACIONES"), r"^([A-Z]?\d{1,2})$"
LEGAL_WORDS = ("REGLAMENTO", "PROPIEDAD INTELECTUAL", "CONSENTIMIENTO", "REPRODUCCION", "C.F.I.A")
#: Where tables stand and how far words may be off their column: share of the width, heights of the header's band, margins.
TABLE_SIDE, HEADER_BAND, CODE_MARGIN, LEFT_MARGIN, RIGHT_MARGIN, LAST_ROW = 0.5, (1.0, 45.0), 10.0, 35.0, 5.0, 1.5
LEAST_TEXT, FEW_DRAWINGS, MANY_DRAWINGS = 20, 5, 1000


def page_kind(text: Column, drawings: Column, images: Column) -> Column:
    """What a page is made of: text, vectors, an image, or nothing."""
    has_text = F.length(F.trim(text)) >= LEAST_TEXT
    return F.when(has_text & (drawings >= FEW_DRAWINGS), "vector").when(has_text, "text").when(drawings >= MANY_DRAWINGS, "outlines").when(images > 0, "scan").otherwise("empty")


def discipline(text: Column) -> Column:
    upper = F.upper(text)
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, (F.contains(upper, F.lit(w)) for w in stock)), F.lit(name)) for name, stock in DISCIPLINES))


def title_block(text: Column) -> Column:
    """Code and name of a sheet: the last line that is a code, then the first line behind it
    of four letters at least that is no number."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    places = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(SHEET_CODE))
    at = F.array_max(places)
    rest = F.filter(F.slice(lines, F.coalesce(at, F.lit(0)) + 1, F.size(lines)), lambda x: (F.length(x) >= 4) & ~x.rlike(r"^[\d.,:/ -]+$"))
    return F.struct(F.try_element_at(lines, at).alias("code"), F.when(at.isNotNull(), F.try_element_at(rest, F.lit(1))).alias("name"))


def sheets(pages: DataFrame) -> DataFrame:
    """One row per page (project_id, page, text, drawings, images): kind, code, name, discipline."""
    block = title_block(F.col("text"))
    rows = pages.withColumn("block", block)
    return rows.select("project_id", "page", page_kind(F.col("text"), F.col("drawings"), F.col("images")).alias("kind"), "block.code", "block.name", discipline(F.concat_ws(" ", "block.name", "text")).alias("discipline"))


def against_index(found: DataFrame, index: DataFrame) -> DataFrame:
    """Sheets with their entry of the index (project_id, code, title): the entry names what has no name."""
    rows = found.join(index.withColumnRenamed("title", "listed"), ["project_id", "code"], "left")
    warning = F.when(F.col("name").isNotNull() & F.col("listed").isNotNull() & (F.upper("name") != F.upper("listed")), "name differs from the index")
    return rows.withColumn("warning", warning).withColumn("name", F.coalesce("name", "listed"))


def missing_sheets(found: DataFrame, index: DataFrame) -> DataFrame:
    return index.join(found, ["project_id", "code"], "left_anti")


def project_discipline(found: DataFrame) -> DataFrame:
    kinds = F.collect_set("discipline")
    return found.groupBy("project_id").agg(F.when(F.size(kinds) == 0, "sin_determinar").when(F.size(kinds) == 1, kinds[0]).otherwise("mixto").alias("discipline"), F.count(F.lit(1)).alias("sheets"))


def sheet_summary(found: DataFrame) -> DataFrame:
    """Sheets of each project and discipline, and how many of them have no code and no name."""
    missing = lambda c: F.count(F.when(F.col(c).isNull(), 1)).alias(f"without_{c}")
    return found.groupBy("project_id", F.coalesce("discipline", F.lit("sin_determinar")).alias("discipline")).agg(F.count(F.lit(1)).alias("sheets"), missing("code"), missing("name"))


def levels(found: DataFrame) -> DataFrame:
    """project_id, name, elevation, sheets: the levels that sheets' names state, with the codes of
    their sheets in order. Sheets without a name, or whose name states no level, are left out."""
    height = F.nullif(F.regexp_extract("name", LEVEL, 1), F.lit(""))
    rows = found.select("project_id", "code", height.alias("height")).filter("height IS NOT NULL")
    named = F.concat(F.lit("N "), F.col("height"), F.lit(" M"))
    return rows.groupBy("project_id", named.alias("name"), F.col("height").cast("double").alias("elevation")).agg(F.sort_array(F.collect_list("code")).alias("sheets"))


def level_of_sheets(levels_: DataFrame) -> DataFrame:
    """project_id, code, level: the lowest level that a sheet's code is listed for."""
    rows = levels_.select("project_id", "name", "elevation", F.explode("sheets").alias("code"))
    return rows.groupBy("project_id", "code").agg(F.min_by("name", F.struct("elevation", "name")).alias("level"))


def title_fields(text: Column) -> Column:
    """Date and scale of a title block and the colour that a note states; null where there is none."""
    found = lambda pattern, group: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return F.struct(found(DATE, 0).alias("date"), found(SCALE, 0).alias("scale"), F.trim(found(COLOUR, 1)).alias("colour"))


def project_names(pages: DataFrame) -> DataFrame:
    """project_id, name: the line behind the project's label on one of its first pages, the first
    that is not blank and no label itself."""
    order = Window.partitionBy("project_id").orderBy("page")
    first = pages.select("project_id", "page", "text").distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= FIRST_PAGES)
    lines = first.select("project_id", "nth", F.transform(F.split("text", "\n"), lambda x: F.trim(x)).alias("lines"))
    label = lambda x: F.upper(F.regexp_replace(x, ":+$", "")).isin(*LABELS)
    at = F.filter(F.sequence(F.lit(0), F.size("lines") - 2), lambda i: F.get("lines", i).rlike(PROJECT_LABEL) & (F.get("lines", i + 1) != "") & ~label(F.get("lines", i + 1)))
    rows = lines.filter(F.size("lines") > 1).withColumn("at", F.get(at, F.lit(0))).filter("at IS NOT NULL")
    return rows.groupBy("project_id").agg(F.min_by(F.get("lines", F.col("at") + 1), "nth").alias("name"))


def call_outs(blocks: DataFrame) -> DataFrame:
    """project_id, page, kind, mark, target: the sections and details that blocks of text
    (project_id, page, text) refer to, each once a page."""
    body = F.trim("text")
    part = lambda pattern, i: F.regexp_extract(body, pattern, i)
    kind = F.when(body.rlike(SECTION_CALL), "seccion").when(body.rlike(DETAIL_CALL), "detalle")
    rows = blocks.select("project_id", "page", kind.alias("kind"), F.when(kind == "seccion", part(SECTION_CALL, 1)).otherwise(part(DETAIL_CALL, 1)).alias("mark"), F.when(kind == "seccion", part(SECTION_CALL, 2)).otherwise(part(DETAIL_CALL, 2)).alias("target"))
    return rows.filter("kind IS NOT NULL").distinct()


def spaces(blocks: DataFrame) -> DataFrame:
    """project_id, page, name, original: names of rooms on distribution sheets, each once a page.

    Blocks have x0, y0, text and the page's width and height. A distribution sheet has its
    title in the lower right; names stand left of the legend, without digits, and
    are none of NO_SPACE.
    """
    one_line = F.trim(F.regexp_replace("text", r"\s+", " "))
    titles = blocks.filter((F.col("x0") >= F.col("width") * 0.5) & (F.col("y0") >= F.col("height") * 0.85) & F.contains(F.upper(one_line), F.lit(SPACES_TITLE)))
    upper = F.upper(F.trim("text"))
    name = ~F.trim("text").rlike(r"\d") & (F.length(F.trim("text")) >= 3) & ~reduce(lambda a, b: a | b, (F.contains(upper, F.lit(w)) for w in NO_SPACE))
    kept = blocks.join(titles.select("project_id", "page").distinct(), ["project_id", "page"], "left_semi").filter(F.col("x0") < F.col("width") * 0.62).filter(name)
    rows = kept.withColumn("one_line", one_line).filter(~F.col("one_line").rlike(r"^[A-Z](\s+[A-Z])+$") & (F.length("one_line") <= LONGEST_SPACE))
    return rows.groupBy("project_id", "page", F.regexp_replace(F.trim("text"), "\n", " ").alias("name")).agg(F.min_by("one_line", F.struct("y0", "x0", "one_line")).alias("original"))


def building(found: DataFrame, blocks: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The building model: levels; spaces with the level of their sheet; references with whether
    their target is in the index (true for projects without an index)."""
    levels_ = levels(found)
    codes = found.select("project_id", "page", "code")
    rooms = spaces(blocks).join(codes, ["project_id", "page"], "left").join(level_of_sheets(levels_), ["project_id", "code"], "left")
    calls = call_outs(blocks).join(codes.withColumnRenamed("code", "source"), ["project_id", "page"], "left")
    return levels_, rooms.select("project_id", "page", "name", "original", "level"), references(index, calls)


def references(found: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls (project_id, page, target) and whether their target is a sheet; true where there is no index."""
    known = found.filter("code IS NOT NULL").select("project_id", F.col("code").alias("target"), F.lit(True).alias("there")).distinct()
    indexed = known.select("project_id").distinct().withColumn("indexed", F.lit(True))
    rows = calls.join(known, ["project_id", "target"], "left").join(indexed, "project_id", "left")
    return rows.withColumn("exists", F.coalesce("there", F.col("indexed").isNull())).drop("there", "indexed")


def relevant_pages(found: DataFrame, *sources: DataFrame) -> DataFrame:
    """The sheets that some source (project_id, page) refers to."""
    wanted = reduce(DataFrame.unionByName, (s.select("project_id", "page") for s in sources)).distinct()
    return found.join(wanted, ["project_id", "page"], "left_semi")


# -- schedules -------------------------------------------------------------------------------


def schedule_rows(words: DataFrame) -> DataFrame:
    """The rows of each page's opening schedule: code, top, bottom.

    A row begins at its code and ends above the next; codes behind a gap of more than
    BIG_GAP are of something else. Codes at one place are in the order of their text.
    """
    down = Window.partitionBy("project_id", "page").orderBy("y0", "x0", "text")
    codes = words.filter(F.col("text").rlike(OPENING_CODE)).withColumn("gap", F.col("y0") - F.lag("y0").over(down))
    broken = F.max(F.coalesce(F.col("gap") > BIG_GAP, F.lit(False))).over(down.rowsBetween(Window.unboundedPreceding, 0))
    kept = codes.withColumn("broken", broken).filter("NOT broken").drop("broken", "gap")
    nxt = F.lead("y0").over(down)
    return kept.select("project_id", "page", F.col("text").alias("code"), (F.col("y0") - ROW_MARGIN).alias("top"), (nxt - ROW_MARGIN).alias("bottom"))


def median_gap(rows: DataFrame) -> DataFrame:
    """The upper median of a page's row heights."""
    gaps = F.array_sort(F.collect_list(F.col("bottom") - F.col("top")))
    return rows.filter("bottom IS NOT NULL").groupBy("project_id", "page").agg(F.element_at(gaps, (F.floor(F.size(gaps) / 2) + 1).cast("int")).alias("gap"))


def cells(words: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The text of each row and column (project_id, page, column, left, right) of the schedules.

    The last row is as high as the median one. The page joins words to rows and
    columns; their bands are conditions on top of this equality.
    """
    high = rows.join(median_gap(rows), ["project_id", "page"], "left").withColumn("bottom", F.coalesce("bottom", F.col("top") + F.coalesce("gap", F.lit(20.0))))
    inside = words.join(high, ["project_id", "page"]).filter("y0 >= top AND y0 < bottom").join(columns, ["project_id", "page"]).filter("x0 >= left AND x0 < right")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda w: w["text"])
    return inside.groupBy("project_id", "page", "code", "column").agg(F.array_join(in_order, " ").alias("value"))


# -- tables found by their titles and headers ------------------------------------------------------


def _bound(value: Column, then) -> Column:
    """``then(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def table_titles(words: Column, titles: dict[str, str] = FINISHES) -> Column:
    """place, top, bottom: the first line of a page's words that holds a title of each place.

    A line is the words of one height from left to right. Only lines with a title's first word
    are put together.
    """
    begun = F.array_distinct(F.transform(F.filter(words, lambda w: F.upper(w["text"]).isin(*{t.split()[0] for t in titles})), lambda w: w["y0"]))
    line = lambda ws: F.struct(F.upper(F.array_join(F.transform(ws, lambda w: w["text"]), " ")).alias("line"), F.array_min(F.transform(ws, lambda w: w["y0"])).alias("top"), F.array_max(F.transform(ws, lambda w: w["y1"])).alias("bottom"))
    lines = F.transform(begun, lambda y: _bound(F.filter(words, lambda w: w["y0"] == y), line))
    holds = lambda x, place: reduce(lambda a, b: a | b, (F.contains(x["line"], F.lit(t)) for t, of in titles.items() if of == place))

    def first(found: Column, place: str) -> Column:
        return _bound(F.get(F.filter(found, lambda x: holds(x, place)), F.lit(0)), lambda x: F.when(x.isNotNull(), F.struct(F.lit(place).alias("place"), x["top"].alias("top"), x["bottom"].alias("bottom"))))

    return F.when(F.size(begun) > 0, _bound(lines, lambda found: F.array_compact(F.array(*(first(found, place) for place in dict.fromkeys(titles.values()))))))


def table_columns(words: Column, title: Column, headers: tuple[str, ...] = FINISH_HEADERS) -> Column:
    """left, column, header_bottom, right: the columns of a title's table from left to right; null for no table.

    Headers stand in a band below the title. A column reaches from its header to the next one, the
    last to the edge of the page. Tables whose first column is not the first of ``headers`` are none.
    """
    band = lambda w: w["y0"].between(title["bottom"] + HEADER_BAND[0], title["bottom"] + HEADER_BAND[1]) & (w["x0"] >= w["width"] * TABLE_SIDE) & F.upper(w["text"]).isin(*headers)
    head = lambda w: F.struct(w["x0"].alias("left"), F.upper(w["text"]).alias("column"), w["y1"].alias("header_bottom"), w["width"].alias("right"))
    # The page's words are in order, so the first of each name is the highest, then the leftmost.
    first = lambda met: F.sort_array(F.filter(met, lambda h, i: F.array_position(F.transform(met, lambda x: x["column"]), h["column"]) == i + 1))
    reach = lambda cols: F.transform(cols, lambda c, i: c.withField("right", F.coalesce(F.get(cols, i + 1)["left"], c["right"])))
    found = _bound(_bound(F.transform(F.filter(words, band), head), first), reach)
    return _bound(found, lambda cols: F.when(F.get(cols, F.lit(0))["column"] == headers[0], cols))


def table_rows(words: Column, columns: Column) -> Column:
    """code, top, bottom of each row: from its code in the first column to the next.

    Codes behind the first gap of more than BIG_GAP are of something else. The last row is
    LAST_ROW times as high as the upper median of the others, and ends at the page's edge.
    """
    key = F.get(columns, F.lit(0))
    inside = lambda w: (w["x0"] >= key["left"] - CODE_MARGIN) & (w["x0"] < key["right"] - RIGHT_MARGIN) & (w["y1"] >= key["header_bottom"]) & (w["y0"] >= key["header_bottom"]) & w["text"].rlike(FINISH_CODE)
    codes = F.sort_array(F.transform(F.filter(words, inside), lambda w: F.struct(w["y0"].alias("y0"), w["text"].alias("code"), w["height"].alias("height"))))

    def unbroken(found: Column) -> Column:
        far = F.filter(F.sequence(F.lit(1), F.greatest(F.size(found) - 1, F.lit(1))), lambda i: F.get(found, i)["y0"] - F.get(found, i - 1)["y0"] > BIG_GAP)
        return F.slice(found, F.lit(1), F.coalesce(F.get(far, F.lit(0)), F.size(found)))

    def rows(kept: Column) -> Column:
        gaps = F.sort_array(F.filter(F.transform(kept, lambda c, i: F.get(kept, i + 1)["y0"] - c["y0"]), lambda g: g.isNotNull()))
        typical = lambda g: F.coalesce(F.get(g, F.floor(F.size(g) / 2).cast("int")), F.lit(BIG_GAP))
        last = lambda c: F.least(c["y0"] + _bound(gaps, typical) * LAST_ROW, c["height"])
        return F.transform(kept, lambda c, i: F.struct(c["code"].alias("code"), (c["y0"] - ROW_MARGIN).alias("top"), F.coalesce(F.get(kept, i + 1)["y0"] - ROW_MARGIN, last(c)).alias("bottom")))

    return _bound(_bound(codes, unbroken), rows)


def table_cells(words: Column, columns: Column, rows: Column) -> Column:
    """code, top, text (all words of the row) and cells (column, text of each word) of each row that has words.

    A word is of the first column whose band it stands in; a band begins LEFT_MARGIN before its
    header, so words set to the left of it are not lost.
    """
    key = F.get(columns, F.lit(0))
    below = F.filter(words, lambda w: (w["y0"] >= key["header_bottom"]) & (w["x0"] >= w["width"] * TABLE_SIDE))
    in_code = lambda w: (w["x0"] >= key["left"] - CODE_MARGIN) & (w["x0"] < key["right"] - RIGHT_MARGIN)
    band = lambda w: F.get(F.filter(columns, lambda c, i: (i > 0) & (w["x0"] >= c["left"] - LEFT_MARGIN) & (w["x0"] < c["right"] - RIGHT_MARGIN)), F.lit(0))["column"]
    placed = F.transform(below, lambda w: F.struct(w["y0"].alias("y0"), w["text"].alias("text"), F.when(~in_code(w), band(w)).alias("column")))
    row = lambda r, ws: F.struct(r["code"].alias("code"), r["top"].alias("top"), F.array_join(F.transform(ws, lambda w: w["text"]), " ").alias("text"), ws.alias("cells"))
    every = lambda ps: F.transform(rows, lambda r: _bound(F.filter(ps, lambda w: (w["y0"] >= r["top"]) & (w["y0"] < r["bottom"])), lambda ws: F.when(F.size(ws) > 0, row(r, ws))))
    return F.when(F.size(rows) > 0, F.array_compact(_bound(placed, every)))


def finishes(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The finishes of each page's tables, and warnings (project_id, page, place, warning).

    ``words`` has project_id, page, text, x0, y0, x1, y1, width and height (of the page). Title, header,
    columns and rows are found by their places. Rows that are a plan's legal text are left
    out with a warning, and so is a title without rows. Empty cells are null. Words are
    brought together by page once; a page's words are few, so all else is worked out in its row.
    """
    page, keys = ["project_id", "page"], ["project_id", "page", "place"]
    pages = words.repartition(*page).groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "text", "y1", "width", "height"))).alias("words"))
    titled = pages.filter(F.exists("words", lambda w: F.upper(w["text"]).isin(*{t.split()[0] for t in FINISHES}))).withColumn("title", F.explode_outer(table_titles(F.col("words")))).filter("title IS NOT NULL")
    read = lambda columns: F.when(columns.isNotNull(), _bound(table_rows(F.col("words"), columns), lambda rows: table_cells(F.col("words"), columns, rows)))
    tables = titled.select(*page, "title.place", _bound(table_columns(F.col("words"), F.col("title")), read).alias("rows"))
    legal = reduce(lambda a, b: a | b, (F.contains(F.upper("text"), F.lit(w)) for w in LEGAL_WORDS))
    # The outer form, as filters on what the plain one would give none for work the lists out again.
    found = tables.select(*keys, F.explode_outer("rows").alias("row")).filter("row IS NOT NULL").select(*keys, "row.*")
    cell = lambda c: F.nullif(F.trim(F.array_join(F.transform(F.filter("cells", lambda w: w["column"] == c), lambda w: w["text"]), " ")), F.lit(""))
    colour = F.nullif(F.initcap(F.trim(F.regexp_extract(F.coalesce(cell("ESPECIFICACIONES"), F.lit("")), COLOUR, 1))), F.lit(""))
    rows = found.filter(~legal).select(*keys, "code", cell("ACABADO").alias("description"), cell("MARCA").alias("brand"), cell("MODELO").alias("format"), colour.alias("colour"), "text", F.lit("media").alias("confidence"), "top")
    warning = lambda r: F.when(F.exists(F.array(r["text"]), lambda t: reduce(lambda a, b: a | b, (F.contains(F.upper(t), F.lit(w)) for w in LEGAL_WORDS))), F.concat(F.lit("row "), r["code"], F.lit(" is the legal text of the sheet")))
    told = F.when(F.coalesce(F.size("rows"), F.lit(0)) <= 0, F.array(F.lit("a title without rows"))).otherwise(F.array_compact(F.transform("rows", warning)))
    return rows, tables.select(*keys, F.explode_outer(told).alias("warning")).filter("warning IS NOT NULL")


def merged_finishes(rows: DataFrame) -> DataFrame:
    """One row for each project, place and code, as tables are repeated on sheets: the most confident, then the first; and whether others differ."""
    rank = F.when(F.col("confidence") == "alta", 0).when(F.col("confidence") == "media", 1).otherwise(2)
    kept = [c for c in rows.columns if c not in ("project_id", "place", "code")]
    best = rows.groupBy("project_id", "place", "code").agg(F.min_by(F.struct(*kept), F.struct(rank, "page", "top", "text")).alias("b"), (F.countDistinct("text") > 1).alias("disagree"))
    return best.select("project_id", "place", "code", "b.*", "disagree")


def nearest_names(codes: DataFrame, names: DataFrame) -> DataFrame:
    """code, name of each page: in order where there are as many names as codes, else each
    code takes the nearest name still free, nearest pairs first.

    A page's words are few, so the greedy choice is a fold over its sorted pairs.
    """
    page = ["project_id", "page"]
    placed = lambda df, word: df.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col("y0").alias("y"), word))).alias(f"{word}s"))
    rows = placed(codes, "code").join(placed(names, "name"), page)
    each = F.flatten(F.transform("codes", lambda a, i: F.transform("names", lambda b, j: F.struct(F.abs(a["y"] - b["y"]).alias("far"), i.alias("i"), j.alias("j")))))
    free = lambda got, p: ~F.exists(got, lambda g: (g["i"] == p["i"]) | (g["j"] == p["j"]))
    greedy = F.aggregate(F.array_sort(each), F.array().cast("array<struct<i:int,j:int>>"), lambda got, p: F.when(free(got, p), F.concat(got, F.array(F.struct(p["i"].alias("i"), p["j"].alias("j"))))).otherwise(got))
    in_order = F.transform("codes", lambda _, i: F.struct(i.alias("i"), i.alias("j")))
    rows = rows.withColumn("pair", F.explode(F.when(F.size("codes") == F.size("names"), in_order).otherwise(greedy)))
    return rows.select(*page, F.get("codes", F.col("pair.i"))["code"].alias("code"), F.get("names", F.col("pair.j"))["name"].alias("name"))


def best_readings(readings: DataFrame) -> DataFrame:
    """One reading per code: the most confident, the first of equals; and whether they disagree."""
    rank = F.when(F.col("confidence") == "alta", 0).when(F.col("confidence") == "media", 1).otherwise(2)
    return readings.groupBy("project_id", "code").agg(F.min_by("text", F.struct(rank, "seq")).alias("text"), (F.countDistinct("text") > 1).alias("disagree"))


def openings(text: Column) -> Column:
    """Width and height of an opening in metres from its description."""
    metres = lambda i: F.regexp_replace(F.nullif(F.regexp_extract(text, HOLE, i), F.lit("")), ",", ".").try_cast("double")
    return F.struct(metres(1).alias("width_m"), metres(2).alias("height_m"))


def pieces(lines: DataFrame) -> DataFrame:
    """Structural pieces (quantity, description, width, height, length) from lines of text (project_id, page, line)."""
    part = lambda i: F.regexp_extract("line", PIECE, i)
    n = lambda i: F.regexp_replace(part(i), ",", ".").try_cast("double")
    return lines.filter(F.col("line").rlike(PIECE)).select("project_id", "page", n(1).cast("int").alias("quantity"), F.trim(part(2)).alias("description"), n(3).alias("width_mm"), n(4).alias("height_mm"), n(5).alias("length_m"))


def without_repeated_tables(found: DataFrame) -> DataFrame:
    """Pages whose whole table equals an earlier page's are left out."""
    row = F.concat_ws("|", "quantity", "description", "width_mm", "height_mm", "length_m")
    tables = found.groupBy("project_id", "page").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("table"))
    first = tables.groupBy("project_id", "table").agg(F.min("page").alias("page"))
    return found.join(first.select("project_id", "page"), ["project_id", "page"], "left_semi")


def search_term(kind: str) -> Column:
    """What a material is searched by: openings by type and material, finishes by description, else by their text; pieces by description."""
    if kind == "openings":
        return F.coalesce(F.nullif(F.concat_ws(" ", F.nullif("type", F.lit("")), F.nullif("material", F.lit(""))), F.lit("")), F.col("text"))
    if kind == "finishes":
        return F.coalesce(F.nullif("description", F.lit("")), F.col("text"))
    return F.col("description")


def source_pages(found: DataFrame, levels_: DataFrame, *sources: DataFrame) -> DataFrame:
    """project_id, page: where levels have their sheets and anything that was read comes from.

    Of sheets with one code the last page has it; a code without a sheet gives none.
    """
    of_code = found.filter(F.coalesce("code", F.lit("")) != "").groupBy("project_id", "code").agg(F.max("page").alias("page"))
    pages = levels_.select("project_id", F.explode("sheets").alias("code")).join(of_code, ["project_id", "code"]).select("project_id", "page")
    for rows in sources:
        pages = pages.unionByName(rows.select("project_id", "page"))
    return pages.distinct()


def analysis(found: DataFrame, levels_: DataFrame, spaces_: DataFrame, openings_: DataFrame, finishes: DataFrame, pieces_: DataFrame, warnings: DataFrame, names: DataFrame) -> DataFrame:
    """A nested document for each project that has a sheet: what its plan says, and on which sheets.

    found: project_id, page, code, name, discipline, kind; levels: name, elevation, sheets;
    spaces: name, level, page, text; openings: kind (puerta, ventana), code, width, height, type,
    material, quantity, page, text, confidence; finishes: code, description, brand, format,
    colour, place, page, text, confidence; pieces: quantity, width_mm, height_mm, length_m,
    description, page, text, confidence; warnings: source (in the order of the readers), seq,
    warning; names: name. Only sheets that something comes from are in it. Lists are by page,
    then by the rest of the row; what a project lacks is an empty list. A document is as large as a plan.
    """
    used = found.join(source_pages(found, levels_, spaces_, openings_, finishes, pieces_), ["project_id", "page"], "left_semi")
    opening = ("page", "code", "width", "height", "type", "material", "quantity", "text", "confidence", search_term("openings").alias("search_term"))
    of_kind = lambda kind: openings_.filter(F.col("kind") == kind)
    parts = {
        "levels": (levels_, ("elevation", "name", "sheets")), "spaces": (spaces_, ("page", "name", "level", "text")), "doors": (of_kind("puerta"), opening), "windows": (of_kind("ventana"), opening),
        "finishes": (finishes, ("page", "code", "description", "brand", "format", "colour", "place", "text", "confidence", search_term("finishes").alias("search_term"))),
        "pieces": (pieces_, ("page", "quantity", "width_mm", "height_mm", "length_m", "description", "text", "confidence", search_term("pieces").alias("search_term"))),
        "sheets": (used, ("page", "code", "name", "discipline", "kind")), "warnings": (warnings, ("source", "seq", "warning")),
    }
    rows = found.groupBy("project_id").agg(F.count(F.lit(1)).alias("sheet_count")).join(names.select("project_id", F.col("name").alias("project_name")), "project_id", "left")
    for name, (df, columns) in parts.items():
        listed = df.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        empty = F.array().cast(listed.schema[name].dataType)
        rows = rows.join(listed, "project_id", "left").withColumn(name, F.coalesce(name, empty))
    return rows.withColumn("warnings", F.transform("warnings", lambda w: w["warning"]))
