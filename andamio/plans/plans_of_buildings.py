"""Queries of plan reading: sheets, levels, call-outs, rooms and title blocks from text.

Every supplier is a sheet; its text is put together from its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from andamio.operators import drawings
from andamio.sources import domain

from .queries import query

_LINES = """SELECT s_suppkey % 5 AS project_id, s_suppkey::INTEGER AS page, s_nationkey, s_acctbal, s_suppkey,
  'PROYECTO:' || chr(10) || CASE WHEN s_nationkey < 8 THEN 'Ubicación:' WHEN s_nationkey < 12 THEN '' ELSE 'Casa ' || s_name END || chr(10) || 'ESCALA: 1:' || (s_nationkey + 1) * 25 || chr(10) || 'A-' || s_nationkey || chr(10) || '12345 - 6' || chr(10)
  || CASE WHEN s_acctbal > 5000 THEN 'PLANTA ELECTRICA N +' || (s_suppkey % 4) || '.50 M' WHEN s_acctbal > 1000 THEN 'CORTE ESTRUCTURAL N -0.' || (s_suppkey % 3) || ' M' WHEN s_acctbal > 0 THEN 'FACHADA COLOR AZUL MARINO' ELSE 'abc' END || chr(10) || '7/' || (s_nationkey % 12 + 1) || '/2024' AS text FROM supplier"""
_LINE = r"list_transform(str_split(text, chr(10)), lambda x : trim(x))"
_CODE = rf"list_filter({_LINE}, lambda x : regexp_full_match(x, '[A-Z]{{1,3}}-?\d{{1,3}}(\.\d{{1,2}})?'))[-1]"
_SHEETS = f"""WITH pages AS ({_LINES}), coded AS (SELECT *, {_CODE} AS code FROM pages),
behind AS (SELECT *, list_filter(({_LINE})[list_position({_LINE}, code) + 1:], lambda x : length(x) >= 4 AND NOT regexp_full_match(x, '[\\d.,:/ -]+'))[1] AS name FROM coded),
found AS (SELECT project_id, page, code, name, CASE WHEN contains(upper(coalesce(name, '') || ' ' || text), 'ELECTRIC') THEN 'electrica' WHEN contains(text, 'ESTRUCTUR') THEN 'estructural' WHEN contains(text, 'PLANTA') OR contains(text, 'FACHADA') OR contains(text, 'CORTE') THEN 'arquitectonica' END AS discipline,
  regexp_extract(name, 'N\\s+([+-]?\\d+(\\.\\d+)?)\\s*M\\b', 1) AS height FROM behind)"""


def pages(s: SparkSession, d: str) -> DataFrame:
    n, k, b = F.col("s_nationkey"), F.col("s_suppkey"), F.col("s_acctbal")
    show = lambda c: c.cast("string")
    name = F.when(n < 8, "Ubicación:").when(n < 12, "").otherwise(F.concat(F.lit("Casa "), "s_name"))
    title = F.when(b > 5000, F.concat(F.lit("PLANTA ELECTRICA N +"), show(k % 4), F.lit(".50 M"))).when(b > 1000, F.concat(F.lit("CORTE ESTRUCTURAL N -0."), show(k % 3), F.lit(" M"))).when(b > 0, "FACHADA COLOR AZUL MARINO").otherwise("abc")
    text = F.concat_ws("\n", F.lit("PROYECTO:"), name, F.concat(F.lit("ESCALA: 1:"), show((n + 1) * 25)), F.concat(F.lit("A-"), show(n)), F.lit("12345 - 6"), title, F.concat(F.lit("7/"), show(n % 12 + 1), F.lit("/2024")))
    return domain.table(s, d, "supplier").select((k % 5).alias("project_id"), k.cast("int").alias("page"), text.alias("text"), n.alias("drawings"), F.lit(0).alias("images"))


def _sheets(s, d) -> DataFrame:
    return drawings.sheets(pages(s, d))


@query("plan_sheets", _SHEETS + " SELECT f.project_id, f.page, f.code, f.name, f.discipline, CASE WHEN p.s_nationkey >= 5 THEN 'vector' ELSE 'text' END AS kind FROM found f JOIN pages p ON f.page = p.page")
def _(s, d):
    return _sheets(s, d)


@query("sheet_summary", _SHEETS + " SELECT project_id, coalesce(discipline, 'sin_determinar') AS discipline, count(*) AS sheets, count(*) - count(code) AS without_code, count(*) - count(name) AS without_name FROM found GROUP BY ALL")
def _(s, d):
    return drawings.sheet_summary(_sheets(s, d))


_LEVELS = _SHEETS + ", levels AS (SELECT project_id, 'N ' || height || ' M' AS name, height::DOUBLE + 0 AS elevation, list_sort(list(code)) AS codes FROM found WHERE height <> '' GROUP BY ALL)"


@query("plan_levels", _LEVELS + " SELECT project_id, name, elevation, array_to_string(codes, ' ') AS sheets FROM levels")
def _(s, d):
    return drawings.levels(_sheets(s, d)).withColumn("sheets", F.array_join("sheets", " "))


@query("levels_of_sheets", _LEVELS + " SELECT project_id, code, name AS level FROM (SELECT *, row_number() OVER (PARTITION BY project_id, code ORDER BY elevation, name) AS n FROM (SELECT project_id, name, elevation, unnest(codes) AS code FROM levels)) WHERE n = 1")
def _(s, d):
    return drawings.level_of_sheets(drawings.levels(_sheets(s, d)))


@query("title_fields", f"WITH pages AS ({_LINES}) SELECT page, nullif(regexp_extract(text, '\\b\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}\\b'), '') AS date, nullif(regexp_extract(text, 'ESCALA\\s*:?\\s*1\\s*:\\s*\\d+'), '') AS scale, nullif(trim(regexp_extract(text, '(?i)COLOR\\s+([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ ]{{2,30}})', 1)), '') AS colour FROM pages")
def _(s, d):
    return pages(s, d).select("page", drawings.title_fields(F.col("text")).alias("f")).select("page", "f.*")


@query("project_names", f"""WITH pages AS ({_LINES}), first AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY page) AS n FROM pages)
SELECT project_id, min_by(({_LINE})[2], n) AS name FROM first WHERE n <= 3 AND s_nationkey >= 12 GROUP BY project_id""")
def _(s, d):
    return drawings.project_names(pages(s, d))


# -- blocks: rooms and call-outs -------------------------------------------------------------------

_BLOCK = """SELECT l_orderkey % 50 AS project_id, l_orderkey::INTEGER AS page, l_quantity * 2 AS x0, l_linenumber * 12.5 AS y0, 100.0 AS width, 100.0 AS height, l_suppkey,
  CASE WHEN l_linenumber = 1 THEN chr(65 + (l_suppkey % 10)::INTEGER) || chr(10) || 'A' || (100 + l_suppkey) WHEN l_linenumber = 2 THEN 'DETALLE' || chr(10) || l_suppkey || chr(10) || 'S' || (100 + l_suppkey % 30) WHEN l_linenumber = 3 THEN 'SALA DE' || chr(10) || 'ESTAR' WHEN l_linenumber = 4 THEN 'COCINA' WHEN l_linenumber = 5 THEN 'A B C'
    WHEN l_linenumber = 6 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'Jardinera norte' ELSE 'Patio' END ELSE 'Planta de distribucion' || chr(10) || 'arquitectonica' END AS text FROM lineitem"""


def blocks(s, d) -> DataFrame:
    n, k = F.col("l_linenumber"), F.col("l_suppkey")
    show = lambda c: c.cast("string")
    text = (
        F.when(n == 1, F.concat(F.char((F.lit(65) + k % 10).cast("int")), F.lit("\nA"), show(100 + k))).when(n == 2, F.concat(F.lit("DETALLE\n"), show(k), F.lit("\nS"), show(100 + k % 30)))
        .when(n == 3, "SALA DE\nESTAR").when(n == 4, "COCINA").when(n == 5, "A B C").when(n == 6, F.when(k % 2 == 0, "Jardinera norte").otherwise("Patio")).otherwise("Planta de distribucion\narquitectonica")
    )
    line = domain.table(s, d, "lineitem")
    return line.select((F.col("l_orderkey") % 50).alias("project_id"), F.col("l_orderkey").cast("int").alias("page"), (F.col("l_quantity") * 2).alias("x0"), (n * 12.5).alias("y0"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), text.alias("text"))


_CALLS = f"""WITH blocks AS ({_BLOCK}), calls AS (SELECT DISTINCT project_id, page, CASE WHEN regexp_full_match(text, '[A-H]\\nA\\d{{3}}') THEN 'seccion' ELSE 'detalle' END AS kind,
  CASE WHEN text LIKE 'DETALLE%' THEN split_part(text, chr(10), 2) ELSE split_part(text, chr(10), 1) END AS mark, split_part(text, chr(10), CASE WHEN text LIKE 'DETALLE%' THEN 3 ELSE 2 END) AS target
  FROM blocks WHERE regexp_full_match(text, '[A-H]\\nA\\d{{3}}') OR regexp_full_match(text, 'DETALLE\\n\\d+\\n[AS]\\d{{3}}'))"""


@query("call_outs", _CALLS + " SELECT * FROM calls")
def _(s, d):
    return drawings.call_outs(blocks(s, d))


_SPACES = f"""WITH blocks AS ({_BLOCK}), sheets AS (SELECT DISTINCT page FROM blocks WHERE x0 >= 50 AND y0 >= 85 AND contains(upper(replace(text, chr(10), ' ')), 'PLANTA DE DISTRIBUCION ARQUITECTONICA')),
spaces AS (SELECT project_id, page, replace(text, chr(10), ' ') AS name, min(replace(text, chr(10), ' ')) AS original FROM blocks WHERE page IN (SELECT page FROM sheets) AND x0 < 62 AND NOT regexp_matches(text, '\\d') AND text <> 'A B C' AND NOT contains(upper(text), 'JARDINERA') AND NOT contains(upper(text), 'DETALLE') GROUP BY ALL)"""


@query("plan_spaces", _SPACES + " SELECT * FROM spaces")
def _(s, d):
    return drawings.spaces(blocks(s, d))


def _codes(s, d) -> DataFrame:
    """A sheet for each page, some of which name a level."""
    key = F.col("o_orderkey")
    name = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("PLANTA N +"), (key % 3).cast("string"), F.lit(" M"))).otherwise("CORTE")
    return domain.table(s, d, "orders").select((key % 50).alias("project_id"), key.cast("int").alias("page"), F.concat(F.lit("A"), (100 + key % 40).cast("string")).alias("code"), name.alias("name"))


_SHEET_CODES = """, codes AS (SELECT o_orderkey % 50 AS project_id, o_orderkey::INTEGER AS page, 'A' || (100 + o_orderkey % 40) AS code, CASE WHEN o_orderpriority = '1-URGENT' THEN 'N +' || (o_orderkey % 3) || ' M' END AS level, o_orderkey % 3 AS height FROM orders),
of_code AS (SELECT project_id, code, min_by(level, height) AS level FROM codes WHERE level IS NOT NULL GROUP BY ALL)"""


@query("building_spaces", _SPACES + _SHEET_CODES + " SELECT s.project_id, s.page, s.name, s.original, o.level FROM spaces s LEFT JOIN codes c ON s.page = c.page LEFT JOIN of_code o ON c.project_id = o.project_id AND c.code = o.code")
def _(s, d):
    rows = _codes(s, d)
    return drawings.building(rows, blocks(s, d), rows)[1]


@query("building_references", _CALLS + _SHEET_CODES + """ SELECT k.project_id, k.page, k.kind, k.mark, k.target, c.code AS source, CASE WHEN EXISTS (SELECT 1 FROM codes x WHERE x.project_id = k.project_id) THEN EXISTS (SELECT 1 FROM codes x WHERE x.project_id = k.project_id AND x.code = k.target) ELSE true END AS "exists"
FROM calls k LEFT JOIN codes c ON k.page = c.page""")
def _(s, d):
    rows = _codes(s, d)
    return drawings.building(rows, blocks(s, d), rows)[2].select("project_id", "page", "kind", "mark", "target", "source", "exists")


# -- openings, pieces, readings -----------------------------------------------------------------------

_PART = "SELECT p_partkey % 20 AS project_id, p_partkey::INTEGER AS page, p_size, p_brand, p_type FROM part"


@query("opening_sizes", f"WITH p AS ({_PART}) SELECT page, CASE WHEN p_type <> 'SMALL' THEN (p_size / 10.0)::DOUBLE END AS width_m, CASE WHEN p_type <> 'SMALL' THEN 2.1::DOUBLE END AS height_m FROM p")
def _(s, d):
    size = F.col("p_size")
    text = F.when(F.col("p_type") == "SMALL", F.lit("PUERTA DE 0.90")).otherwise(F.concat(F.lit("P1 Buque de "), F.floor(size / 10).cast("string"), F.when(size % 2 == 0, ",").otherwise("."), (size % 10).cast("string"), F.lit(" m x 2.1 m")))
    return domain.table(s, d, "part").select(F.col("p_partkey").cast("int").alias("page"), drawings.openings(text).alias("o")).select("page", "o.*")


@query("structural_pieces", f"""WITH p AS ({_PART}), t AS (SELECT project_id, page % 100 AS page, p_size AS quantity, p_brand AS description, 50.0::DOUBLE AS width_mm, (p_size * 10)::DOUBLE AS height_mm, 6.5::DOUBLE AS length_m FROM p WHERE p_type <> 'SMALL'),
whole AS (SELECT project_id, page, list_sort(list(quantity || '|' || description || '|' || height_mm)) AS rows FROM t GROUP BY ALL), kept AS (SELECT project_id, min(page) AS page FROM whole GROUP BY project_id, rows)
SELECT t.* FROM t JOIN kept ON t.project_id = kept.project_id AND t.page = kept.page""")
def _(s, d):
    size = F.col("p_size").cast("string")
    line = F.when(F.col("p_type") == "SMALL", F.concat(size, F.lit(" sin medida"))).otherwise(F.concat(F.lit("  "), size, F.lit(" "), F.col("p_brand"), F.lit(" 50 x "), (F.col("p_size") * 10).cast("string"), F.lit(" mm x 6,5 m")))
    rows = domain.table(s, d, "part").select((F.col("p_partkey") % 20).alias("project_id"), (F.col("p_partkey") % 100).cast("int").alias("page"), line.alias("line"))
    return drawings.without_repeated_tables(drawings.pieces(rows)).select("project_id", "page", "quantity", "description", "width_mm", "height_mm", "length_m")


@query("best_readings", """WITH r AS (SELECT p_partkey % 20 AS project_id, 'P' || (p_size % 7) AS code, p_brand AS text, CASE WHEN p_size > 40 THEN 'alta' WHEN p_size > 20 THEN 'media' ELSE 'baja' END AS confidence, p_partkey AS seq FROM part)
SELECT project_id, code, arg_min(text, CASE confidence WHEN 'alta' THEN 0 WHEN 'media' THEN 1 ELSE 2 END * 1000000000::BIGINT + seq) AS text, count(DISTINCT text) > 1 AS disagree FROM r GROUP BY ALL""")
def _(s, d):
    size = F.col("p_size")
    level = F.when(size > 40, "alta").when(size > 20, "media").otherwise("baja")
    return drawings.best_readings(domain.table(s, d, "part").select((F.col("p_partkey") % 20).alias("project_id"), F.concat(F.lit("P"), (size % 7).cast("string")).alias("code"), F.col("p_brand").alias("text"), level.alias("confidence"), F.col("p_partkey").alias("seq")))


# -- tables of finishes -----------------------------------------------------------------------------------

#: Words of a page for each order: a title, headers, and codes with their cells from lines.
_WORDS = """pages AS (SELECT o_orderkey % 50 AS project_id, o_orderkey::INTEGER AS page, CASE WHEN o_orderkey % 2 = 0 THEN 'PISOS' ELSE 'CIELOS' END AS kind, o_orderkey % 5 * 10 AS shift, o_orderpriority <> '5-LOW' AS headed FROM orders),
marks AS (SELECT project_id, page, unnest(['TABLA', 'DE', 'ACABADOS', 'DE', kind]) AS text, unnest([600.0, 640.0, 660.0, 720.0, 740.0]) AS x0, 100.0 AS y0 FROM pages
  UNION ALL SELECT project_id, page, unnest(['ACABADO', 'Marca', 'ESPECIFICACIONES']), unnest([560.0 + shift, 700.0 + shift, 850.0]), 120.0 FROM pages UNION ALL SELECT project_id, page, 'CODIGO', 520.0, 121.0 FROM pages WHERE headed),
line AS (SELECT l_orderkey % 50 AS project_id, l_orderkey::INTEGER AS page, l_linenumber AS n, l_suppkey AS k, l_quantity AS q, 150.0 + l_linenumber * 40 + CASE WHEN l_linenumber >= 6 THEN 300 ELSE 0 END AS y FROM lineitem),
words0 AS (SELECT * FROM marks UNION ALL SELECT project_id, page, 'F' || n, 521.0, y FROM line UNION ALL SELECT project_id, page, CASE WHEN k % 10 = 0 THEN 'Reglamento' ELSE 'd' || k END, 550.0 + q * 5, y + 1 FROM line
  UNION ALL SELECT project_id, page, 'b' || k, 690.0 + q * 3, y + 2 FROM line UNION ALL SELECT project_id, page, unnest(['COLOR', 'AZUL']), unnest([860.0, 900.0]), y + 12 FROM line WHERE k % 3 = 0),
words AS (SELECT *, x0 + 30 AS x1, y0 + 10 AS y1, 1000.0 AS width, 800.0 AS height FROM words0)"""


def words(s: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    pages_ = domain.table(s, d, "orders").select((key % 50).alias("project_id"), key.cast("int").alias("page"), F.when(key % 2 == 0, "PISOS").otherwise("CIELOS").alias("kind"), (key % 5 * 10).alias("shift"), (F.col("o_orderpriority") != "5-LOW").alias("headed"))
    word = lambda text, x, y: F.struct(text.alias("text"), x.cast("double").alias("x0"), y.cast("double").alias("y0"))
    at = lambda text, x, y: word(F.lit(text), F.lit(x), F.lit(y))
    marks = F.array(
        at("TABLA", 600, 100), at("DE", 640, 100), at("ACABADOS", 660, 100), at("DE", 720, 100), word(F.col("kind"), F.lit(740), F.lit(100)), word(F.lit("ACABADO"), 560 + F.col("shift"), F.lit(120)), word(F.lit("Marca"), 700 + F.col("shift"), F.lit(120)),
        at("ESPECIFICACIONES", 850, 120), F.when(F.col("headed"), at("CODIGO", 520, 121)),
    )
    n, k, q = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity")
    y = 150.0 + n * 40 + F.when(n >= 6, 300).otherwise(0)
    named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    coloured = k % 3 == 0
    cells = F.array(word(named("F", n), F.lit(521), y), word(F.when(k % 10 == 0, "Reglamento").otherwise(named("d", k)), 550 + q * 5, y + 1), word(named("b", k), 690 + q * 3, y + 2), F.when(coloured, word(F.lit("COLOR"), F.lit(860), y + 12)), F.when(coloured, word(F.lit("AZUL"), F.lit(900), y + 12)))
    rows = pages_.select("project_id", "page", F.explode(F.array_compact(marks)).alias("w")).unionByName(domain.table(s, d, "lineitem").select((F.col("l_orderkey") % 50).alias("project_id"), F.col("l_orderkey").cast("int").alias("page"), F.explode(F.array_compact(cells)).alias("w")))
    return rows.select("project_id", "page", "w.*", (F.col("w.x0") + 30).alias("x1"), (F.col("w.y0") + 10).alias("y1"), F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"))


_TABLES = "WITH " + _WORDS + """, lines AS (SELECT project_id, page, y0, max(y1) AS bottom, upper(string_agg(text, ' ' ORDER BY x0, text)) AS line FROM words GROUP BY ALL),
titles AS (SELECT project_id, page, place, min(y0) AS top, min_by(bottom, y0) AS bottom FROM lines JOIN (VALUES ('TABLA DE ACABADOS DE MUROS Y PAREDES', 'muros_y_paredes'), ('TABLA DE ACABADOS DE PISOS', 'pisos'), ('TABLA DE ACABADOS DE CIELOS', 'cielos')) t(title, place) ON contains(line, title) GROUP BY ALL),
heads AS (SELECT w.project_id, w.page, place, upper(text) AS name, min_by(w.x0, (w.y0, w.x0)) AS x0, min_by(w.y1, (w.y0, w.x0)) AS y1 FROM words w JOIN titles t ON w.project_id = t.project_id AND w.page = t.page AND w.y0 BETWEEN t.bottom + 1 AND t.bottom + 45
  WHERE w.x0 >= width * 0.5 AND upper(text) IN ('CODIGO', 'ACABADO', 'MARCA', 'MODELO', 'ESPECIFICACIONES', 'DISTRIBUIDOR', 'OBSERVACIONES') GROUP BY ALL),
cols AS (SELECT *, row_number() OVER w AS nth, coalesce(lead(x0) OVER w, 1000.0) AS upto, first_value(name) OVER w AS head, first_value(y1) OVER w AS below FROM heads WINDOW w AS (PARTITION BY project_id, page, place ORDER BY x0, name)),
known AS (SELECT * FROM cols WHERE head = 'CODIGO'),
codes AS (SELECT w.project_id, w.page, c.place, text AS code, w.y0, height, w.y0 - lag(w.y0) OVER v AS gap FROM words w JOIN known c ON w.project_id = c.project_id AND w.page = c.page AND nth = 1 WHERE regexp_full_match(text, '[A-Z]?[0-9]{1,2}') AND w.x0 >= c.x0 - 10 AND w.x0 < upto - 5 AND w.y0 >= below
  WINDOW v AS (PARTITION BY w.project_id, w.page, c.place ORDER BY w.y0, text)),
kept AS (SELECT *, lead(y0) OVER v AS next FROM (SELECT *, max(coalesce(gap > 250, false)) OVER (PARTITION BY project_id, page, place ORDER BY y0, code) AS broken FROM codes) WHERE NOT broken WINDOW v AS (PARTITION BY project_id, page, place ORDER BY y0, code)),
typical AS (SELECT project_id, page, place, coalesce(list_sort(list(next - y0) FILTER (next IS NOT NULL))[count(next) // 2 + 1], 250.0) AS typical FROM kept GROUP BY ALL),
rows_ AS (SELECT k.*, y0 - 3 AS top, coalesce(next - 3, least(y0 + typical * 1.5, height)) AS bottom FROM kept k JOIN typical USING (project_id, page, place)),
inside AS (SELECT r.project_id, r.page, r.place, r.code, r.top, w.text, w.x0, w.y0, (SELECT min(c.nth) FROM known c WHERE c.project_id = r.project_id AND c.page = r.page AND c.place = r.place AND c.nth > 1 AND w.x0 >= c.x0 - 35 AND w.x0 < c.upto - 5) AS nth,
  w.x0 >= f.x0 - 10 AND w.x0 < f.upto - 5 AS in_code
  FROM rows_ r JOIN words w ON w.project_id = r.project_id AND w.page = r.page AND w.y0 >= r.top AND w.y0 < r.bottom AND w.x0 >= width * 0.5 JOIN known f ON f.project_id = r.project_id AND f.page = r.page AND f.place = r.place AND f.nth = 1 AND w.y0 >= f.below),
cells AS (SELECT i.project_id, i.page, i.place, i.code, i.top, string_agg(i.text, ' ' ORDER BY i.y0, i.x0, i.text) AS text, string_agg(i.text, ' ' ORDER BY i.y0, i.x0, i.text) FILTER (NOT in_code AND name = 'ACABADO') AS description,
  string_agg(i.text, ' ' ORDER BY i.y0, i.x0, i.text) FILTER (NOT in_code AND name = 'MARCA') AS brand, string_agg(i.text, ' ' ORDER BY i.y0, i.x0, i.text) FILTER (NOT in_code AND name = 'ESPECIFICACIONES') AS spec
  FROM inside i LEFT JOIN known c ON c.project_id = i.project_id AND c.page = i.page AND c.place = i.place AND c.nth = i.nth GROUP BY ALL),
marked AS (SELECT *, regexp_matches(upper(text), 'REGLAMENTO|PROPIEDAD INTELECTUAL|CONSENTIMIENTO|REPRODUCCION|C\\.F\\.I\\.A') AS legal, nullif(array_to_string(list_transform(str_split(trim(regexp_extract(coalesce(spec, ''), '(?i)COLOR\\s+([A-Z][A-Z ]{2,30})', 1)), ' '), lambda x : upper(left(x, 1)) || lower(substr(x, 2))), ' '), '') AS colour FROM cells)"""


@query("plan_finishes", _TABLES + " SELECT project_id, page, place, code, description, brand, colour, text FROM marked WHERE NOT legal")
def _(s, d):
    return drawings.finishes(words(s, d))[0].select("project_id", "page", "place", "code", "description", "brand", "colour", "text")


@query("finish_warnings", _TABLES + """ SELECT project_id, page, place, 'row ' || code || ' is the legal text of the sheet' AS warning FROM marked WHERE legal
UNION ALL SELECT project_id, page, place, 'a title without rows' FROM titles t WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.page = t.page AND c.place = t.place)""")
def _(s, d):
    return drawings.finishes(words(s, d))[1]


@query("merged_finishes", _TABLES + """ SELECT project_id, place, code, min_by(struct_pack(d := description), (page, top, text)).d AS description, min(page) AS page, count(DISTINCT text) > 1 AS disagree FROM marked WHERE NOT legal GROUP BY ALL""")
def _(s, d):
    return drawings.merged_finishes(drawings.finishes(words(s, d))[0]).select("project_id", "place", "code", "description", "page", "disagree")


# -- the analysis document -------------------------------------------------------------------------------


def _analysed(s, d) -> DataFrame:
    """Sheets from orders, what they hold from lines: a plan for each of 50 projects."""
    key, n, k = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    show = lambda c: c.cast("string")
    order = domain.table(s, d, "orders")
    found = order.select((F.col("o_orderkey") % 50).alias("project_id"), F.col("o_orderkey").cast("int").alias("page"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("A"), show(F.col("o_orderkey") % 900))).alias("code"), F.col("o_orderpriority").alias("name"), F.lit("arquitectonica").alias("discipline"), F.lit("vector").alias("kind"))
    levels = order.filter("o_orderpriority = '1-URGENT'").groupBy((F.col("o_orderkey") % 50).alias("project_id"), F.concat(F.lit("N +"), show(F.col("o_orderkey") % 3)).alias("name")).agg(F.min(F.col("o_orderkey") % 3).cast("double").alias("elevation"), F.array_sort(F.collect_set(F.concat(F.lit("A"), show(F.col("o_orderkey") % 900)))).alias("sheets"))
    line = domain.table(s, d, "lineitem").select((key % 50).alias("project_id"), key.cast("int").alias("page"), "*")
    text = F.concat(F.lit("t"), show(k))
    spaces = line.filter("l_linenumber = 3 AND l_quantity < 3").select("project_id", "page", F.lit("SALA").alias("name"), F.lit(None).cast("string").alias("level"), text.alias("text"))
    openings = line.filter("l_linenumber IN (1, 2) AND l_quantity < 4").select("project_id", "page", F.when(n == 1, "puerta").otherwise("ventana").alias("kind"), F.concat(F.lit("P"), show(k)).alias("code"), F.lit(0.9).alias("width"), F.lit(2.1).alias("height"), F.when(k % 3 != 0, "abatible").alias("type"), F.when(k % 2 == 0, "madera").alias("material"), n.alias("quantity"), text.alias("text"), F.lit("alta").alias("confidence"))
    finishes = line.filter("l_linenumber = 4 AND l_quantity < 3").select("project_id", "page", F.lit("F1").alias("code"), F.when(k % 2 == 0, "porcelanato").alias("description"), *(F.lit(None).cast("string").alias(c) for c in ("brand", "format", "colour")), F.lit("pisos").alias("place"), text.alias("text"), F.lit("media").alias("confidence"))
    pieces = line.filter("l_linenumber = 5 AND l_quantity < 3").select("project_id", "page", n.alias("quantity"), F.lit(50.0).alias("width_mm"), F.lit(100.0).alias("height_mm"), F.lit(6.0).alias("length_m"), F.concat(F.lit("perfil "), show(k)).alias("description"), text.alias("text"), F.lit("alta").alias("confidence"))
    warnings = order.filter("o_orderpriority = '5-LOW' AND o_totalprice > 400000").select((F.col("o_orderkey") % 50).alias("project_id"), (F.col("o_orderkey") % 3).alias("source"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("w"), show(F.col("o_orderkey"))).alias("warning"))
    names = found.groupBy("project_id").agg(F.min("name").alias("name"))
    return drawings.analysis(found, levels, spaces, openings, finishes, pieces, warnings, names)


_ANALYSED = """WITH found AS (SELECT o_orderkey % 50 AS project_id, o_orderkey::INTEGER AS page, CASE WHEN o_orderkey % 4 <> 0 THEN 'A' || (o_orderkey % 900) END AS code, o_orderpriority AS name FROM orders),
levels AS (SELECT DISTINCT o_orderkey % 50 AS project_id, 'A' || (o_orderkey % 900) AS code FROM orders WHERE o_orderpriority = '1-URGENT'),
line AS (SELECT l_orderkey % 50 AS project_id, l_orderkey::INTEGER AS page, l_linenumber AS n, l_suppkey AS k, l_quantity AS q, 't' || l_suppkey AS text FROM lineitem),
openings AS (SELECT *, coalesce(nullif(concat_ws(' ', CASE WHEN k % 3 <> 0 THEN 'abatible' END, CASE WHEN k % 2 = 0 THEN 'madera' END), ''), text) AS term FROM line WHERE n IN (1, 2) AND q < 4),
spaces AS (SELECT * FROM line WHERE n = 3 AND q < 3), finishes AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'porcelanato' ELSE text END AS term FROM line WHERE n = 4 AND q < 3), pieces AS (SELECT *, 'perfil ' || k AS term FROM line WHERE n = 5 AND q < 3),
used AS (SELECT l.project_id, max(f.page) AS page FROM levels l JOIN found f ON l.project_id = f.project_id AND l.code = f.code GROUP BY l.project_id, l.code
  UNION SELECT project_id, page FROM openings UNION SELECT project_id, page FROM spaces UNION SELECT project_id, page FROM finishes UNION SELECT project_id, page FROM pieces)
SELECT p.project_id, p.sheet_count, p.project_name, (SELECT string_agg(page, ' ' ORDER BY page) FROM (SELECT DISTINCT u.page FROM used u JOIN found f ON u.page = f.page WHERE u.project_id = p.project_id)) AS pages,
  (SELECT count(*) FROM spaces x WHERE x.project_id = p.project_id) AS spaces, (SELECT coalesce(string_agg(term, '|' ORDER BY page, 'P' || k, CASE WHEN k % 3 <> 0 THEN 'abatible' END NULLS FIRST), '') FROM openings x WHERE n = 1 AND x.project_id = p.project_id) AS doors,
  (SELECT count(*) FROM openings x WHERE n = 2 AND x.project_id = p.project_id) AS windows, (SELECT coalesce(string_agg(term, '|' ORDER BY page, CASE WHEN k % 2 = 0 THEN 'porcelanato' END NULLS FIRST, text), '') FROM finishes x WHERE x.project_id = p.project_id) AS finishes,
  (SELECT coalesce(string_agg(term, '|' ORDER BY page, term), '') FROM pieces x WHERE x.project_id = p.project_id) AS pieces,
  (SELECT coalesce(string_agg('w' || o_orderkey, ' ' ORDER BY o_orderkey % 3, o_orderkey), '') FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice > 400000 AND o_orderkey % 50 = p.project_id) AS warnings
FROM (SELECT project_id, count(*) AS sheet_count, min(name) AS project_name FROM found GROUP BY project_id) p"""


@query("plan_analysis", _ANALYSED)
def _(s, d):
    """The documents, with their lists told in short."""
    terms = lambda c: F.array_join(F.transform(c, lambda x: x["search_term"]), "|").alias(c)
    return _analysed(s, d).select(
        "project_id", "sheet_count", "project_name", F.array_join(F.transform("sheets", lambda x: x["page"].cast("string")), " ").alias("pages"), F.size("spaces").cast("long").alias("spaces"), terms("doors"),
        F.size("windows").cast("long").alias("windows"), terms("finishes"), terms("pieces"), F.array_join("warnings", " ").alias("warnings"),
    )
