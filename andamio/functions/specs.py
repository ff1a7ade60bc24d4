"""Technical data in product names: extraction, comparison, sale units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, vocabulary

COMPATIBILITY = {"diametro_pulg", "calibre", "longitud_cm", "diametro_mm", "angulo_grados", "amperaje_a", "calibre_awg"}
SALE_UNIT = {"peso_kg", "peso_lb", "cantidad_unidades", "volumen_l"}
PERFORMANCE = {"potencia_w", "voltaje", "longitud_m"}
NEAR, EQUAL, CROSSED = 0.2, 1e-9, 0.15

# How names state numbers. The first match of each counts; its first group is the number.
_N = r"(\d+(?:[.,]\d+)?)"
_FRACTION = r"(\d+\s+\d+\s*/\s*\d+|\d+\s*/\s*\d+|\d+(?:[.,]\d+)?)"
PATTERNS = {
    "diametro_pulg": r'(?<![a-z0-9])(\d+[\s\-]+\d+\s*/\s*\d+|\d+\s*/\s*\d+|\d+)\s*(?:"|″|”|pulg)',
    "calibre": r"#\s*(\d+)\b",
    "diametro_mm": rf"\b{_N}\s*mm\b",
    "longitud_cm": rf"\b{_N}\s*(?:cm\b|x\d+(?:[.,]\d+)?\s*(?:cm|centimetros?)\b)",
    "potencia_w": rf"\b{_N}\s*w\b",
    "voltaje": rf"\b{_N}\s*v(?:ac|olt)?\b",
    "longitud_m": rf"(?<![a-z0-9]){_N}\s*m\b",
    "peso_kg": rf"\b{_N}\s*kg\b",
    "peso_lb": rf"\b{_N}\s*(?:lb|lbs|libras?)\b",
    "cantidad_unidades": rf"\b{_N}\s*(?:uds|pcs|unidades|piezas|pzas|ud)\b",
    "angulo_grados": rf"\b{_N}\s*(?:[°º](?![cf])|grados\b)",
    "schedule": r"\bsch\s*(\d+)\b",
    "calibre_awg": rf"\b{_N}\s*awg\b",
    "presion_psi": rf"\b{_N}\s*psi\b",
    "potencia_hp": rf"\b{_FRACTION}\s*hp\b",
}
VOLUMES = ((rf"\b{_FRACTION}\s*(?:ml|mililitros?)\b", 0.001), (rf"\b{_FRACTION}\s*(?:l|lt|litros?)\b", 1.0), (rf"\b{_FRACTION}\s*(?:gal|gl|galon(?:es)?)\b", 3.785))
AMPERES = rf"\b{_N}a\b"
BTU = r"\b(\d{1,3}[.,]\d{3}|\d+)\s*btu\b"


# A word that is no part of a number's text unless it stands directly behind a number: no digit, no
# number sign, no dash in front, not "sch"; words with combining marks, which go later, do not count.
_PLAIN_WORD = r"[^\s\d#\p{Mn}-][^\s\d#\p{Mn}]*+(?<![sS][cCçÇ][hH])\s++"


def near_numbers(long_text: Column) -> Column:
    """A text in which the rules of this module find the same numbers, units and sizes, mostly much shorter.

    Of every run of plain words the first stays, as it may be the unit of a number before; the
    others become a bar, which no rule goes over. All rules then read what is left. Rules on
    words alone (packages of paint) need the whole text.
    """
    return F.regexp_replace(long_text, rf"(?<!\S)({_PLAIN_WORD})(?:{_PLAIN_WORD})++", "$1| ")


def prepared(name: Column) -> Column:
    """Lower case without accents; signs stay."""
    return text.strip_accents(F.lower(F.coalesce(name, F.lit(""))))


def number(found: Column) -> Column:
    """``1 1/2``, ``1-1/2``, ``3/4`` or a decimal with comma or dot; a division by zero is null."""
    mixed, plain = r"^(\d+)[\s\-]+(\d+)/(\d+)$", r"^(\d+)\s*/\s*(\d+)$"
    part = lambda pattern, i: F.regexp_extract(found, pattern, i).try_cast("double")
    fraction = F.coalesce(part(mixed, 1) + F.try_divide(part(mixed, 2), part(mixed, 3)), F.try_divide(part(plain, 1), part(plain, 2)))
    return F.when(F.contains(found, F.lit("/")), F.bround(fraction, 4)).otherwise(F.regexp_replace(found, ",", ".").try_cast("double"))


def first_number(name: Column, pattern: str) -> Column:
    return number(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")))


def volume(name: Column) -> Column:
    """Litres, from millilitres, litres or gallons, in this order."""
    return F.coalesce(*(F.bround(first_number(name, p) * factor, 4) for p, factor in VOLUMES))


def _within(n: Column) -> Column:
    """Amperes that can be; other numbers with an a behind are no currents."""
    return F.when((n > 0) & (n < 5000), n)


def _thousands(found: Column) -> Column:
    """A number in which a dot or comma before three digits parts thousands."""
    return F.when(found.rlike(r"^\d{1,3}[.,]\d{3}$"), F.regexp_replace(found, "[.,]", "").try_cast("double")).otherwise(number(found))


SPEC_NAMES = (*PATTERNS, "volumen_l", "amperaje_a", "energia_btu")


def all_specs(name: Column) -> Column:
    """A struct of all numbers that a name states; null is unknown.

    The texts of all rules are taken out first and bound to a variable, then read as
    numbers, so no rule is written out more than once and the code stays small.
    """
    rules = [*PATTERNS.values(), *(p for p, _ in VOLUMES), AMPERES, BTU]
    texts = F.transform(F.array(prepared(name)), lambda base: F.array(*(F.nullif(F.regexp_extract(base, p, 1), F.lit("")) for p in rules)))

    def numbers(found: Column) -> Column:
        at = lambda i: F.get(found, F.lit(i))
        plain = len(PATTERNS)
        made = {k: number(at(i)) for i, k in enumerate(PATTERNS)}
        made["volumen_l"] = F.coalesce(*(F.bround(number(at(plain + i)) * factor, 4) for i, (_, factor) in enumerate(VOLUMES)))
        made["amperaje_a"] = _within(number(at(plain + len(VOLUMES))))
        made["energia_btu"] = _thousands(at(plain + len(VOLUMES) + 1))
        return F.struct(*(made[k].alias(k) for k in SPEC_NAMES))

    return F.get(F.transform(texts, numbers), F.lit(0))


def _differ(a: Column, b: Column, key: str) -> Column:
    return F.abs(a[key] - b[key]) > EQUAL


def _close(a: Column, b: Column, key: str) -> Column:
    return F.when(a[key] != 0, F.abs(a[key] - b[key]) / F.abs(a[key]) <= NEAR).otherwise(b[key] == 0)


def _any(cases: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, (F.coalesce(c, F.lit(False)) for c in cases), F.lit(False))


def conflict(a: Column, b: Column, keys: set[str]) -> Column:
    """Whether ``compare`` has one of the keys among the conflicts."""
    return _any([_differ(a, b, k) for k in sorted(keys & (COMPATIBILITY | SALE_UNIT))])


def agreement(a: Column, b: Column, keys: set[str]) -> Column:
    """Whether ``compare`` has one of the keys among the agreements."""
    return _any([*(~_differ(a, b, k) for k in sorted(keys & (COMPATIBILITY | SALE_UNIT))), *(_close(a, b, k) for k in sorted(keys & PERFORMANCE))])


def compare(a: Column, b: Column) -> Column:
    """conflicts, agreements, one_sided: keys in alphabetical order. Near is relative to ``a``."""
    hard, soft = sorted(COMPATIBILITY | SALE_UNIT), sorted(PERFORMANCE)
    differ, close = (lambda k: _differ(a, b, k)), (lambda k: _close(a, b, k))
    listed = lambda cases: F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in cases))))
    return F.struct(
        listed([(k, differ(k)) for k in hard]).alias("conflicts"),
        listed([*((k, ~differ(k)) for k in hard), *((k, close(k)) for k in soft)]).alias("agreements"),
        listed([(k, a[k].isNull() != b[k].isNull()) for k in sorted(SALE_UNIT)]).alias("one_sided"),
    )


def crossed_diameters(a: Column, b: Column) -> Column:
    """Millimetres on one side against inches on the other: agree, conflict or null."""
    mm, inch = F.coalesce(F.when(b["diametro_pulg"].isNotNull(), a["diametro_mm"]), b["diametro_mm"]), F.coalesce(F.when(a["diametro_mm"].isNotNull(), b["diametro_pulg"]), a["diametro_pulg"])
    one_each = (a["diametro_mm"].isNotNull() & a["diametro_pulg"].isNull() & b["diametro_pulg"].isNotNull() & b["diametro_mm"].isNull()) | (
        b["diametro_mm"].isNotNull() & b["diametro_pulg"].isNull() & a["diametro_pulg"].isNotNull() & a["diametro_mm"].isNull()
    )
    return F.when(one_each, F.when(F.abs(mm - inch * 25.4) / F.greatest(mm, inch * 25.4) <= CROSSED, "agree").otherwise("conflict"))


def paint_package(name: Column, category: Column) -> Column:
    """How paint is sold: a fraction of a gallon, or else the package words; null for others."""
    base = prepared(name)
    fraction = F.regexp_extract(base, r"\b(1/(?:2|4|8|16|32))\b", 1)
    known = F.coalesce(*(F.when(fraction == f, F.lit(label)) for f, label in vocabulary.GALLON_FRACTIONS.items()))
    _, package = text.package_words(name)
    words = F.nullif(F.array_join(F.filter(F.split(package, " "), lambda w: ~w.rlike(r"^\d{4,}$")), " "), F.lit(""))
    return F.when(category == vocabulary.PAINT, F.coalesce(known, words))


def plain_number(value: Column) -> Column:
    """A number in text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.call_function("format_number", F.bround(value, 4), F.lit("0.####")), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def sale_unit(name: Column, category: Column) -> Column:
    """The unit that a product is sold in: package, litres, kilograms, pounds or square metres."""
    base = prepared(name)
    area = first_number(base, rf"{_N}\s*m(?:2|²)")
    unit = lambda n, u: F.when(n.isNotNull(), F.concat(plain_number(n), F.lit(u)))
    return F.coalesce(paint_package(name, category), unit(volume(base), " L"), unit(first_number(base, PATTERNS["peso_kg"]), " kg"), unit(first_number(base, PATTERNS["peso_lb"]), " lb"), unit(area, " m²"))


def size_pairs(name: Column) -> Column:
    """``a x b`` sizes in centimetres. A unit behind the second number holds for both; without one,
    numbers under ten are metres."""
    base = prepared(name)
    pattern = r"(\d+(?:[.,]\d+)?)\s*x\s*(\d+(?:[.,]\d+)?)\s*(mm|cm|m\b|pulg|\"|″)?"
    whole = F.regexp_extract_all(base, F.lit(pattern), F.lit(0))
    part = lambda s, i: F.regexp_extract(s, pattern, i)

    def size(s: Column) -> Column:
        x, y, unit = number(part(s, 1)), number(part(s, 2)), part(s, 3)
        factor = F.when(unit == "mm", 0.1).when(unit == "cm", 1.0).when(unit == "m", 100.0).when(unit != "", 2.54).when((x < 10) & (y < 10), 100.0).otherwise(1.0)
        return F.struct(F.bround(x * factor, 4).alias("w"), F.bround(y * factor, 4).alias("h"))

    return F.transform(whole, size)


def sizes_conflict(name: Column, w: Column, h: Column, tolerance: float = NEAR) -> Column:
    """True if the name has sizes and none fits w x h (either way round); null without sizes."""
    near = lambda a, b: F.abs(a - b) / b <= tolerance
    fits = lambda s: (near(s["w"], w) & near(s["h"], h)) | (near(s["w"], h) & near(s["h"], w))
    found = size_pairs(name)
    return F.when((F.size(found) > 0) & w.isNotNull() & h.isNotNull(), ~F.exists(found, fits))
