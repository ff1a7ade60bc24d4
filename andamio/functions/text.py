"""Text rules as column expressions: normalising, tokens, signatures, signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as vocab

# Letters with a decomposition and the letter they keep; the rest become blanks below.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}", "")


def normalize(text: Column) -> Column:
    """Lower case, no accents, single blanks, only letters, digits and dots. Null: empty."""
    steps = (
        (r"\b(?:numero|num|no)\.?\s+(?=\d)", ""),
        (r"(\d)\s*x\s*(\d)", "$1 x $2"),
        (r"[/\-_,;:]", " "),
        (r'["″]', " pulg "),
        (r"[^a-z0-9. ]", " "),
        (r"\s+", " "),
    )
    start = strip_accents(F.lower(F.coalesce(text, F.lit(""))))
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, start))


def words(text: Column) -> Column:
    """Words between blanks; none for an empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def _mapped(value: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, value), value)


def tokens(normal: Column) -> Column:
    """Words of a normalised text with unit spellings joined, then without stop words."""
    return F.filter(F.transform(words(normal), lambda w: _mapped(w, vocab.UNITS)), lambda w: ~w.isin(*vocab.STOP_WORDS))


def is_number(word: Column) -> Column:
    """Digits, dots between them or around."""
    return F.regexp_replace(word, r"\.", "").rlike(r"^\d+$")


def number_variants(word: Column) -> Column:
    """The word and its singular or plural, for letters alone longer than three."""
    plain = F.array(word)
    ends = F.array_distinct(F.array_compact(F.array(word, F.left(word, F.length(word) - 1), F.when(word.endswith("es") & (F.length(word) > 5), F.left(word, F.length(word) - 2)))))
    return F.when(word.rlike("^[a-z]{4,}$"), F.when(word.endswith("s"), ends).otherwise(F.array(word, F.concat(word, F.lit("s"))))).otherwise(plain)


def same_words(word: Column) -> Column:
    """The words that stand for this one: its group, or itself."""
    found = reduce(lambda rest, group: F.when(word.isin(*group), F.array(*map(F.lit, group))).otherwise(rest), reversed(vocab.SAME_WORD), F.array(word))
    return found


def expanded(word: Column) -> Column:
    """Every form that a search for the word accepts."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(same_words(word), number_variants))))


def identity_tokens(name: Column) -> Column:
    """Tokens that tell products apart: no units, no numbers, sorted, each once."""
    kept = F.filter(tokens(normalize(name)), lambda w: ~w.isin(*vocab.GENERIC_TOKENS) & ~is_number(w))
    return F.array_sort(F.array_distinct(kept))


def description_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.slice(tokens(normalize(text)), 1, 40)))


def name_signature(name: Column) -> Column:
    """The first four words that are not numbers, for near-equal names."""
    return F.array_join(F.slice(F.filter(words(normalize(name)), lambda w: ~is_number(w)), 1, 4), " ")


def weight_number(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def shares_prefix(a: Column, b: Column) -> Column:
    """Equal first five letters; words under five letters have to be equal."""
    short = F.least(F.length(a), F.length(b)) < 5
    return F.when(short, a == b).otherwise(F.left(a, F.lit(5)) == F.left(b, F.lit(5)))


def first_significant(name: Column) -> Column:
    return F.try_element_at(F.filter(tokens(normalize(name)), lambda w: ~is_number(w)), F.lit(1))


def is_negation(term: Column) -> Column:
    return F.coalesce(F.try_element_at(words(normalize(term)), F.lit(1)).isin(*vocab.NEGATIONS), F.lit(False))


def suggested_section(category: Column) -> Column:
    """The first section one of whose words is in the category; null if none."""
    normal = normalize(category)
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, (normal.contains(w) for w in stock)), F.lit(section)) for section, stock in vocab.SECTION_WORDS))


# -- signals of a name for a query word, on the normalised name's words ---------------------


def positions(name_words: Column, forms: Column) -> Column:
    """Places (from 0) where a form stands."""
    places = F.sequence(F.lit(0), F.size(name_words) - 1)
    return F.when(F.size(name_words) > 0, F.filter(places, lambda i: F.array_contains(forms, F.element_at(name_words, i + 1)))).otherwise(F.array().cast("array<int>"))


def after_accessory(name_words: Column, place: Column) -> Column:
    """Whether the word at a place is what something else is for or acts on."""
    before = F.try_element_at(name_words, F.when(place > 0, place))
    earlier = F.try_element_at(name_words, F.when(place > 1, place - 1))
    direct = before.isin(*vocab.ACCESSORY_WORDS, *vocab.ACTING_WORDS)
    return F.coalesce(direct, F.lit(False)) | F.coalesce(before.isin(*vocab.SKIPPED_PREPOSITIONS) & earlier.isin(*vocab.ACTING_WORDS), F.lit(False))


def has_phrase(name_words: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the name as whole words in a row."""
    padded = F.concat(F.lit(" "), F.array_join(name_words, " "), F.lit(" "))
    return (phrase != "") & F.contains(padded, F.concat(F.lit(" "), phrase, F.lit(" ")))


# -- names of products ---------------------------------------------------------------------


def codes(name: Column) -> Column:
    """Manufacturer codes: a letter first, four characters at least, a digit in it; upper case."""
    found = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"(?i)\b[a-z](?=[a-z0-9]*\d)[a-z0-9]{3,}\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def stock_words(name: Column, stock: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_intersect(words(normalize(name)), F.array(*map(F.lit, stock))))


def is_part(name: Column) -> Column:
    return F.arrays_overlap(words(normalize(name)), F.array(*map(F.lit, vocab.PART_WORDS)))


def package_words(name: Column) -> tuple[Column, Column]:
    """(core, package): words that name the product, and words that name its package or size."""
    w = words(normalize(name))
    sized = lambda x: x.isin(*vocab.PACKAGES) | x.rlike(r"^\d+$")
    core = F.array_join(F.filter(w, lambda x: ~sized(x)), " ")
    package = F.array_join(F.transform(F.filter(w, sized), lambda x: _mapped(x, vocab.PACKAGES)), " ")
    return core, F.nullif(package, F.lit(""))


def slug(text: Column) -> Column:
    plain = strip_accents(F.lower(F.coalesce(text, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def html_text(html: Column) -> Column:
    """Visible text: scripts and styles dropped, a line for each block, blanks trimmed; empty: null."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    lines = F.regexp_replace(bare, r"(?i)<\s*br\s*/?>|</\s*(?:p|li|div|tr)\s*>", "\n")
    bare = F.regexp_replace(lines, r"(?s)<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    kept = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\x{a0}]+", " "))), lambda x: x != "")
    return F.nullif(F.array_join(kept, "\n"), F.lit(""))


def image_list(images: Column) -> Column:
    """JSON of the images that are there, each once, in order; null if none is."""
    kept = F.array_distinct(F.filter(images, lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(kept) > 0, F.regexp_replace(F.to_json(kept), '","', '", "'))
