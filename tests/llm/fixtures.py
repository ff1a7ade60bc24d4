"""Small document tables with the odd cases that every operator has to define."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int"


def docs(spark, rows):
    """(doc_id, text[, source]) rows, with extra columns whose names clash with results."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None, "x", 7) for r in rows]
    return spark.createDataFrame(full, DOCS)


LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(20_000))

ODD = [
    (1, "Hello World. this is a test; of Things"),
    (2, "hello world. THIS is a test; of things"),
    (3, None),
    (4, ""),
    (5, LONG),
    (6, LONG.upper()),
    (7, "ÀÉ straße <|endoftext|> ½ 10² 日本語\n\n  x "),
    (7, "ÀÉ straße <|endoftext|> ½ 10² 日本語\n\n  x "),
    (7, "another text under the same id"),
    (None, "no id"),
    (None, None),
    (8, "   \t\n "),
    (9, "one"),
]
