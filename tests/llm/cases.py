"""Awkward documents and pages that every corpus operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, fingerprint string, items string, ids string"
LONG = "The quick brown fox jumps over the lazy dog near the river bank. " * 4_000


def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns named like the operators' own."""
    rows = [
        (1, "One text, and more of it.", "en"),
        (2, "One  text,\nand more of it.", "en"),
        (3, "One  text,\nand more of it.", "en"),
        (3, "One  text,\nand more of it.", "en"),
        (4, None, None),
        (5, "", "en"),
        (None, "No id here, only text", "en"),
        (None, None, None),
        (6, " \t\r\n\x0b\x0c", "de"),
        (7, LONG, "en"),
        (8, LONG + "end", "en"),
        (9, "x", None),
        (10, "12345 67890 ...", "fr"),
        (11, "Élan über ñandú 漢字 😀 <|endoftext|> it's", "fr"),
        (12, "a" * 20_000, "en"),
    ]
    full = [(i, t, g, None, None if t is None else len(t), "r", True, "f", None, "i") for i, t, g in rows]
    return spark.createDataFrame(full, SCHEMA)


def no_docs(spark):
    return docs(spark).limit(0)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
