"""Small corpora with the awkward rows, and plain versions of shared rules."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, row_hash string, key int, bands int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x09-\x0d\x20]+", (text or "").translate(LOWER)) if w]


def shingles(text: str | None, size: int = 5) -> list[tuple]:
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([tuple(w)] if w else [])


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = ["ta", "re", "mo", "li", "su", "na", "ko", "ve", "dé", "ñu"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def awkward() -> list[tuple[int | None, str | None]]:
    """Ids and texts: nulls, empties, blanks, repeated rows, one id with two texts, very long and very short texts."""
    base = prose(1, 120)
    return [
        (1, base), (2, base), (3, base.replace("ta", "TA", 1)), (4, base + " one more word here"), (5, prose(2, 80)),
        (None, prose(3, 30)), (None, None), (6, None), (7, ""), (8, " \t\n "), (9, "x"), (9, "x"), (9, "another text"),
        (10, "la " * 400), (11, prose(4, 9000)), (12, prose(5, 6)), (12, prose(5, 6)), (13, "\x00\x1f￿😀 é"),
    ]


def corpus(spark, rows=None):
    """A table of documents with more columns, some named like the operators' own."""
    rows = awkward() if rows is None else rows
    return spark.createDataFrame([(i, t, "xx", None, len(t or ""), "a", "b", 1, 2) for i, t in rows], SCHEMA)
