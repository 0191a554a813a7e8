"""Small documents tables with every awkward case, and their brute-force readings."""

from __future__ import annotations

import random

WORDS = "the of and lorem ipsum dolor sit amet tempor magna aliqua enim minim veniam quis nostrud".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, route long, batch long, n_tokens long"


def prose(seed: int, n: int, words: list[str] | None = None) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words or WORDS) for _ in range(n))


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside; rows: (doc_id, text[, lang[, source]])."""
    full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] else None, "x", 7, 7, 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward() -> list[tuple]:
    long = prose(5, 3_000)
    return [
        (4, "Hello World of words and more words here", "en", "a"), (2, "hello world of words and more words here", "en", "a"),
        (9, "hello world of words and more words here", "en", None), (1, None, None, "a"), (3, "", "en", "b"),
        (None, "an orphan text without an identifier at all", "en", "a"), (None, None, None, None), (5, "one", "en", "b"),
        (6, " \t\n", "fr", "b"), (7, long, "en", "a"), (8, long + " tail", "en", "a"), (7, long, "en", "a"),
        (10, "ÄÖÜ straße ÄÖÜ", "de", "b"), (11, "äöü straße äöü", "de", "b"), (12, "\x00 nul \x00 nul", "en", "b"),
        (13, "12345 678", "en", "b"),
    ]
