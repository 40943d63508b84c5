"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, fp string, print string, at int, key string"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "to") for b in ("ban", "der", "fel", "gor", "hin", "jas", "kel", "lum")]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(words))


def docs_of(spark, pairs):
    """(doc_id, text) pairs as a table with the columns of documents and names that operators use inside."""
    rows = [(d, t, "en", "web", len(t or ""), 1, "x", "y", 2, "z") for d, t in pairs]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, prose(4, 3)), (5, prose(5, 40)), (5, prose(5, 40)), (6, prose(5, 40)),
    (7, prose(7, 9_000)), (8, "ÄÖ ß   日本語 \U0001f600 <|endoftext|>"), (9, "a"), (None, prose(9, 30)), (None, None), (10, "x" * 5_000),
]
