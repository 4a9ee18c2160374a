"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them as columns.
CLASHING = ("fp", "text_hash", "component", "words", "score", "rules", "quality", "copies", "size", "_hash", "ids", "n", "rate")
WORDS = "the of and in to is that with by on thereon ingat erble ndou shanti leaux münch für école".split()


def prose(rng: random.Random, words: int) -> str:
    out = []
    for n in range(words):
        word = rng.choice(WORDS) if rng.random() < 0.6 else "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
        out.append(word.capitalize() if rng.random() < 0.05 else word)
        if rng.random() < 0.1:
            out[-1] += rng.choice([".", ",", ".\n"])
    return " ".join(out)


def edge_rows(seed: int = 1) -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    rng = random.Random(seed)
    long = prose(rng, 30_000)
    same = prose(rng, 80)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b\f\r ", "en", None, 6),
        (None, same, "en", "a", 10), (None, None, None, None, None), (None, same + " x", None, "b", None),
        (4, long, "en", "b", len(long)), (5, long + " end", "en", "b", 7), (6, same, "en", "a", 10),
        (6, same, "en", "a", 10), (7, same, None, "c", -5), (7, same.upper(), "fr", "c", 3), (8, "one two three", "en", "a", 1),
        (9, "the &&& $$$ ||| ***", "en", "a", 1), (10, "é\u0130ß 日本 😀 \x85\xa0", "zz", "a", 1), (11, "word " * 300, "en", "a", 1),
    ]
    rows += [(n, prose(rng, rng.randint(1, 200)), rng.choice(["en", "fr", "de"]), rng.choice("abcde"), n) for n in range(20, 90)]
    return rows


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(5, "n_chars")


def with_clashing_columns(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit(name) for name in CLASHING})


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
