"""Small tables with the awkward rows that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    long_text = prose(rng, 30_000)
    rows = [
        (1, "Plain text of a few words here.", "en", "a", 31), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \n\t ", "en", None, 4),
        (None, "No id but words", None, None, None), (None, None, None, None, None), (5, long_text, "en", "b", len(long_text)),
        (6, "Plain text of a few words here.", "en", "a", 31), (6, "Plain text of a few words here.", "en", "a", 31), (7, "x", "en", "c", 1),
        (8, "<|endoftext|> a  b c\n\n d ", "en", "c", None), (9, "É\u0000ß 中文 \\ </turn> #*$", "fr", "é", 9),
    ]
    rows += [(100 + k, prose(rng, 90), "en", "abc"[k % 3], None) for k in range(40)]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def with_clashes(df, *names):
    """The table with more columns, named as those that operators add."""
    for name in names:
        df = df.selectExpr("*", f"'mine' AS `{name}`")
    return df
