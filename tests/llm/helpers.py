"""Small documents with the awkward cases: nulls, blanks, long texts, ties, repeats, extra columns."""

LONG = " ".join(f"word{i % 977}" for i in range(20000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, probe string, salt string, key string"


def documents(spark, rows):
    """rows: (doc_id, text); further columns carry names that operators use inside."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", 1, "p", "s", "k") for i, t in rows], SCHEMA)


def awkward(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew some very strong tea at dawn"
    rows = [(1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \t\n"), (7, LONG), (8, LONG + " end"), (9, "one"), (10, "one"), (None, base), (7, LONG), (11, base + " x")]
    return documents(spark, rows)


def empty(spark):
    return documents(spark, [])
