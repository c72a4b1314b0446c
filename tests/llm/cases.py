"""Small tables with the awkward rows that every operator must take."""

LONG = "word " * 30_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, size long, id string, key string"


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away from home", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from home", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from home", "en", "a"),
        (3, None, "en", None), (4, "", None, "b"), (5, " \n\t ", "fr", "b"), (6, LONG, "en", "c"), (7, "été déjà vu à la maison près du lac gelé où il fait froid", "fr", None),
        (None, "a row without an id that nobody can name at all in any way", "en", "a"), (8, "12345 67890", None, None),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1, None, "k") for r in rows], DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=((1, 1, 0), (2, 1, 0), (6, 0, 0), (6, 0, 0), (7, None, 0), (None, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
