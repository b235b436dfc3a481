"""Tables with the awkward cases every operator has to stand."""

LONG = "word " * 30_000

ROWS = [
    (1, "A plain first line that is long enough.\nSecond line, also long enough here.", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n ", "de", "b", 3),
    (5, LONG, "en", "a", 9),
    (6, "A plain first line that is long enough.\nSecond line, also long enough here.", "en", "b", 5),
    (6, "A plain first line that is long enough.\nSecond line, also long enough here.", "en", "b", 5),
    (None, "Text without an id, but with some words in it.", "en", "c", 1),
    (8, "x", "en", None, 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use inside or in their results.
EXTRA = "score double, items string, removed int, taken long, kept boolean, h int, key string, rep long, block int"


def awkward(spark):
    extra = (0.5, "x", 1, 2, True, 3, "k", 4, 5)
    return spark.createDataFrame([(*r, *extra) for r in ROWS], f"{SCHEMA}, {EXTRA}")


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
