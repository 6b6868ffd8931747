"""Rows shared by the tests: the small tables and documents of every odd kind."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows, extra=()):
    """Documents of (doc_id, text); ``extra`` names further long columns that operators might use themselves."""
    df = spark.createDataFrame([(i, t, "en", f"src{n % 3}" if n % 4 else None, len(t or ""))
                                for n, (i, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for c in extra:
        df = df.withColumn(c, F.lit(7).cast("long"))
    return df


def empty_docs(spark):
    return docs_of(spark, [(1, "a")]).where("false")


PASSAGE = " ".join(f"word{i * 37 % 101}x{i}" for i in range(70))
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "lost and found"), (4, "Same Text here"), (4, "Same Text here"),
       (5, "Same Text here"), (6, PASSAGE), (7, "intro words " + PASSAGE + " outro"), (None, PASSAGE),
       (8, "é " * 300), (9, "ab" * 40_000), (10, " ".join(["again and again"] * 3_000)), (2**60, "x")]
CLASHING = ("rid", "parts", "score", "place", "w", "row", "key", "fp", "n_words", "spans", "a.b")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
