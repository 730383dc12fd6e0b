"""Awkward little documents shared by the tests, and the check tables where they are there."""

from pyspark.sql import Row

LONG = "word " * 3000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source="s", n_chars=len(t or "")) for i, t in rows], SCHEMA)


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "a b c d e f g h i j k l m n"), (5, "a b c d e f g h i j k l m n"), (None, "a b c d e f g h i j k l m n"),
    (6, "Ünïcode ÀÉÎ straße — “quoted” 你好 世界 😀"), (7, "!!! ... 123"), (8, "x"), (9, "be " * 40), (10, "Be BE be, be. be"),
]
