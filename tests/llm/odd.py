"""Rows that an operator must survive."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use for themselves.
CLASHING = ("th", "digest", "sha", "bytes", "h", "v", "n", "hits", "scores", "kept_id", "rows", "row_", "lane", "keep", "tokens", "site", "marks", "kept", "key", "shard", "position", "redo", "new", "did", "TH", "a.b", "same", "blocked", "matched", "id_rows", "place", "lines_removed", "n_replaced", "_encoded", "round_trip")
LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a", 5),
    (1, "one two three four five six seven", "en", "a", 5),
    (2, "one two three four five six seven", None, None, None),
    (3, "", "en", "a", 0),
    (4, None, "en", "b", 0),
    (None, "one two three four five six seven", "en", "b", 1),
    (None, None, None, None, None),
    (5, "   \n\t ", "en", "b", 1),
    (6, LONG, "en", "a", 1),
    (6, LONG + " more", "en", "b", 1),
    (7, "naïve 日本語 \U0001f600 � \x00 text", "xx", "c", 1),
    (7, "naïve 日本語 \U0001f600 � \x00 text", "xx", "c", 1),
]


def odd_documents(spark, clash=False):
    names = {"lines_removed": 1}  # spark is not case sensitive: of TH and th one is enough
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    if clash:
        for c in CLASHING:
            if c.lower() not in names:
                names[c.lower()] = 1
                df = df.withColumn(c, F.lit("x"))
    return df


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
