"""Small corpora for the tests of this folder."""

import random

SYLLABLES = "an er the ing on re st ou ha en le ti ver schö éla qué ño".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def words(rng, n):
    return [word(rng) for _ in range(n)]


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and columns whose names operators use."""
    long = " ".join(words(random.Random(9), 40_000))
    rows = [(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (2, None), (3, ""), (4, " \t\n "), (None, "no id at all, but words"), (5, long), (6, "x" * 50_000), (7, "One two THREE four five six seven eight"), (7, "another text of the same id")]
    names = ["score", "spans", "items", "n", "id", "key", "same", "body", "c0", "predicted", "cut_id", "n_words"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.lit(f"extra {n}") for n in names}).withColumn("n_chars", F.length("text").cast("long"))


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
