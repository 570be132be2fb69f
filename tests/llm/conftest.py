import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with a column whose name clashes with results."""

    def make(rows):
        full = [(*r, *("en", "s")[len(r) - 2 :]) if len(r) < 4 else tuple(r) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit(7)).withColumn("size", F.lit("x"))

    return make


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows that every operator must take: null and empty texts, white space only, a tie, a repeated row, a null id, a very long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (None, "éèà ñandú Straße ÀÉ"), (7, "word " * 30_000), (8, "x"), (9, None, None, None),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)
