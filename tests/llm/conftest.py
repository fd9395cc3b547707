import pytest

SF = "/root/testdata/sf0.001"
LONG = "The quick brown fox, " * 3000 + "ends."

# Null, empty, blank and very long texts, copies, repeated rows, null and repeated ids, odd white space, all scripts.
ROWS = [
    (1, "Alpha beta\nShared line \n\nLAST line", "en", "s", 10), (2, None, None, None, None), (3, "", "en", "s", 0),
    (4, " \n\t", "de", "s", 3), (5, LONG, "en", "s", len(LONG)), (5, LONG, "en", "s", len(LONG)), (6, LONG, "fr", "t", len(LONG)),
    (None, "shared LINE\nno id", "en", "s", 5), (7, "É shared line\nİstanbul  日本語 x\r\n\x0bshared line\x0c", "en", "u", 40),
    (8, "one two three", "en", "s", 13), (9, "ONE two\tthree", "en", "s", 13),
    *[(20 + i, f"Shared line\nOnly {i}\n  shared line", "en", "s", 30) for i in range(9)],
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and a column that clashes with inner names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumn("class", F.lit("x")).withColumn("words", F.lit(1)).withColumn("key", F.lit(None).cast("string")).repartition(4)


@pytest.fixture(scope="session")
def texts():
    return {i: t or "" for i, t, *_ in ROWS if i is not None}
