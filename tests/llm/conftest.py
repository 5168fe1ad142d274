import pytest


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


TEXTS = {
    0: "The quick brown fox jumps over the lazy dog and runs away from the hunters in the dark forest tonight",
    1: "The quick brown fox jumps over the lazy dog and runs away from the hunters in the dark forest tonight",
    2: "the quick brown fox jumps over the lazy dog and runs away from the hunters in the dark forest tonight again",
    3: "", 4: None, 5: "   \n\t ", 6: "one", 7: "One", 8: "Ünï çødé wörds and 漢字 in a text that has nothing to do with any of the others here",
    9: "word " * 30_000, 10: "x" * 200_000, 11: "a|b # c\n\na|b # c\nother line\n",
}


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in any column, empty and very long texts, equal texts and repeated rows, and extra columns named like results."""
    rows = [(k, t, ["en", None][k % 2], [None, "", "src0", "src1"][k % 4], "x") for k, t in TEXTS.items()]
    rows += [(None, TEXTS[0], "en", "src0", "x"), (None, TEXTS[8], None, None, None), rows[8], rows[8]]
    schema = "doc_id long, text string, lang string, source string, score string"
    return spark.createDataFrame(rows, schema).selectExpr("*", "score kept", "score shard", "score slot", "score n_words", "score copies", "score items")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
