import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns that are called like helpers.
CLASH = ["__s", "__h", "__rank", "__row", "shard", "position", "k", "d", "u", "n", "id", "sig", "runs", "__runs", "__gone", "__language", "words", "score"]


@pytest.fixture(scope="session")
def edge_rows():
    prose = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, prose, "en", "a", 70), (1, prose, "en", "a", 70), (2, prose, "en", None, 70), (3, None, "en", "a", None), (4, "", None, "b", 0), (5, "  \n\t ", "fr", "b", 5),
        (None, prose + " again", "en", "a", 76), (6, long, "xx", "c", len(long)), (7, "one", "en", "c", 3), (8, "one", None, "c", 3), (9, prose + "\n" + prose, "en", None, 141), (10, "Ünïcödé ß 漢字 🙂", "de", "", 14),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, SCHEMA)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASH})


@pytest.fixture(scope="session")
def plain_edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
