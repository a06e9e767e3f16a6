import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside, or give to results.
CLASHING = ("row", "score", "predicted", "kept", "n_lines", "n_removed", "ids", "state", "n_tokens", "same", "n_encoded", "segment", "at", "hit", "key", "c0", "value", "id", "a", "b", "_ids", "after", "component", "language", "texts", "first", "hash")

LONG = " ".join(f"w{i % 977} x{i * 7919 % 10007}" for i in range(60_000))
PROSE = (
    "The river ran slowly past the old mill while the miller counted his sacks of grain and wondered aloud whether the autumn rain would "
    "come early again this year, as it had in the year when the bridge was swept away and nobody could reach the market town for weeks "
    "on end because the ferry had been sold"
)


def odd_rows():
    second = PROSE.replace("slowly", "quickly")
    return [
        (None, None, None, None, None),
        (None, PROSE, "en", "s", 1),
        (1, None, "en", "s", None),
        (2, "", "en", None, 0),
        (3, " \n\t \n", None, "s", 4),
        (4, "word", "en", "s", 4),
        (5, PROSE, "en", "s", 9),
        (5, PROSE, "en", "s", 9),
        (6, second, "de", "s", 9),
        (6, "another text under the same id", "de", "s", 9),
        (7, LONG, "en", "s", len(LONG)),
        (8, "a line\nanother line\na third line\n▁ \U0001f600 café\x00\r\nlast", "fr", "s", 9),
        (9, "no spaces at all".replace(" ", ""), "xx", "s", 9),
        (10, "same " * 300, "en", "s", 9),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, blank, long, repeated and clashing: every operator has to take these."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows(), COLUMNS)
    return docs.select("*", *(F.lit(i).alias(name) for i, name in enumerate(CLASHING)))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
