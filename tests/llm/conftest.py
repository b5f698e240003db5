import pytest

SF = "/root/testdata/sf0.001"

#: Nulls in each column, empty and long texts, ties and repeated rows.
EDGE = [
    (1, "the cat sat on the mat and it was good " * 30, "en", "a", 5),
    (2, None, "en", "a", 0),
    (3, "", None, None, 0),
    (None, "of the and to a in is that it for was on", "en", "b", 9),
    (4, "x" * 5000, "fr", "b", 5000),
    (4, "x" * 5000, "fr", "b", 5000),
    (5, " \t\n\x0b\f\r ", "xx", "c", 7),
    (6, "é\u00a0ü \u2003 ß\n\n \nab  cd ", "de", "c", 9),
    (7, "a b c d e f g h i a b c d e f g h j k l m n o p q r s t u v", "en", "d", 9),
    (8, "line one\nline one\n \nline two\nline one", "en", "d", 9),
    (9, "a" * 700 + " tail \U0001f600", "es", "e", 9),
    (10, "### *** $$$ %%% ### &&& ||| <<>> " * 12, "en", "e", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
