import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))

#: Nulls in any column, empty and very long texts, ties and repeated rows.
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n\n ", "de", "b", 5),
    (5, LONG, "en", None, 1),
    (6, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 10),
    (6, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 10),
    (None, "a row without an id", "en", "c", 3),
    (7, LONG, "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Hard documents, with extra columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    extra = ("key", "role", "fp", "rep", "id", "row", "th", "size", "h", "n", "base", "label", "component_id")
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text) rows as a table of documents."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)

    return make
