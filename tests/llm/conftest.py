import duckdb
import pytest

from tlake.llm.common import checkpoint_folder

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def folder(spark):
    checkpoint_folder(spark)


@pytest.fixture(scope="session")
def rows():
    def read(name: str, columns: str) -> list[tuple]:
        return duckdb.connect().execute(f"select {columns} from '{SMALL}/{name}.parquet'").fetchall()

    return read


@pytest.fixture
def odd_docs(spark):
    """Null ids and texts, empty and blank texts, a long text, repeated rows, ties, and columns with clashing names."""
    long = "the long text of one word after another " * 4000
    data = [
        (1, "one two three four five six", "en", "a", 0.5, "k"),
        (1, "one two three four five six", "en", "a", 0.5, "k"),
        (2, "One two THREE four five six", "en", "b", 0.5, "k"),
        (None, "one two three four five six", None, "b", 0.5, "k"),
        (3, None, "de", "b", None, None),
        (4, "", None, "c", 0.1, "k"),
        (5, " \t\n ", "en", "c", 0.1, "k"),
        (6, long, "en", "c", 0.1, "k"),
        (7, "a<|endoftext|>b \x1c\x1d 日本 ﬁ é́ it's 12²", "en", "c", 0.1, "k"),
        (8, "one two", "en", "c", 0.1, "k"),
    ]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score double, key string")
