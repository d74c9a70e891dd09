import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

LONG = "la mer et le ciel " * 6000
TEXTS = [None, "", "   ", "one", "Tides rise and tides fall", "Tides rise and tides fall", LONG, "naïve café 東京 🙂 \x1f x", "a b c d e f g h i j", "!!! ... 123"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empties, a long text, repeated rows and ids, and columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "web", i) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id", "en", "web", 0), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    for name in ("r", "o", "c", "key", "row", "fp", "size", "rank", "item", "t", "score"):
        d = d.withColumn(name, F.lit(7))
    return d


@pytest.fixture(scope="module")
def empty(documents):
    return documents.limit(0)
