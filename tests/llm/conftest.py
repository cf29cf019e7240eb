import pytest
from pyspark.sql import SparkSession

from lectern.session import prepare


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return prepare(session)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls, empty and long texts, ties and repeated rows, and a column that clashes with operators' own."""
    long = " ".join(f"word{i % 700}" for i in range(30_000))
    rows = [(1, "", "a", 1), (2, None, "a", 2), (None, "no id here at all", None, 3), (3, long, "b", 4), (4, "x y z", "a", 5), (4, "x y z", "a", 5), (5, "X y  Z", None, 6), (6, "idiot " * 3 + "the text goes on", "b", None), (7, " \n\t ", "a", 8), (8, "été ñandú 漢字 🙂 l'été", "c", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 1), (4, 0, 0), (4, 0, 0), (8, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
