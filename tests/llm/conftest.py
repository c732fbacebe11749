import pytest
from texts import documents


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en" if d % 2 else None, f"s{d % 3}" if d != 4 else None, d, "x", 1) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, id long, part string, n long")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("1 = 0")
