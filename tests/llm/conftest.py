import pytest
from nasty import frame


@pytest.fixture(scope="session")
def nasty(spark, tmp_path_factory):
    """The awkward table, read from a file as a corpus would be."""
    path = str(tmp_path_factory.mktemp("nasty") / "documents.parquet")
    frame(spark).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    frame(spark, []).write.parquet(path)
    return spark.read.parquet(path)
