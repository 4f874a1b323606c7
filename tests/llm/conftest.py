import pytest


@pytest.fixture(scope="session")
def table(spark):
    """A DataFrame of rows, dealt over a few partitions."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)
    return make
