import pytest
from conftest_texts import IDS, SCHEMA, TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "d", 0, 0.5, 1, 2, 3, "m", "w") for i, t in zip(IDS, TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
