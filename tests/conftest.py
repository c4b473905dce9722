import pytest

from fotomill.session import get_spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def sf():
    return SF
