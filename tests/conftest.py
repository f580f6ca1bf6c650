import pytest

from corvid.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark(4, "corvid-tests", **{"spark.sql.shuffle.partitions": "4"})
