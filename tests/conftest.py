import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])


@pytest.fixture(scope="session")
def spark():
    from flowlens.session import get_session

    return get_session("local[8]", 4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
