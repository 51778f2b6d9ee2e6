import pytest

from tessera.runtime import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "4")
    yield s
    s.stop()
