import pytest

from winnow.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def big(spark, monkeypatch):
    """Take the paths meant for tables of any size, whatever the size of the fixture."""
    from winnow.functions import keys, stats
    from winnow.operators import encode, sample

    spark.conf.set(stats.SMALL_BYTES_CONF, "-1")
    spark.conf.set("spark.winnow.plainJoinBytes", "-1")
    monkeypatch.setattr(keys, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(keys, "HOT_KEYS", 5)
    monkeypatch.setattr(encode, "ONE_TASK_VALUES", 0)
    monkeypatch.setattr(sample, "TAKE_LIMIT", 0)
    yield
    spark.conf.unset(stats.SMALL_BYTES_CONF)
    spark.conf.unset("spark.winnow.plainJoinBytes")
