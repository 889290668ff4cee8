import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "2g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True, scope="session")
def _workers_find_tests():
    """Functions of test modules are sent to workers by value."""
    import sys

    from pyspark import cloudpickle

    for name in [n for n in sys.modules if n.startswith("test_")]:
        cloudpickle.register_pickle_by_value(sys.modules[name])
