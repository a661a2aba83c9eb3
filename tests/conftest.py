import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", "tessera-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(params=["one task", "blocks"])
def either(spark, request):
    """Run a test with plain windows and with range-partitioned blocks."""
    if request.param == "blocks":
        spark.conf.set("tessera.task.rows", "7")
    yield spark
    spark.conf.unset("tessera.task.rows")
