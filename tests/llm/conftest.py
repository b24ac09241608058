import pytest

from clearwell.llm.common import _HELD_ROWS


@pytest.fixture(scope="session", autouse=True)
def first_batches(spark):
    return {name: spark.conf.get(name) for name in _HELD_ROWS}


@pytest.fixture(autouse=True)
def batches_as_at_first(spark, first_batches):
    """A stage of the pipeline leaves its session with small batches; the next test starts without them."""
    for name, value in first_batches.items():
        spark.conf.set(name, value)
