import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", memory="8g", shuffle_partitions=4)


@pytest.fixture
def frame(spark):
    """Build a DataFrame from a dict of columns and a schema string."""

    def build(columns, schema):
        return spark.createDataFrame(list(zip(*columns.values())), schema)

    return build
