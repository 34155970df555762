import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column function over literal inputs: ``one(function, *values)``."""
    from pyspark.sql import functions as F

    def run(function, *values):
        columns = [F.lit(v) if v is not None else F.lit(None).cast("string") for v in values]
        return spark.range(1).select(function(*columns).alias("v")).first().v

    return run
