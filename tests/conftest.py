import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cartflow.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixture_tables(spark):
    """The hand-made fixture of FIXTURES.md §4."""
    from cartflow.sources import schemas
    orders = spark.createDataFrame(
        [(11, 1, "prior", 1), (12, 1, "prior", 2), (13, 1, "prior", 3), (14, 1, "train", 4),
         (21, 2, "prior", 1), (22, 2, "prior", 2), (23, 2, "test", 3),
         (31, 3, "test", 1)], schemas.ORDERS)
    prior = spark.createDataFrame(
        [(11, 100, 0), (11, 200, 0), (12, 100, 1), (13, 100, 1), (13, 300, 0),
         (21, 100, 0), (21, 300, 0), (22, 300, 1)], schemas.ORDER_LINES)
    train = spark.createDataFrame([(14, 100, 1), (14, 400, 0)], schemas.ORDER_LINES)
    return {"orders": orders, "prior_lines": prior, "train_lines": train}
