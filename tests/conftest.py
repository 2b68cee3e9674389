import datetime as dt

import pytest

from offerwise.params import Params
from offerwise.session import carry_code, local_session

NOW = dt.datetime(2026, 8, 19, 15, 0, 0)


@pytest.fixture(scope="session")
def spark():
    carry_code()
    session = local_session("tests", 8, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def params():
    return Params(now=NOW)


def ago(**amount):
    return NOW - dt.timedelta(**amount)
