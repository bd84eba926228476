import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from chatlens.session import local_session
    wh = tempfile.mkdtemp(prefix="chatlens-tests-wh-")   # tests only; clusters use their own
    s = local_session("*", shuffle_partitions=8, app="chatlens-tests",
                      extra_conf={"spark.sql.warehouse.dir": wh})
    yield s


@pytest.fixture(scope="session")
def small(spark):
    from chatlens.sources.fixtures import chat_tables
    return chat_tables(spark, SF_SMALL)


@pytest.fixture(scope="session")
def mid(spark):
    from chatlens.sources.fixtures import chat_tables
    return chat_tables(spark, SF_MID)


def rows(df, order=None):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=repr) if order is None else out
