import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from salesops.session import local_session
    s = local_session(4, app="salesops-tests", **{"spark.sql.shuffle.partitions": "4",
                                                  "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield s


@pytest.fixture(scope="session")
def fixtures(spark):
    from salesops.sources import cached_fixture_tables
    return cached_fixture_tables(spark, SF_SMALL)


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """The sf0.001 CRM tables written as parquet and read back with the schemas."""
    from salesops.sources import fixture_tables, read_tables, write_tables
    path = str(tmp_path_factory.mktemp("crm"))
    write_tables(fixture_tables(spark, SF_SMALL), path)
    return read_tables(spark, path)
