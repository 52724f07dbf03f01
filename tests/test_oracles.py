import __spark_entry__ as entry
import pytest
from compare import connect, differ

from notelake import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_twin(spark, con, name):
    assert differ(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
