"""Every query against its SQL."""

import pytest

from plumbline.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    compare(spark, SF, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["pli", "mae", "rmse", "rmsle", "r2"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
