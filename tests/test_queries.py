"""Every query of the reference's operators against its SQL on the smallest tables; those without SQL must run."""

import pytest

from driftloom.plans import QUERIES, SQL

from .oracle import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert differences(spark, SMALL, QUERIES[name], SQL[name]) == []
    else:
        assert QUERIES[name](spark, SMALL).count() >= 0
