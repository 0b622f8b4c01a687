import pytest

import __spark_entry__
from tests import oracle
from trellica.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    oracle.check(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], oracle.SMALL)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, oracle.SMALL).count() > 0


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.where("verification_status <> 'full'").count() == 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
