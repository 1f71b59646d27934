"""Every query of the engine that SQL can express gives the rows of its SQL."""

import pytest

from oracle import differences
from recengine import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert not differences(spark, SF, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_flagship_numbers(spark):
    import __spark_entry__

    r = {x.k: x for x in __spark_entry__.entry(spark).collect()}[10]
    assert (r.users, round(r.recall, 6), round(r.ndcg, 6)) == (15, 0.098889, 0.081461)
