"""Every registered query against its SQL, and against itself at another number of partitions."""

import pytest
from conftest import DATA
from oracle import check

from millrace import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(plans.QUERIES[name](spark, DATA), plans.ORACLE_SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["leader_clusters", "char_budget_chunks", "merge_fold", "secret_redact"])
def test_partitions_do_not_matter(spark, name):
    f = lambda: sorted(map(str, plans.QUERIES[name](spark, DATA).collect()))
    one = f()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert f() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
