import pytest

from delspan.plans.oracles import ORACLES
from delspan.plans.queries import QUERIES
from tests.compare import SF, assert_same

ROWS_ONLY = {"refined_boundaries", "refined_dataset_job", "deletion_candidates", "pca_context", "fitted_classifier"}


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
