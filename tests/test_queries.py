"""Every query against its SQL, and the queries SQL cannot answer by their properties."""

import pytest
from pyspark.sql import functions as F

from compare import difference, duck
from conftest import SF_SMALL
from quorum.checks.oracle import ORACLE
from quorum.checks.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_SMALL), con, ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_regressions_tell_more_than_the_commoner_class(spark):
    for name in ("lr_predict", "bagging_trio", "stacking_trio"):
        scored = QUERIES[name](spark, SF_SMALL).cache()
        commoner = scored.groupBy("label").count().agg(F.max("count")).first()[0]
        assert scored.filter("prediction = label").count() > commoner
        assert scored.select("prediction").distinct().count() == 2
        scored.unpersist()
