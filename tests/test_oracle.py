"""Every query with reference SQL, compared as typed multisets of rows."""

import pytest

from compare import difference, duck
from conftest import SMALL
from creditloom.plans import PLANS, SQL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert difference(PLANS[name], SQL[name], spark, con, SMALL) is None


def test_sql_belongs_to_plans():
    assert set(SQL) <= set(PLANS)
    assert set(PLANS) - set(SQL) == {"ml_tfidf_lr", "ml_gbt", "ml_cv"}
