"""Every registered query against its SQL on the smallest scale."""

import os

import pytest

import __spark_entry__ as contract
from tastelake.plans import oracle as own_sql, queries as own
from tests.compare import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data absent")
QUERIES, SQL = own.registry(), own_sql.sql()
ROWS_ONLY = {"svd_topn", "svd_rmse", "recommend_topk", "feature_importance"}


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_DIR)


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_only_models_lack_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, oracle, name):
    assert compare(QUERIES[name](spark, SF_DIR).toPandas(), oracle.execute(SQL[name]).df()) is None


def test_svd_lists(spark):
    got = QUERIES["svd_topn"](spark, SF_DIR).toPandas()
    assert (got.groupby("user_id")["rank"].max() == 100).all()
    assert not got.duplicated(["user_id", "movie_id"]).any()
    ordered = got.sort_values(["user_id", "rank"])
    assert (ordered.groupby("user_id")["score"].diff().dropna() <= 0).all()


def test_entry(spark):
    got = contract.entry(spark).toPandas()
    assert list(got.columns) == ["user_id", "movie_id", "rank", "title", "genres", "score"]
    assert (got.groupby("user_id").size() == 10).all() and got["user_id"].nunique() == 150
