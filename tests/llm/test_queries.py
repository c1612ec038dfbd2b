"""The registered queries of the training-data operators on the smallest scale."""

import os

import pytest

from tastelake.llm import oracle as sql_of, queries
from tests.compare import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data absent")


@pytest.mark.parametrize("name", sorted(sql_of.sql()))
def test_query(spark, name):
    assert compare(queries.registry()[name](spark, SF_DIR).toPandas(), oracle_connection(SF_DIR).execute(sql_of.sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(queries.registry()) - set(sql_of.sql()) - {"op12_embedding_whitening", "op13_html_text"}))
def test_one_row_per_document(spark, name):
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect())
    got = sorted(r["doc_id"] for r in queries.registry()[name](spark, SF_DIR).select("doc_id").collect())
    assert (sorted(set(got)) if name.startswith("op7") else got) == ids


def test_rows_of_vectors_and_pages(spark):
    count = lambda table: spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    whitened = queries.registry()["op12_embedding_whitening"](spark, SF_DIR)
    assert dict(whitened.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                     "explained": "double", "identity_error": "double"}
    assert whitened.count() == 16 * count("embeddings") and queries.registry()["op13_html_text"](spark, SF_DIR).count() == count("pages")
