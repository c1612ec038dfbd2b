"""Queries on their own few rows: nothing is left out."""

from datetime import datetime

import pytest

from tastelake.plans import oracle, queries
from tests.compare import compare, oracle_connection

DAY = datetime(2024, 1, 5)


@pytest.fixture
def tables(spark, tmp_path):
    """Two customers and three parts; of four events one is rated 9 and one names a part by a number below 1."""
    events = [(0, DAY, 1, "view", 40.0, '{"k": 2}'), (1, DAY, 2, "view", 180.0, '{"k": 1}'),
              (2, DAY, 1, "click", 60.0, '{"k": 3}'), (3, DAY, 2, "click", 100.0, '{"k": 0}')]
    frames = {
        "events": (events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        "embeddings": ([(i, [0.5 * i, 1.0 - i], i) for i in range(4)], "vec_id long, embedding array<float>, label int"),
        "customer": ([(0,), (1,)], "c_custkey long"),
        "part": ([(i, f"thing {i}", "SMALL", 5) for i in range(3)], "p_partkey long, p_name string, p_type string, p_size int"),
        "orders": ([(10, 0, DAY), (11, 1, DAY)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "lineitem": ([(10, 0, 1, 12.0), (10, 1, 2, 48.0), (11, 2, 1, 3.0), (11, 0, 2, 33.0)],
                     "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double")}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_pair_predictions_of_all_events(spark, tables):
    vec = [(0.5 * i, 1.0 - i) for i in range(4)]
    pairs = [(1, 2, 2.0), (2, 1, 9.0), (1, 3, 3.0), (2, 0, 5.0)]
    mean = sum(r for *_, r in pairs) / len(pairs)
    squares = [(sum(x * y for x, y in zip(vec[u], vec[m])) + mean - r) ** 2 for u, m, r in pairs]
    got = queries.registry()["pair_predictions"](spark, tables).first()["rmse"]
    assert got == pytest.approx((sum(squares) / len(squares)) ** 0.5, abs=1e-6)


def test_ranker_metrics_of_all_events(spark, tables):
    got = queries.registry()["ranker_metrics"](spark, tables).toPandas()
    assert compare(got, oracle_connection(tables).execute(oracle.sql()["ranker_metrics"]).df()) is None
    # users' means 3.25 and 2.0; movies' means 2.5, 5.0 and 0.5; the movie 0 is unknown
    gaps = [5.0 + 0.1 * (3.25 - 5.0) - 2.0, 2.5 + 0.1 * (2.0 - 2.5) - 9.0, 0.5 + 0.1 * (3.25 - 0.5) - 3.0]
    assert got["mae"][0] == pytest.approx(sum(map(abs, gaps)) / 3, abs=1e-6)


def test_two_snapshots_share_one_table_of_ratings(spark, tables, monkeypatch):
    plans, generate = [], queries.feature_generation.generate_features
    monkeypatch.setattr(queries.feature_generation, "generate_features", lambda r, *a: (plans.append(r), generate(r, *a))[1])
    got = queries.registry()["lookup_after_two_snapshots"](spark, tables).toPandas()
    assert len(plans) == 2 and not any("Join" in p._jdf.queryExecution().analyzed().toString() for p in plans)
    assert sorted(got["avg_rating"]) == [2.0, 3.25]
