"""Large inputs are dealt over tasks by their rows: the results are those of the plan for small ones."""

import pytest
from pyspark.sql import functions as F

from tastelake import session
from tastelake.operators import features, pit, ranking, rolling
from tastelake.plans import training
from tastelake.streaming import replay
from tests.conftest import rows

MONTH = 30 * 86_400


@pytest.fixture()
def many(spark):
    """48 ratings, among them a busy user and a busy movie, and rows without a user, movie, rating or time."""
    values = [(None if i % 17 == 16 else i % 5 * (i % 2), None if i % 19 == 18 else i % 7 % 4, None if i % 13 == 12 else (i % 10 + 1) / 2,
               None if i % 23 == 22 else 1_000_000 + i * 11 % 48 * MONTH) for i in range(48)]
    return spark.createDataFrame(values, "user_id long, movie_id long, rating double, timestamp long")


def both(monkeypatch, run, tasks):
    """Rows by the plan for few rows and by the one for many, which has ``tasks`` tasks."""
    few = rows(run())
    monkeypatch.setattr(session, "TASK_ROWS", 2)
    dealt = run()
    assert dealt.rdd.getNumPartitions() == tasks
    return few, rows(dealt)


def test_dealt(spark, monkeypatch):
    df = spark.range(100).toDF("a")
    assert session.dealt(df, 100, "a") is df
    monkeypatch.setattr(session, "TASK_ROWS", 9)
    got = session.dealt(df, 100, "a")
    assert got.rdd.getNumPartitions() == 12 and rows(got) == rows(df)


def test_genre_affinity_of_many_rows(monkeypatch, many, movies):
    few, dealt = both(monkeypatch, lambda: rolling.genre_affinity(many, movies), 24)
    assert few == dealt and len(few) > 10


def test_histories_of_many_rows(monkeypatch, many, movies):
    few, dealt = both(monkeypatch, lambda: features.user_history(many, movies), 24)
    assert few == dealt and max(r[-1] for r in few) == 4  # genres seen so far
    monkeypatch.setattr(session, "TASK_ROWS", 250_000)
    few, dealt = both(monkeypatch, lambda: features.movie_history(many, movies), 24)
    assert few == dealt


def test_training_set_of_many_rows(monkeypatch, many, movies):
    def training_set():
        return training.training_set(many, training.history_sources(many, movies))

    held = []
    monkeypatch.setattr(pit, "dealt", lambda df, n, *keys: (held.append((n, keys)), session.dealt(df, n, *keys))[1])
    few = rows(training_set())
    monkeypatch.setattr(session, "TASK_ROWS", 2)
    assert few == rows(training_set()) and len(few) == 48
    assert [keys for _, keys in held] == 2 * [("user_id",), ("movie_id",), ("user_id", "movie_id")]
    assert all(n > 48 for n, _ in held)  # entity and feature rows


def test_ordered_replay_moves_rows_before_they_become_lines(spark, monkeypatch, many, tmp_path):
    plans, seen, path = [], [], str(tmp_path / "ordered")
    as_lines = replay.events.to_event_json
    monkeypatch.setattr(replay.events, "to_event_json", lambda df: (plans.append(df), as_lines(df))[1])

    def deliver(df, chunk):
        plans.append(df)
        seen.extend(r["pos"] for r in df.collect())

    monkeypatch.setattr(session, "TASK_ROWS", 2)
    total = replay.write_ordered_replay(many, path, chunks=3)
    replay.play_ordered(spark, path, deliver, str(tmp_path / "checkpoint")).awaitTermination()
    assert total == many.filter("timestamp IS NOT NULL").count() and seen == list(range(total))
    # the borders are computed, so no pass samples them; 46 rows are placed in 23 tasks, those of a chunk in 8
    texts = [p._jdf.queryExecution().optimizedPlan().toString() for p in plans]
    assert len(plans) == 4 and not any("RepartitionByExpression [pos" in t for t in texts)
    assert [p.rdd.getNumPartitions() for p in plans] == [23, 8, 8, 8]


def test_ranker_rows_of_a_task_do_not_grow(spark, monkeypatch):
    df = spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias(ranking.LABEL))
    tasks = []
    monkeypatch.setattr(ranking, "dealt", lambda *a: (tasks.append(session.dealt(*a)), tasks[-1])[1])
    monkeypatch.setattr(session, "TASK_ROWS", 5)
    assert ranking.Ranker(num_rounds=1).fit(df, df, ["a"]).predict(df).count() == 60
    assert [t.rdd.getNumPartitions() for t in tasks] == [12, 12]


def test_a_table_leaves_no_shuffle_files(spark):
    """They stayed until the driver's garbage was collected, beside those of the steps that follow."""
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(session.CLEANUP_CONF, None)
    table = session.materialise(spark.range(5_000).groupBy((F.col("id") % 700).alias("k")).agg(F.sum("id").alias("s")), "sums")
    assert not files() - before and table.count() == 700
    assert spark.conf.get(session.CLEANUP_CONF, None) == setting


def test_training_set_in_turns(spark, monkeypatch, many, movies):
    """A large frame: the views of one key are joined for a part of its values at a time; the shuffle files of all joins stood side by side."""
    sources = training.history_sources(many, movies)
    few = training.training_set(many, sources)
    monkeypatch.setattr(pit, "TURN_ROWS", 20)
    parts, own = [], pit.materialise_in_turn
    monkeypatch.setattr(pit, "materialise_in_turn", lambda frames, name: (parts.append(len(frames)), own(frames, name))[1])
    turns = training.training_set(many, sources)
    assert turns.columns == few.columns and rows(turns) == rows(few) and turns.count() == 48
    assert len(parts) == 2 and min(parts) > 2  # users and pairs, then movies
    assert "Exchange" not in turns._jdf.queryExecution().executedPlan().toString()
    assert [[view.name for view, *_ in group] for _, group in pit._side_by_side(sources)] == [["user_stats", "interactions"], ["movie_stats"]]
    hot = training.training_set(many, sources, hot_rows=3)
    assert rows(hot) == rows(few)


def test_views_without_a_common_key_are_joined_alone(spark, monkeypatch):
    from tastelake.sources.catalog import Entity, FeatureView
    from pyspark.sql import types as T

    def source(name, key, shift):
        schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("x", T.LongType()), T.StructField("event_timestamp", T.LongType())])
        return FeatureView(name, (Entity(key, (key,)),), schema), spark.createDataFrame([(i % 4, i + shift, i) for i in range(20)], schema)

    sources = [source("v", "a", 0), source("w", "b", 100), source("u", "a", 200)]
    entities = spark.createDataFrame([(i % 5, i % 3 if i % 7 else None, i) for i in range(30)], "a long, b long, event_timestamp long")
    few = pit.historical_features(entities, sources)
    monkeypatch.setattr(pit, "TURN_ROWS", 10)
    turns = pit.historical_features(entities, sources)
    assert turns.columns == few.columns == ["a", "b", "event_timestamp", "v__x", "w__x", "u__x"] and rows(turns) == rows(few)
