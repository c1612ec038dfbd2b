import pytest
from pyspark.sql import functions as F

from tastelake import schemas
from tastelake.operators import lookup
from tastelake.plans import feature_generation, training
from tastelake.session import materialise, shared_folder
from tastelake.sources import catalog, events, runs, tables, versions
from tests.conftest import rows


def test_csv_scans(spark, tmp_path):
    (tmp_path / "r.csv").write_text(" userId , movieId, rating ,timestamp\n1,10,4.5,964982703\n2,11,3,5\n")
    (tmp_path / "m.csv").write_text('movieId,title,genres\n10,"Toys, The ""Great"" (1995)",A|B\n')
    r = tables.read_ratings(spark, str(tmp_path / "r.csv"))
    assert r.schema == schemas.RATINGS and rows(r) == [(1, 10, 4.5, 964982703), (2, 11, 3.0, 5)]
    assert rows(tables.read_movies(spark, str(tmp_path / "m.csv"))) == [(10, 'Toys, The "Great" (1995)', "A|B")]


def test_missing_files(spark, tmp_path):
    assert tables.read_movies(spark, str(tmp_path / "none.csv")).schema == schemas.MOVIES
    assert tables.read_features(spark, str(tmp_path), catalog.USER_STATS).count() == 0
    with pytest.raises(Exception):
        tables.read_ratings(spark, str(tmp_path / "none.csv"))


def test_feature_tables_keep_earlier_snapshots(spark, ratings, movies, tmp_path):
    root, day = str(tmp_path), lambda d: F.timestamp_seconds(F.lit(d * 86_400 + 5))
    for d in (1, 2, 2):
        feature_generation.generate_features(ratings, movies, root, day(d))
    for view, n in ((catalog.USER_STATS, 3), (catalog.MOVIE_STATS, 4), (catalog.INTERACTIONS, 10)):
        df = tables.read_features(spark, root, view, all_dates=True)
        assert df.drop("as_of").schema == view.schema
        assert rows(df.groupBy("as_of").count(), "count") == [(n,), (n,)]
        newest = tables.read_features(spark, root, view)
        assert newest.count() == n and newest.filter("as_of <> '1970-01-03'").count() == 0
    latest = lookup.latest_per_key(tables.read_features(spark, root, catalog.USER_STATS, all_dates=True), ["user_id"])
    assert latest.count() == 3 and latest.filter("as_of <> '1970-01-03'").count() == 0
    tables.write_online(spark, root, catalog.MOVIE_STATS, str(tmp_path / "online"))
    online = tables.read_online(spark, str(tmp_path / "online"), catalog.MOVIE_STATS)
    assert online.count() == 4 and rows(online.select(F.unix_seconds("event_timestamp")).distinct()) == [(2 * 86_400 + 5,)]


def test_a_table_is_replaced_as_a_whole(spark, tmp_path):
    path, df = str(tmp_path / "t"), lambda v: spark.range(5).selectExpr("id", f"{v} v")
    read = lambda: versions.read_version(spark, path, df(0).schema)
    assert read().count() == 0
    assert versions.write_version(df(1), path) == 0
    old = read()
    broken = df(2).withColumn("v", F.when(F.col("id") == 4, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        versions.write_version(broken, path)
    assert rows(read(), "v") == [(1,)] * 5
    df(3).write.parquet(f"{path}/slot-1", mode="overwrite")  # rows complete, the writer ended before the mark
    assert rows(read(), "v") == [(1,)] * 5
    versions.write_version(df(4), path)
    versions.write_version(read().withColumn("v", F.col("v") + 1), path)
    assert rows(old, "v") == [(1,)] * 5 and rows(read(), "v") == [(5,)] * 5  # a reader keeps its version
    for v in range(6, 12):
        versions.write_version(df(v), path)
    assert rows(read(), "v") == [(11,)] * 5 and len(list((tmp_path / "t").iterdir())) == 2 * versions.SLOTS
    assert versions.write_version(df(99), path, version=3) == 3 and rows(read(), "v") == [(11,)] * 5


def test_snapshots_are_replaced_as_a_whole(spark, tmp_path):
    view, root = catalog.USER_STATS, str(tmp_path)
    stats = lambda days, mean: spark.createDataFrame([(1, d * 86_400, mean) for d in days], "user_id long, s long, avg_rating double").select(
        "user_id", "avg_rating", F.timestamp_seconds("s").alias("event_timestamp"), *[F.lit(None).alias(c) for c in view.schema.names if c not in (
            "user_id", "avg_rating", "event_timestamp")])
    seen = lambda: rows(tables.read_features(spark, root, view, all_dates=True), "as_of", "avg_rating")
    tables.write_features(stats([1, 2], 1.0), root, view)
    first, old = seen(), tables.read_features(spark, root, view)
    broken = stats([1, 2], 2.0).withColumn("avg_rating", F.when(F.dayofmonth("event_timestamp") == 3, F.raise_error(F.lit("lost")).cast("double")).otherwise(2.0))
    with pytest.raises(Exception, match="lost"):
        tables.write_features(broken, root, view)
    assert seen() == first
    for mean in (2.0, 3.0):
        tables.write_features(stats([2], mean), root, view)
        assert [m for _, m in seen()] == [1.0, mean] and rows(old, "avg_rating") == [(1.0,)]
    tables.write_features(stats([], 0.0), root, view)
    assert [m for _, m in seen()] == [1.0, 3.0]


def test_catalog(spark):
    views = {r["name"]: r for r in catalog.list_views(spark, "/x").collect()}
    assert set(views) == {"user_stats", "movie_stats", "interactions"}
    assert views["interactions"]["keys"] == ["user_id", "movie_id"] and views["user_stats"]["path"] == "/x/user_stats"
    assert catalog.USER_STATS.feature_names == ("avg_rating", "rating_count", "rating_stddev", "unique_genres_rated")
    assert rows(catalog.list_entities(spark), "name") == [("movie",), ("user",)]


def test_lookups(spark):
    f = spark.createDataFrame([(1, 4.0, 10, None), (2, 3.0, 5, 0.5)], "user_id long, avg_rating double, rating_count int, rating_stddev double")
    ids = spark.createDataFrame([(1,), (1,), (2,), (9,)], "user_id long")
    assert lookup.batch_lookup(f, ids, "user_id").count() == 2
    assert lookup.batch_lookup(f, ids.limit(0), "user_id").count() == 0
    assert rows(lookup.point_lookup(f, "user_id", 1, ["avg_rating", "rating_count"])) == [(1, 4.0, 10.0)]
    assert lookup.point_lookup(f, "user_id", 9, ["avg_rating"]).count() == 0
    online = f.filter("user_id = 1").withColumn("avg_rating", F.lit(4.5))
    assert rows(lookup.online_offline_lookup(ids, online, f, "user_id", lookup.STATS_FIELDS)) == [
        (1, "online", 4.5, 10.0, 0.0), (2, "offline", 3.0, 5.0, 0.5)]


def test_latest_prefers_the_later_creation(spark):
    df = spark.createDataFrame([(1, "a", 10, 1), (1, "b", 10, 2), (1, "c", 9, 3)], "k long, v string, event_timestamp long, created_timestamp long")
    assert rows(lookup.latest_per_key(df, ["k"]), "v") == [("b",)]


def test_publish_outcomes(spark, tmp_path):
    df = spark.createDataFrame([("x",)], "value string")
    sent, logged = str(tmp_path / "sent"), str(tmp_path / "logged")
    assert events.publish(df, lambda d: events.write_lines(d, sent), logged) == "published"
    no_connector = lambda d: events.write_topic(d, "nowhere:1")
    assert events.publish(df, no_connector, logged) == "logged"
    assert events.publish(df, no_connector, logged) == "logged"  # a second try replaces the lines

    def refuses(lines):
        raise events.SendRefused

    assert events.publish(df, refuses, logged) == "failed"
    with pytest.raises(KeyError):
        events.publish(df, lambda d: {}["a bug"], logged)
    assert spark.read.text(sent).count() == spark.read.text(logged).count() == 1


def test_materialise_uses_the_shared_folder(spark, ratings):
    df = materialise(ratings, "x")
    assert all(shared_folder(spark) in f for f in df.inputFiles()) and rows(df) == rows(ratings)


def test_training_job(spark, movies, tmp_path):
    from tastelake.operators.factors import FactorModel
    from tastelake.operators.ranking import Ranker
    day = 86_400
    data = [(u, m, 0.5 + (u * m) % 10 / 2, (40 * u + 3 * m) * day) for u in range(1, 13) for m in range(1, 9)]
    ratings = spark.createDataFrame(data, "user_id long, movie_id long, rating double, timestamp long")
    root = str(tmp_path)
    result = training.train(ratings, movies, root, svd_n_factors=3, num_rounds=3, early_stopping_rounds=2)
    assert list(result) == ["svd_rmse", "svd_train_time", "val_rmse", "val_mae", "ranker_train_time", "n_train_rows",
                            "n_val_rows", "n_features", "svd_model_path", "ranker_model_path"]
    complete = spark.read.parquet(f"{root}/training_data").dropna().count()
    assert result["n_train_rows"] == int(complete * 0.8) and result["n_train_rows"] + result["n_val_rows"] == complete
    kinds = dict(runs.read_runs(spark, f"{root}/runs").groupBy("kind").count().collect())
    assert kinds == {"param": 14, "metric": 5 + 12, "artifact": 3, "tag": 3}
    assert FactorModel.load(spark, result["svd_model_path"]).n_factors == 3
    assert Ranker.load(spark, result["ranker_model_path"]).feature_names[0] == "user_stats__avg_rating"
