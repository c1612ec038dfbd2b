"""The registered queries: each reads the given tables and returns one DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastelake.functions.columns import epoch_micros, l2_normalised
from tastelake.operators import (chronology, events, explore, factors, features, lookup, monitor, ranking, recommend,
                                 retrieval, rolling)
from tastelake.plans import feature_generation, training, views
from tastelake.session import materialise, new_path
from tastelake.sources import catalog, tables
from tastelake.streaming import ingest, replay, rolling as stream_rolling

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

# parameters of the registered runs
AS_OF = 1_700_000_000
SNAPSHOT_FROM = 915_148_800   # 1999-01-01: online history starts here in the lookup queries
HEAD_EVENTS = 1_000
SVD_FACTORS = 50
RANKER_ROUNDS = 200


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _plain_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ratings(spark, sf_dir).select("user_id", "movie_id", "rating", "timestamp")


# feature tables -----------------------------------------------------------------------------

@query
def user_stats(spark, sf_dir):
    df = features.user_stats(views.ratings(spark, sf_dir), views.movies(spark, sf_dir))
    return _rounded(df, "avg_rating", "rating_stddev")


@query
def movie_stats(spark, sf_dir):
    df = features.movie_stats(views.ratings(spark, sf_dir), views.movies(spark, sf_dir))
    return _rounded(df, "avg_rating", "rating_stddev")


@query
def user_unique_genres(spark, sf_dir):
    return features.unique_genres(views.ratings(spark, sf_dir), views.movies(spark, sf_dir))


@query
def interactions(spark, sf_dir):
    df = features.stamped(features.interactions(views.ratings(spark, sf_dir)), F.timestamp_seconds(F.lit(AS_OF)))
    return df.select("user_id", "movie_id", F.col("rating").cast("double").alias("rating"), "timestamp",
                     F.unix_seconds("event_timestamp").alias("event_time"))


@query
def user_stats_history(spark, sf_dir):
    df = features.user_history(materialise(_plain_ratings(spark, sf_dir), "ratings"), views.movies(spark, sf_dir))
    return _rounded(df, "avg_rating", "rating_stddev")


@query
def csv_scan(spark, sf_dir):
    """Ratings and movies written as CSV with padded headers, read back and joined."""
    root = new_path(spark, "csv")
    r = _plain_ratings(spark, sf_dir)
    r.toDF(" userId", "movieId ", " rating", "timestamp ").write.option("header", True).csv(f"{root}/ratings")
    m = views.movies(spark, sf_dir).toDF("movieId", "title", "genres")
    m.write.option("header", True).csv(f"{root}/movies")
    back = tables.read_ratings(spark, f"{root}/ratings")
    return back.join(tables.read_movies(spark, f"{root}/movies"), "movie_id").select(
        "user_id", "movie_id", "rating", "timestamp", "title", "genres")


@query
def feature_tables(spark, sf_dir):
    """The generated tables as read back from Parquet, one row per table and key."""
    root = new_path(spark, "features")
    feature_generation.generate_features(
        views.ratings(spark, sf_dir), views.movies(spark, sf_dir), root, F.timestamp_seconds(F.lit(AS_OF)))
    out = None
    for view, key in ((catalog.USER_STATS, "user_id"), (catalog.MOVIE_STATS, "movie_id")):
        df = tables.read_features(spark, root, view)
        part = df.select(
            F.lit(view.name).alias("view"), F.col(key).alias("key"),
            F.round(F.col("avg_rating").cast("double"), 4).alias("avg_rating"),
            F.col("rating_count").cast("long").alias("rating_count"),
            F.round(F.col("rating_stddev").cast("double"), 4).alias("rating_stddev"),
            F.unix_seconds("event_timestamp").alias("event_time"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def lookup_after_two_snapshots(spark, sf_dir):
    """One row per customer from the newest of two snapshots."""
    root = new_path(spark, "snapshots")
    r, m = materialise(_plain_ratings(spark, sf_dir), "ratings"), views.movies(spark, sf_dir)
    for as_of in (AS_OF - 86_400, AS_OF):
        feature_generation.generate_features(r, m, root, F.timestamp_seconds(F.lit(as_of)))
    found = lookup.batch_lookup(tables.read_features(spark, root, catalog.USER_STATS), views.users(spark, sf_dir), "user_id")
    return found.select("user_id", F.round(F.col("avg_rating").cast("double"), 4).alias("avg_rating"),
                        F.col("rating_count").cast("long").alias("rating_count"), F.unix_seconds("event_timestamp").alias("event_time"))


@query
def prereq_report(spark, sf_dir):
    r, m = views.ratings(spark, sf_dir), views.movies(spark, sf_dir)
    frames = {view.name: df for view, df in feature_generation.feature_frames(r, m)}
    return explore.prerequisite_report(r, frames)


# exploration --------------------------------------------------------------------------------

@query
def dataset_overview(spark, sf_dir):
    return _rounded(explore.dataset_overview(views.ratings(spark, sf_dir)), "sparsity_pct")


@query
def rating_distribution(spark, sf_dir):
    return explore.rating_distribution(views.ratings(spark, sf_dir))


@query
def rating_moments(spark, sf_dir):
    return _rounded(explore.rating_moments(views.ratings(spark, sf_dir)), "mean_rating", "std_rating")


@query
def activity_per_user(spark, sf_dir):
    return _rounded(explore.activity_per_user(views.ratings(spark, sf_dir)), "mean_n", "few_pct")


@query
def activity_per_movie(spark, sf_dir):
    return _rounded(explore.activity_per_movie(views.ratings(spark, sf_dir)), "mean_n")


@query
def genre_breakdown(spark, sf_dir):
    return explore.genre_breakdown(views.movies(spark, sf_dir))


# training set -------------------------------------------------------------------------------

def _training_set(spark, sf_dir) -> DataFrame:
    r = materialise(_plain_ratings(spark, sf_dir), "ratings")
    return training.training_set(r, training.history_sources(r, views.movies(spark, sf_dir)))


_STATS = ["user_stats__avg_rating", "user_stats__rating_stddev", "movie_stats__avg_rating", "movie_stats__rating_stddev"]


@query
def pit_training_set(spark, sf_dir):
    return _rounded(_training_set(spark, sf_dir), *_STATS)


@query
def training_features(spark, sf_dir):
    """Complete rows with the derived features, with the leaking form beside the default one."""
    snapshot = tables.write_snapshot(_training_set(spark, sf_dir), new_path(spark, "training"))
    leaking = ranking.training_features(snapshot, "reference").select(
        "*", F.col("user_deviation").alias("user_deviation_reference"))
    derived = ranking.training_features(leaking, max_ts=snapshot.agg(F.max("interactions__timestamp")).scalar())
    kept = ranking.drop_incomplete(derived)
    cols = ["user_deviation", "user_deviation_reference", "movie_popularity_log", "user_activity_log", "recency_days"]
    return _rounded(kept.select("user_id", "movie_id", "event_timestamp", "genre_count", *cols), *cols)


@query
def time_split(spark, sf_dir):
    return chronology.time_split(_plain_ratings(spark, sf_dir))


# lookups ------------------------------------------------------------------------------------

def _event_users(spark, sf_dir) -> DataFrame:
    return views.rating_events(spark, sf_dir).select("user_id").distinct()


@query
def batch_lookup(spark, sf_dir):
    stats = features.rating_stats(views.ratings(spark, sf_dir), "user_id")
    return _rounded(lookup.batch_lookup(stats, _event_users(spark, sf_dir), "user_id"), "avg_rating", "rating_stddev")


@query
def materialise_latest(spark, sf_dir):
    history = features.movie_history(materialise(_plain_ratings(spark, sf_dir), "ratings"), views.movies(spark, sf_dir))
    return _rounded(lookup.latest_per_key(history, ["movie_id"]), "avg_rating", "rating_stddev")


@query
def online_offline_lookup(spark, sf_dir):
    """Online: latest history row of users active since 1999. Offline: statistics of all earlier ratings."""
    r = materialise(_plain_ratings(spark, sf_dir), "ratings")
    recent = features.monthly_history(r.filter(F.col("timestamp") >= SNAPSHOT_FROM), "user_id").drop("month")
    online = lookup.latest_per_key(recent, ["user_id"])
    offline = features.rating_stats(r.filter(F.col("timestamp") < SNAPSHOT_FROM), "user_id")
    asked = views.users(spark, sf_dir).unionByName(_event_users(spark, sf_dir))
    found = lookup.online_offline_lookup(asked, online, offline, "user_id", lookup.STATS_FIELDS)
    return _rounded(found, "avg_rating", "rating_stddev")


# retrieval ----------------------------------------------------------------------------------

def _label_sums(spark, sf_dir) -> DataFrame:
    """Sum of the vectors of each label."""
    v = views.item_vectors(spark, sf_dir)
    return (v.select("label", F.posexplode("vec").alias("dim", "x")).groupBy("label", "dim").agg(F.sum("x").alias("x"))
            .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("xs"))
            .select(F.col("label").cast("long").alias("label"), F.transform("xs", lambda s: s["x"]).alias("vec")))


@query
def normalised_vectors(spark, sf_dir):
    unit = _label_sums(spark, sf_dir).select("label", F.posexplode(l2_normalised("vec")).alias("dim", "x"))
    return _rounded(unit, "x")


@query
def knn_topn(spark, sf_dir):
    return retrieval.nearest_neighbours(views.item_vectors(spark, sf_dir), 10)


@query
def user_item_topn(spark, sf_dir):
    """Labels as users, vectors as items."""
    labels = _label_sums(spark, sf_dir).select("label", l2_normalised("vec").alias("vec"))
    return retrieval.top_n(labels, views.item_vectors(spark, sf_dir), 100, user="label", item="item_id")


@query
def exclude_seen(spark, sf_dir):
    """Labels as users; vectors of the own label count as seen."""
    items = views.item_vectors(spark, sf_dir)
    labels = _label_sums(spark, sf_dir).select("label", l2_normalised("vec").alias("vec"))
    seen = items.select(F.col("label").cast("long").alias("label"), "item_id")
    return retrieval.top_n(labels, items, 100, user="label", item="item_id", seen=seen)


@query
def exclude_items(spark, sf_dir):
    """Event pairs without those the user has rated."""
    pairs = views.rating_events(spark, sf_dir).select("user_id", "movie_id").distinct()
    return retrieval.exclude_items(pairs, _plain_ratings(spark, sf_dir))


def _cold(spark, sf_dir, mode) -> DataFrame:
    r = views.ratings(spark, sf_dir)
    return retrieval.cold_start(views.users(spark, sf_dir), _event_users(spark, sf_dir), r, 100, mode)


@query
def cold_start_candidates(spark, sf_dir):
    return _cold(spark, sf_dir, "popular")


@query
def cold_start_lowest_ids(spark, sf_dir):
    return _cold(spark, sf_dir, "reference")


@query
def global_mean(spark, sf_dir):
    return _rounded(factors.global_mean(views.ratings(spark, sf_dir)), "global_mean")


@query
def centred_matrix(spark, sf_dir):
    return _rounded(factors.centred_matrix(views.ratings(spark, sf_dir)), "value")


@query
def id_map(spark, sf_dir):
    return chronology.id_map(views.ratings(spark, sf_dir), "movie_id")


@query
def pair_predictions(spark, sf_dir):
    """Error of the dot product of two vectors plus the mean, over all events whose user and movie both have one."""
    v = views.item_vectors(spark, sf_dir)
    e = views.rating_events(spark, sf_dir).select("user_id", "movie_id", "rating")
    mean = materialise(e, "event-ratings").agg(F.avg("rating")).first()[0]
    model = factors.FactorModel(v.select(F.col("item_id").alias("user_id"), "vec"),
                                v.select(F.col("item_id").alias("movie_id"), "vec"), mean)
    return factors.svd_rmse_cosine(model, e).select(F.round("rmse", 6).alias("rmse"))


def _fitted(spark, sf_dir):
    r = views.ratings(spark, sf_dir)
    return r, factors.fit_svd(r, SVD_FACTORS)


@query
def svd_topn(spark, sf_dir):
    _, model = _fitted(spark, sf_dir)
    return retrieval.top_n(model.user_factors, model.item_factors, 100)


@query
def svd_checks(spark, sf_dir):
    """Whether the factors are the singular pairs of the centred matrix, found on the cells themselves."""
    cells = materialise(factors.centred_matrix(views.ratings(spark, sf_dir)), "centred")
    found = factors.svd_checks(cells, factors.singular_vectors(cells, SVD_FACTORS, tolerance=1e-7))
    return found.select("n_factors", (F.col("off_identity") < 1e-8).alias("orthonormal"), (F.col("residual") < 1e-6).alias("small_residuals"),
                        (F.col("explained") <= F.col("energy")).alias("within_energy"), F.round("energy", 3).alias("energy"))


@query
def svd_rmse(spark, sf_dir):
    r, model = _fitted(spark, sf_dir)
    return factors.svd_rmse_cosine(model, r)


# ranking ------------------------------------------------------------------------------------

def _event_candidates(spark, sf_dir) -> DataFrame:
    """Event pairs as candidates: some users and some movies are unknown to the feature tables."""
    return views.rating_events(spark, sf_dir).select("user_id", "movie_id").distinct()


def _serving(spark, sf_dir) -> DataFrame:
    r, m = views.ratings(spark, sf_dir), views.movies(spark, sf_dir)
    stats = [materialise(df, "stats") for df in (features.user_stats(r, m), features.movie_stats(r, m))]
    return recommend.candidate_features(_event_candidates(spark, sf_dir), *stats)


@query
def serving_features(spark, sf_dir):
    floats = [c for c in ranking.FEATURES if c != "genre_count"]
    return _rounded(_serving(spark, sf_dir).select("user_id", "movie_id", *ranking.FEATURES), *floats)


def _linear(spark, sf_dir) -> DataFrame:
    score = F.col("movie_stats__avg_rating") + 0.1 * F.col("user_deviation")
    return _serving(spark, sf_dir).select("user_id", "movie_id", F.round(score, 9).alias("score"))


@query
def rank_topk_linear(spark, sf_dir):
    """Top 10 by a linear score, decorated with the metadata that is catalogued."""
    ranked = ranking.rank_top_k(_linear(spark, sf_dir), 10)
    return recommend.decorated(ranked, views.movies(spark, sf_dir))


@query
def ranker_metrics(spark, sf_dir):
    """Errors of the linear score against the event ratings."""
    e = views.rating_events(spark, sf_dir).select("user_id", "movie_id", "rating")
    return _rounded(ranking.ranker_errors(_linear(spark, sf_dir).join(e, ["user_id", "movie_id"]), "rating"), "rmse", "mae")


@query
def result_count_histogram(spark, sf_dir):
    ranked = ranking.rank_top_k(_linear(spark, sf_dir), 100)
    sizes = recommend.list_sizes(ranked)
    return monitor.histogram(sizes, "value", monitor.RESULT_COUNTS).withColumn("le", F.col("le").cast("string"))


@query
def candidate_count_histogram(spark, sf_dir):
    """Candidates per request before ranking."""
    sizes = recommend.list_sizes(_linear(spark, sf_dir))
    return monitor.histogram(sizes, "value", monitor.CANDIDATE_COUNTS).withColumn("le", F.col("le").cast("string"))


def _trained(spark, sf_dir):
    r, m = views.ratings(spark, sf_dir), views.movies(spark, sf_dir)
    split = training.split_features(tables.write_snapshot(_training_set(spark, sf_dir), new_path(spark, "training")))
    train, held = (split.filter(F.col("split") == s) for s in ("train", "validation"))
    ranker = ranking.Ranker(num_rounds=RANKER_ROUNDS).fit(train, held, ranking.FEATURES)
    return r, m, ranker


@query
def recommend_topk(spark, sf_dir):
    """Both stages for every customer."""
    r, m, ranker = _trained(spark, sf_dir)
    model = factors.fit_svd(r, SVD_FACTORS)
    stats = [materialise(df, "stats") for df in (features.user_stats(r, m), features.movie_stats(r, m))]
    return recommend.recommend(views.users(spark, sf_dir), model, ranker, *stats, m, r)


@query
def feature_importance(spark, sf_dir):
    _, _, ranker = _trained(spark, sf_dir)
    return ranking.top_importances(spark, ranker.importance("gain"))


def _requests(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") != "view", F.floor("value")).cast("int").alias("top_k"))


@query
def valid_requests(spark, sf_dir):
    """Events as requests: the value is the wanted list length, missing for views."""
    return recommend.with_request_check(_requests(spark, sf_dir))


@query
def recommend_requests(spark, sf_dir):
    """One answer per valid request from the lists by the linear score; users ask more than once."""
    lists = recommend.decorated(ranking.rank_top_k(_linear(spark, sf_dir), ranking.MAX_TOP_K), views.movies(spark, sf_dir))
    done = recommend.answers(_requests(spark, sf_dir), lists)
    ids = F.transform("recommendations", lambda r: r["movie_id"].cast("string"))
    return done.select("event_id", "user_id", "top_k", F.size("recommendations").cast("long").alias("n_results"), F.array_join(ids, ",").alias("movie_ids"))


# events -------------------------------------------------------------------------------------

def _event_lines(spark, sf_dir) -> DataFrame:
    e = views.rating_events(spark, sf_dir)
    return e.select("event_id", F.to_json(F.struct("user_id", "movie_id", "rating", "timestamp")).alias("value"))


@query
def valid_events(spark, sf_dir):
    good = events.valid_events(events.parse_events(_event_lines(spark, sf_dir)))
    return good.select("event_id", "user_id", "movie_id", "rating", "timestamp")


@query
def quarantined_events(spark, sf_dir):
    bad = events.quarantined_events(events.parse_events(_event_lines(spark, sf_dir)))
    return bad.select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query
def stream_ingest(spark, sf_dir):
    """The same events through the stream: files of lines in, outcome per event out."""
    lines = new_path(spark, "lines")
    _event_lines(spark, sf_dir).select("value").write.text(lines)
    root = ingest.ingest(ingest.read_lines(spark, lines), now=F.lit(AS_OF))
    good = spark.read.parquet(f"{root}/valid").select("user_id", "movie_id", "rating", "timestamp", F.lit("").alias("reasons"))
    bad = spark.read.parquet(f"{root}/quarantine").select(
        "user_id", "movie_id", "rating", "timestamp", F.array_join("reasons", ",").alias("reasons"))
    return good.unionByName(bad)


@query
def default_timestamps(spark, sf_dir):
    """Signups carry time 0 and views none; both become the given now."""
    kind = F.col("event_type")
    ts = F.when(kind == "signup", 0).when(kind != "view", F.col("timestamp"))
    return views.rating_events(spark, sf_dir).select(
        "event_id", events.default_timestamp(ts, F.lit(AS_OF)).alias("timestamp"))


@query
def event_json(spark, sf_dir):
    return events.to_event_json(views.ratings(spark, sf_dir)).select("l_orderkey", "l_linenumber", "movie_id", "value")


@query
def replay_schedule(spark, sf_dir):
    df = chronology.replay_schedule(_plain_ratings(spark, sf_dir), 100)
    return _rounded(df, "emit_offset_s")


@query
def replay_realtime(spark, sf_dir):
    return chronology.replay_schedule(_plain_ratings(spark, sf_dir), None)


@query
def chronological_head(spark, sf_dir):
    return chronology.chronological_head(_plain_ratings(spark, sf_dir), HEAD_EVENTS)


@query
def stream_replay(spark, sf_dir):
    """All ratings replayed as files, streamed back in and validated."""
    path = new_path(spark, "replayed")
    replay.write_replay(_plain_ratings(spark, sf_dir), path, chunks=4)
    root = ingest.ingest(replay.read_replay(spark, path, files_per_trigger=8))
    return spark.read.parquet(f"{root}/valid").select("event_type", "user_id", "movie_id", "rating", "timestamp", "datetime")


@query
def stream_replay_order(spark, sf_dir):
    """The order in which an ordered replay delivers all ratings."""
    path = new_path(spark, "ordered")
    replay.write_ordered_replay(_plain_ratings(spark, sf_dir), path, chunks=4)

    def deliver(rows, chunk):
        came = rows.select(F.monotonically_increasing_id().alias("came"), "value")
        came.write.mode("overwrite").parquet(f"{path}/delivered/chunk={chunk}")

    replay.play_ordered(spark, path, deliver, f"{path}/checkpoint").awaitTermination()
    delivered = events.parse_events(spark.read.parquet(f"{path}/delivered")).select(
        "chunk", "came", "user_id", "movie_id", "rating", "timestamp")
    placed = chronology.global_positions(delivered, ["chunk", "came"], "arrival")
    return placed.select("arrival", "user_id", "movie_id", "rating", "timestamp")


@query
def ingest_outcomes(spark, sf_dir):
    """Outcome of valid events per hour; purchases stand for the time the broker was away, errors for sends it refused."""
    e = events.with_reasons(views.rating_events(spark, sf_dir)).filter(F.size("reasons") == 0)
    status = events.outcome_status(F.col("event_type") != "purchase", F.col("event_type") != "error")
    return events.outcome_counts(e.select(F.timestamp_seconds("timestamp").alias("ts"), status.alias("status")), width="1 hour")


# monitoring ---------------------------------------------------------------------------------

def _call_log(spark, sf_dir) -> DataFrame:
    """Signups stand for calls of the metrics endpoint, errors for calls that raised."""
    kind = F.col("endpoint")
    calls = views.request_log(spark, sf_dir).withColumns({
        "raised": kind == "error", "status": F.lit("200"),
        "endpoint": F.when(kind == "signup", monitor.METRICS_ENDPOINT).otherwise(F.concat(F.lit("/"), kind))})
    return monitor.request_log(calls)


@query
def request_log(spark, sf_dir):
    return _call_log(spark, sf_dir).select("endpoint", "status", "duration_s", F.unix_micros("ts").alias("ts_us"))


@query
def latency_histogram(spark, sf_dir):
    h = monitor.histogram(views.request_log(spark, sf_dir), "duration_s", monitor.REQUEST_SECONDS, ["endpoint"])
    return _rounded(h, "sum", digits=4).withColumn("le", F.col("le").cast("string"))


@query
def latency_quantiles(spark, sf_dir):
    h = monitor.histogram(views.request_log(spark, sf_dir), "duration_s", monitor.REQUEST_SECONDS, ["endpoint"])
    return _rounded(monitor.histogram_quantile(h, [0.5, 0.95, 0.99], ["endpoint"]), "value")


@query
def recommend_latency_histogram(spark, sf_dir):
    """Durations of views, which stand for recommendation requests."""
    log = views.request_log(spark, sf_dir).filter("endpoint = 'view'")
    return _rounded(monitor.histogram(log, "duration_s", monitor.RECOMMEND_SECONDS), "sum", digits=4).withColumn("le", F.col("le").cast("string"))


@query
def lookup_latency_histogram(spark, sf_dir):
    """Durations of the other requests, signups as lookups of users and the rest as lookups of movies, a tenth of the whole each."""
    log = views.request_log(spark, sf_dir).filter("endpoint <> 'view'").select(
        F.when(F.col("endpoint") == "signup", "user").otherwise("movie").alias("entity_type"), (F.col("duration_s") / 10).alias("duration_s"))
    h = monitor.histogram(log, "duration_s", monitor.LOOKUP_SECONDS, ["entity_type"])
    return _rounded(h, "sum", digits=4).withColumn("le", F.col("le").cast("string"))


@query
def latency_quantile_series(spark, sf_dir):
    """Quantiles per minute and endpoint over the last five minutes."""
    found = monitor.quantile_series(views.request_log(spark, sf_dir), "duration_s", monitor.REQUEST_SECONDS, [0.5, 0.95, 0.99], ["endpoint"], 5)
    return _rounded(found, "value")


@query
def latency_quantiles_per_minute(spark, sf_dir):
    """Quantiles per minute over all endpoints."""
    found = monitor.quantile_series(views.request_log(spark, sf_dir), "duration_s", monitor.REQUEST_SECONDS, [0.5, 0.95, 0.99])
    return _rounded(found, "value")


@query
def rate_per_minute(spark, sf_dir):
    return _rounded(monitor.rate_per_minute(views.request_log(spark, sf_dir), ["endpoint"]), "per_second")


@query
def error_rate(spark, sf_dir):
    return _rounded(monitor.error_rate(views.request_log(spark, sf_dir)), "per_second")


@query
def error_counts(spark, sf_dir):
    """Broken rules of rejected events as error reasons."""
    bad = events.quarantined_events(views.rating_events(spark, sf_dir))
    return monitor.error_counts(bad.select(F.explode("reasons").alias("reason")), "reason")


# rolling features ---------------------------------------------------------------------------

@query
def rolling_7d_avg(spark, sf_dir):
    return _rounded(rolling.rolling_average(views.ratings(spark, sf_dir)), "avg_rating")


@query
def genre_affinity(spark, sf_dir):
    r = materialise(_plain_ratings(spark, sf_dir), "ratings")
    return _rounded(rolling.genre_affinity(r, views.movies(spark, sf_dir)), "avg_rating", "share")


def _timed_events(df: DataFrame) -> DataFrame:
    """Valid ratings with their times."""
    found = events.valid_events(views.as_rating_events(df).withColumn("ts", epoch_micros("ts")))
    return found.select(F.timestamp_micros("ts").alias("ts"), "user_id", "movie_id", "rating")


@query
def windowed_user_stats(spark, sf_dir):
    df = rolling.windowed_stats(_timed_events(views.table(spark, sf_dir, "events")), "user_id", "1 day")
    return _rounded(df, "avg_rating", "rating_stddev", digits=10)


@query
def weekly_user_windows(spark, sf_dir):
    df = rolling.windowed_stats(_timed_events(views.table(spark, sf_dir, "events")), "user_id", "7 days", "1 day")
    return _rounded(df, "avg_rating", "rating_stddev", digits=10)


def _event_stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


@query
def stream_windowed_stats(spark, sf_dir):
    """Windows that closed while the event stream drained."""
    stats = stream_rolling.windowed_stream(_timed_events(_event_stream(spark, sf_dir)), "user_id", "1 day")
    closed, _ = stream_rolling.drain_windows(stats)
    return _rounded(closed, "avg_rating", "rating_stddev", digits=10)


@query
def stream_running_totals(spark, sf_dir):
    path = new_path(spark, "totals")
    stream = _timed_events(_event_stream(spark, sf_dir)).select("user_id", "rating", F.unix_micros("ts").alias("timestamp"))
    stream_rolling.running_totals(stream, "user_id", path).awaitTermination()
    return _rounded(stream_rolling.online_table(spark, path, "user_id"), "avg_rating", "rating_stddev", digits=10)


@query
def stream_movie_windows(spark, sf_dir):
    """Windows per movie that closed while the event stream drained."""
    stats = stream_rolling.windowed_stream(_timed_events(_event_stream(spark, sf_dir)), "movie_id", "1 day")
    closed, _ = stream_rolling.drain_windows(stats)
    return _rounded(closed, "avg_rating", "rating_stddev", digits=10)


def _streamed_totals(spark, stream, key, name):
    path = new_path(spark, name)
    timed = stream.withColumn("timestamp", F.unix_micros("ts")).drop("ts")
    stream_rolling.running_totals(timed, key, path).awaitTermination()
    return stream_rolling.online_table(spark, path, key)


@query
def stream_movie_totals(spark, sf_dir):
    totals = _streamed_totals(spark, _timed_events(_event_stream(spark, sf_dir)), "movie_id", "movie-totals")
    return _rounded(totals, "avg_rating", "rating_stddev", digits=10)


@query
def stream_genre_affinity(spark, sf_dir):
    """Genre affinity kept up to date by the event stream: totals per user and genre, shares when read."""
    stream = rolling.genre_events(_timed_events(_event_stream(spark, sf_dir)), views.movies(spark, sf_dir))
    totals = _streamed_totals(spark, stream, ["user_id", "genre"], "genre-totals")
    return _rounded(rolling.with_share(totals).drop("rating_stddev", "event_timestamp"), "avg_rating", "share", digits=9)


def _parted(spark, sf_dir) -> str:
    """The ratings among the events in time order, every seventh a quarter of the time late, parted by day windows."""
    all_events = views.table(spark, sf_dir, "events")
    day = F.unix_date(F.col("ts").cast("date"))
    first, last = all_events.agg(F.min(day), F.max(day)).first()
    quarter = F.floor((day - first) * 4 / (last - first + 1))
    arrives = (quarter + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).alias("arrives")
    rows = materialise(all_events.select("*", arrives), "arrivals")
    inbox, root = new_path(spark, "inbox"), new_path(spark, "parted")
    for chunk in range(5):
        rows.filter(F.col("arrives") == chunk).write.mode("append").parquet(inbox)
        timed = _timed_events(spark.readStream.schema(rows.schema).parquet(inbox))
        stream_rolling.part_late(timed, root, width=86_400).awaitTermination()
    return root


@query
def stream_late_rows(spark, sf_dir):
    """Rows whose day had ended at the watermark when they came, with their batch."""
    late = spark.read.parquet(f"{_parted(spark, sf_dir)}/late")
    return late.select(F.col("batch_id").cast("long").alias("batch_id"), F.unix_micros("ts").alias("ts_us"), "user_id", "movie_id", "rating")


@query
def stream_late_metrics(spark, sf_dir):
    """Per batch: rows, late rows and the watermark."""
    found = spark.read.parquet(f"{_parted(spark, sf_dir)}/metrics")
    return found.select(F.col("batch_id").cast("long").alias("batch_id"), "n_rows", "n_late", F.col("watermark").alias("watermark_us"))
