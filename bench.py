"""Times the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from tastelake.operators import chronology, explore, factors, features, monitor, ranking, recommend, retrieval, rolling
from tastelake.plans import feature_generation, training, views
from tastelake.session import build_session, materialise, new_path
from tastelake.streaming import replay

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("bench", cores=CPUS, shuffle_partitions=int(CPUS), driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, job):
        started = time.time()
        result = job()
        times[name] = round(time.time() - started, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
        return result

    run(views.ratings(spark, SF_DIR).limit(1))  # start the session before the first timing
    # the table every job below reads, one file per core: the given file has a single row group
    ratings = timed("ratings_view", lambda: materialise(
        views.ratings(spark, SF_DIR).repartition(int(CPUS)), "bench-ratings"))
    movies = timed("movies_view", lambda: materialise(views.movies(spark, SF_DIR), "bench-movies"))
    n_ratings = ratings.count()

    timed("feature_generation", lambda: feature_generation.generate_features(ratings, movies, new_path(spark, "bench")))
    timed("user_stats", lambda: run(features.user_stats(ratings, movies)))
    timed("movie_stats", lambda: run(features.movie_stats(ratings, movies)))
    timed("dataset_overview", lambda: run(explore.dataset_overview(ratings)))
    timed("rating_distribution", lambda: run(explore.rating_distribution(ratings)))
    timed("activity_per_user", lambda: run(explore.activity_per_user(ratings)))

    snapshot = timed("pit_training_set", lambda: materialise(
        training.training_set(ratings, training.history_sources(ratings, movies)), "bench-training"))
    split = timed("training_features_split", lambda: training.split_features(snapshot))

    model = timed("svd_50_factors", lambda: factors.fit_svd(ratings, 50))
    timed("svd_rmse", lambda: factors.svd_rmse_cosine(model, ratings).first())
    timed("top100_all_users", lambda: run(retrieval.top_n(model.user_factors, model.item_factors, 100)))
    timed("id_map", lambda: run(chronology.id_map(ratings, "user_id")))

    train, held = (split.filter(F.col("split") == s) for s in ("train", "validation"))
    ranker = timed("ranker_10_rounds", lambda: ranking.Ranker(num_rounds=10).fit(train, held, ranking.FEATURES))
    timed("ranker_predict", lambda: ranking.ranker_errors(ranker.predict(held)).first())
    stats = [materialise(df, "bench-stats") for df in
             (features.user_stats(ratings, movies), features.movie_stats(ratings, movies))]
    timed("recommend_all_users", lambda: run(recommend.recommend(
        views.users(spark, SF_DIR), model, ranker, *stats, movies, ratings)))

    timed("replay_schedule", lambda: run(chronology.replay_schedule(ratings, 100)))
    timed("replay_events", lambda: replay.write_replay(ratings, new_path(spark, "bench-replay"), chunks=4))
    timed("rolling_7d_avg", lambda: run(rolling.rolling_average(ratings)))
    timed("genre_affinity", lambda: run(rolling.genre_affinity(ratings, movies)))
    log = views.request_log(spark, SF_DIR)
    timed("latency_quantiles", lambda: run(monitor.histogram_quantile(
        monitor.histogram(log, "duration_s", monitor.REQUEST_SECONDS, ["endpoint"]), [0.5, 0.95, 0.99], ["endpoint"])))

    print(json.dumps({
        "metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "ratings": n_ratings,
        "replay_events_per_sec": round(n_ratings / times["replay_events"])}))
    spark.stop()


if __name__ == "__main__":
    main()
