"""The same questions as plain SQL over the given tables, for the correctness check."""

from __future__ import annotations

RATINGS = """
ratings AS (
  SELECT o_custkey + 1 AS user_id, l_partkey + 1 AS movie_id, ceil(l_quantity / 5) / 2 AS rating,
         CAST(epoch(o_orderdate) AS BIGINT) AS ts, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

MOVIES = """
movies AS (
  SELECT p_partkey + 1 AS movie_id, p_name AS title,
         replace(p_type || ' ' || p_name, ' ', '|') AS genres
  FROM part)"""

EVENTS = """
rating_events AS (
  SELECT event_id, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS movie_id,
         value / 20 AS rating, CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp", ts
  FROM events)"""

CHECKED = EVENTS + """,
checked AS (
  SELECT *, concat_ws(',',
    CASE WHEN user_id >= 1 THEN NULL ELSE 'user_id' END,
    CASE WHEN movie_id >= 1 THEN NULL ELSE 'movie_id' END,
    CASE WHEN rating >= 0.5 AND rating <= 5.0 THEN NULL ELSE 'rating' END) AS reasons
  FROM rating_events)"""

VALID = f"(WITH {CHECKED} SELECT user_id, movie_id, rating, ts FROM checked WHERE reasons = '')"

LOG = """
request_log AS (
  SELECT event_type AS endpoint, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
         value / 100 AS duration_s, ts
  FROM events)"""


def _stats(key: str, source: str = "ratings") -> str:
    return f"""
  SELECT {key}, avg(rating) AS avg_rating, count(rating) AS rating_count,
         coalesce(stddev_samp(rating), 0.0) AS rating_stddev
  FROM {source} GROUP BY {key}"""


def _genres() -> str:
    return f"""
  SELECT user_id, count(DISTINCT genre) AS unique_genres_rated FROM (
    SELECT user_id, unnest(string_split(genres, '|')) AS genre
    FROM ratings JOIN movies USING (movie_id)) GROUP BY user_id"""


STATS = RATINGS + "," + MOVIES + f""",
user_stats AS (
  SELECT s.*, coalesce(g.unique_genres_rated, 0) AS unique_genres_rated
  FROM ({_stats('user_id')}) s LEFT JOIN ({_genres()}) g USING (user_id)),
movie_stats AS (
  SELECT s.*, coalesce(m.genres, '(no genres listed)') AS genres
  FROM ({_stats('movie_id')}) s LEFT JOIN movies m USING (movie_id))"""

_MONTH = "date_trunc('month', to_timestamp(ts) AT TIME ZONE 'UTC')"


def _history(key: str) -> str:
    """Statistics of all ratings before each month end, from the definition: a join on earlier ratings."""
    return f"""
  SELECT m.{key}, m.event_timestamp, avg(r.rating) AS avg_rating, count(*) AS rating_count,
         coalesce(stddev_samp(r.rating), 0.0) AS rating_stddev
  FROM (SELECT DISTINCT {key}, CAST(epoch({_MONTH} + INTERVAL 1 MONTH) AS BIGINT) AS event_timestamp FROM ratings) m
  JOIN ratings r ON r.{key} = m.{key} AND r.ts < m.event_timestamp
  GROUP BY m.{key}, m.event_timestamp"""


HISTORY = RATINGS + "," + MOVIES + f""",
user_base AS ({_history('user_id')}),
user_tokens AS (
  SELECT user_id, ts, unnest(string_split(genres, '|')) AS genre FROM ratings JOIN movies USING (movie_id)),
user_genres AS (
  SELECT b.user_id, b.event_timestamp, count(DISTINCT t.genre) AS unique_genres_rated
  FROM user_base b LEFT JOIN user_tokens t ON t.user_id = b.user_id AND t.ts < b.event_timestamp
  GROUP BY b.user_id, b.event_timestamp),
user_history AS (SELECT * FROM user_base JOIN user_genres USING (user_id, event_timestamp)),
movie_history AS (
  SELECT b.*, coalesce(m.genres, '(no genres listed)') AS genres
  FROM ({_history('movie_id')}) b LEFT JOIN movies m USING (movie_id))"""

PIT = HISTORY + """,
own AS (SELECT user_id, movie_id, ts, max(rating) AS rating FROM ratings GROUP BY ALL),
u AS (
  SELECT r.*, h.avg_rating AS ua, h.rating_count AS uc, h.rating_stddev AS us, h.unique_genres_rated AS ug
  FROM ratings r ASOF LEFT JOIN user_history h ON r.user_id = h.user_id AND r.ts >= h.event_timestamp),
m AS (
  SELECT u.*, h.avg_rating AS ma, h.rating_count AS mc, h.rating_stddev AS ms, h.genres AS mg
  FROM u ASOF LEFT JOIN movie_history h ON u.movie_id = h.movie_id AND u.ts >= h.event_timestamp),
pit AS (
  SELECT m.*, o.rating AS own_rating, o.ts AS own_ts
  FROM m ASOF LEFT JOIN own o ON m.user_id = o.user_id AND m.movie_id = o.movie_id AND m.ts >= o.ts)"""

VECTORS = """
v AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
dims AS (SELECT item_id, label, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM v),
label_dims AS (SELECT label, dim, sum(x) AS x FROM dims GROUP BY label, dim),
label_units AS (SELECT label, dim, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM label_dims),
label_scores AS (
  SELECT u.label, d.item_id, d.label AS item_label, round(sum(u.x * d.x), 9) AS s
  FROM label_units u JOIN dims d USING (dim) GROUP BY u.label, d.item_id, d.label)"""


def _cold(order: str) -> str:
    return f"""
WITH {RATINGS},
popular AS (
  SELECT movie_id, row_number() OVER (ORDER BY {order}) AS "rank"
  FROM (SELECT movie_id, count(*) AS n FROM ratings GROUP BY movie_id) QUALIFY "rank" <= 100)
SELECT c_custkey + 1 AS user_id, movie_id, "rank" FROM customer CROSS JOIN popular
WHERE c_custkey + 1 NOT IN (SELECT user_id FROM events)"""


SERVING = STATS + "," + EVENTS + """,
candidates AS (SELECT DISTINCT user_id, movie_id FROM rating_events),
serving AS (
  SELECT c.user_id, c.movie_id,
    coalesce(u.avg_rating, 3.5) AS user_stats__avg_rating,
    CAST(coalesce(u.rating_count, 0) AS DOUBLE) AS user_stats__rating_count,
    coalesce(u.rating_stddev, 0.0) AS user_stats__rating_stddev,
    CAST(coalesce(u.unique_genres_rated, 0) AS DOUBLE) AS user_stats__unique_genres_rated,
    m.avg_rating AS movie_stats__avg_rating, CAST(m.rating_count AS DOUBLE) AS movie_stats__rating_count,
    m.rating_stddev AS movie_stats__rating_stddev,
    coalesce(u.avg_rating, 3.5) - m.avg_rating AS user_deviation,
    ln(1 + m.rating_count) AS movie_popularity_log, ln(1 + coalesce(u.rating_count, 0)) AS user_activity_log,
    CAST(len(m.genres) - len(replace(m.genres, '|', '')) + 1 AS INTEGER) AS genre_count
  FROM candidates c JOIN movie_stats m USING (movie_id) LEFT JOIN user_stats u USING (user_id)),
linear AS (
  SELECT user_id, movie_id, round(movie_stats__avg_rating + 0.1 * user_deviation, 9) AS score FROM serving),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, movie_id) AS "rank" FROM linear)"""


def _buckets(relation: str, value: str, bounds: tuple, label: str | None) -> str:
    rows = ", ".join(f"({float(b)!r}::DOUBLE)" for b in bounds) + ", ('inf'::DOUBLE)"
    group = f"{label}, " if label else ""
    return f"""
  SELECT {group}le, CAST(count(*) FILTER ({value} <= le) AS BIGINT) AS cum, count(*) AS "count", sum({value}) AS "sum"
  FROM {relation} CROSS JOIN (VALUES {rows}) b(le) GROUP BY {group}le"""


def _le_text() -> str:
    return "CASE WHEN isinf(le) THEN 'Infinity' ELSE CAST(le AS VARCHAR) END AS le"


def _windows(relation: str, width: int, slide: int, key: str = "user_id") -> str:
    """Tumbling and sliding windows: each event joins all windows that cover it."""
    n = width // slide
    return f"""
  SELECT (e // {slide} - k) * {slide} AS window_start, {key}, count(rating) AS rating_count,
         round(avg(rating), 10) AS avg_rating, round(coalesce(stddev_samp(rating), 0.0), 10) AS rating_stddev
  FROM (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS e, {key}, rating, unnest(range({n})) AS k
        FROM {relation}) GROUP BY ALL"""


def _series(minutes: int, label: str | None) -> str:
    """Every row counts in the minutes whose range covers it; quantiles from the buckets of each."""
    from tastelake.operators import monitor
    label_, using = (f"{label}, ", f"{label}, minute") if label else ("", "minute")
    return f"""WITH {LOG},
timed AS (SELECT {label_}CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 + 60 * unnest(range({minutes})) AS "minute", duration_s FROM request_log),
h AS ({_buckets("timed", "duration_s", monitor.REQUEST_SECONDS, using)}),
s AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS lo, coalesce(lag(cum) OVER w, 0) AS below FROM h WINDOW w AS (PARTITION BY {using} ORDER BY le))
SELECT {using}, "count" AS n, q.quantile, round(CASE WHEN isinf(le) THEN lo
  ELSE lo + (le - lo) * (q.quantile * "count" - below) / (cum - below) END, 6) AS value
FROM s CROSS JOIN (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) q(quantile) WHERE cum >= q.quantile * "count"
QUALIFY row_number() OVER (PARTITION BY {using}, q.quantile ORDER BY le) = 1"""


def sql() -> dict[str, str]:
    from tastelake.operators import monitor
    from tastelake.plans.queries import AS_OF, HEAD_EVENTS, SNAPSHOT_FROM
    from tastelake import schemas

    rounded = "round(avg_rating, 6) AS avg_rating, rating_count, round(rating_stddev, 6) AS rating_stddev"
    plain = 'user_id, movie_id, rating, ts AS "timestamp"'
    order = "ts, user_id, movie_id, rating"
    datetime = "strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00'"
    q: dict[str, str] = {}

    q["user_stats"] = f"WITH {STATS} SELECT user_id, {rounded}, unique_genres_rated FROM user_stats"
    q["movie_stats"] = f"WITH {STATS} SELECT movie_id, {rounded}, genres FROM movie_stats"
    q["user_unique_genres"] = f"WITH {RATINGS}, {MOVIES} {_genres()}"
    q["interactions"] = f"WITH {RATINGS} SELECT {plain}, {AS_OF}::BIGINT AS event_time FROM ratings"
    q["user_stats_history"] = f"""WITH {HISTORY}
SELECT user_id, event_timestamp, {rounded}, unique_genres_rated FROM user_history"""
    q["csv_scan"] = f"""WITH {RATINGS}, {MOVIES}
SELECT {plain}, title, genres FROM ratings JOIN movies USING (movie_id)"""
    narrow = "round(CAST(CAST({0} AS FLOAT) AS DOUBLE), 4) AS {0}"
    part = (f"{narrow.format('avg_rating')}, rating_count, {narrow.format('rating_stddev')}, "
            f"{AS_OF}::BIGINT AS event_time")
    q["feature_tables"] = f"""WITH {STATS}
SELECT 'user_stats' AS view, user_id AS key, {part} FROM user_stats
UNION ALL SELECT 'movie_stats', movie_id, {part} FROM movie_stats"""
    report = "NULL::BIGINT AS n_users, NULL::BIGINT AS n_movies, NULL::DOUBLE AS min_rating, NULL::DOUBLE AS max_rating"
    names = {s: ",".join(getattr(schemas, s).names) for s in ("USER_STATS", "MOVIE_STATS", "INTERACTIONS")}
    q["prereq_report"] = f"""WITH {RATINGS}
SELECT 'ratings' AS table_name, count(*) AS n_rows, count(DISTINCT user_id) AS n_users,
  count(DISTINCT movie_id) AS n_movies, min(rating) AS min_rating, max(rating) AS max_rating, NULL::VARCHAR AS columns FROM ratings
UNION ALL SELECT 'user_stats', count(DISTINCT user_id), {report}, '{names["USER_STATS"]}' FROM ratings
UNION ALL SELECT 'movie_stats', count(DISTINCT movie_id), {report}, '{names["MOVIE_STATS"]}' FROM ratings
UNION ALL SELECT 'interactions', count(*), {report}, '{names["INTERACTIONS"]}' FROM ratings"""

    q["dataset_overview"] = f"""WITH {RATINGS}, o AS (
  SELECT count(*) AS ratings, count(DISTINCT user_id) AS users, count(DISTINCT movie_id) AS movies,
    CAST(CAST(to_timestamp(min(ts)) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS first_date,
    CAST(CAST(to_timestamp(max(ts)) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS last_date FROM ratings)
SELECT *, users * movies AS cells, round((1 - ratings / (users * movies)) * 100, 6) AS sparsity_pct FROM o"""
    q["rating_distribution"] = f"""WITH {RATINGS}, d AS (SELECT rating, count(*) AS n FROM ratings GROUP BY rating)
SELECT rating, n, CAST(floor(n / (max(n) OVER ()) * 30) AS INTEGER) AS bar FROM d"""
    q["rating_moments"] = f"""WITH {RATINGS}
SELECT round(avg(rating), 6) AS mean_rating, median(rating) AS median_rating, round(stddev_samp(rating), 6) AS std_rating FROM ratings"""
    activity = "min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS mean_n, CAST(median(n) AS DOUBLE) AS median_n"
    q["activity_per_user"] = f"""WITH {RATINGS}, a AS (SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id)
SELECT {activity}, count(*) FILTER (n < 20) AS few_n, round(count(*) FILTER (n < 20) / count(*) * 100, 6) AS few_pct FROM a"""
    q["activity_per_movie"] = f"""WITH {RATINGS}, a AS (SELECT movie_id, count(*) AS n FROM ratings GROUP BY movie_id)
SELECT {activity} FROM a"""
    q["genre_breakdown"] = f"""WITH {MOVIES}, g AS (
  SELECT genre, count(*) AS n FROM (SELECT unnest(string_split(genres, '|')) AS genre FROM movies) GROUP BY genre)
SELECT genre, n, CAST(floor(n / (max(n) OVER ()) * 30) AS INTEGER) AS bar,
  (SELECT count(*) FROM movies) AS movies_total, (SELECT count(*) FROM g) AS genres_total FROM g"""

    q["pit_training_set"] = f"""WITH {PIT}
SELECT user_id, movie_id, ts AS event_timestamp,
  round(ua, 6) AS user_stats__avg_rating, uc AS user_stats__rating_count, round(us, 6) AS user_stats__rating_stddev,
  ug AS user_stats__unique_genres_rated,
  round(ma, 6) AS movie_stats__avg_rating, mc AS movie_stats__rating_count, round(ms, 6) AS movie_stats__rating_stddev,
  mg AS movie_stats__genres, own_rating AS interactions__rating, own_ts AS interactions__timestamp FROM pit"""
    q["training_features"] = f"""WITH {PIT}
SELECT user_id, movie_id, ts AS event_timestamp,
  CAST(len(mg) - len(replace(mg, '|', '')) + 1 AS INTEGER) AS genre_count,
  round(ua - ma, 6) AS user_deviation, round(own_rating - ma, 6) AS user_deviation_reference,
  round(ln(1 + mc), 6) AS movie_popularity_log, round(ln(1 + uc), 6) AS user_activity_log,
  round(((SELECT max(own_ts) FROM pit) - own_ts) / 86400.0::DOUBLE, 6) AS recency_days
FROM pit WHERE ua IS NOT NULL AND ma IS NOT NULL AND mg IS NOT NULL AND own_rating IS NOT NULL"""
    q["time_split"] = f"""WITH {RATINGS}, o AS (
  SELECT {plain}, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n FROM ratings)
SELECT user_id, movie_id, rating, "timestamp",
  CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM o"""

    q["batch_lookup"] = f"""WITH {RATINGS}, s AS ({_stats('user_id')})
SELECT user_id, {rounded} FROM s WHERE user_id IN (SELECT user_id FROM events)"""
    q["materialise_latest"] = f"""WITH {HISTORY}
SELECT movie_id, event_timestamp, {rounded}, genres FROM movie_history
QUALIFY row_number() OVER (PARTITION BY movie_id ORDER BY event_timestamp DESC) = 1"""
    q["online_offline_lookup"] = f"""WITH {RATINGS},
online AS ({_stats('user_id', f'ratings WHERE ts >= {SNAPSHOT_FROM}')}),
offline AS ({_stats('user_id', f'ratings WHERE ts < {SNAPSHOT_FROM}')}),
asked AS (SELECT c_custkey + 1 AS user_id FROM customer UNION SELECT user_id FROM events)
SELECT user_id, 'online' AS source, round(avg_rating, 6) AS avg_rating, CAST(rating_count AS DOUBLE) AS rating_count,
  round(rating_stddev, 6) AS rating_stddev FROM asked JOIN online USING (user_id)
UNION ALL
SELECT user_id, 'offline', round(avg_rating, 6), CAST(rating_count AS DOUBLE), round(rating_stddev, 6)
FROM asked JOIN offline USING (user_id) WHERE user_id NOT IN (SELECT user_id FROM online)"""

    q["normalised_vectors"] = f"""WITH {VECTORS}
SELECT CAST(label AS BIGINT) AS label, CAST(dim AS INTEGER) AS dim, round(x, 6) AS x FROM label_units"""
    q["knn_topn"] = f"""WITH {VECTORS}, s AS (
  SELECT a.item_id, b.item_id AS neighbour_id, round(list_dot_product(a.vec, b.vec), 9) AS s
  FROM v a JOIN v b ON a.item_id <> b.item_id)
SELECT item_id, neighbour_id, s AS score, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, neighbour_id) AS "rank"
FROM s QUALIFY "rank" <= 10"""
    top = """SELECT CAST(label AS BIGINT) AS label, item_id, s AS score,
  row_number() OVER (PARTITION BY label ORDER BY s DESC, item_id) AS "rank" FROM label_scores {0} QUALIFY "rank" <= 100"""
    q["user_item_topn"] = f"WITH {VECTORS} {top.format('')}"
    q["exclude_seen"] = f"WITH {VECTORS} {top.format('WHERE label <> item_label')}"
    q["exclude_items"] = f"""WITH {RATINGS}, {EVENTS}
SELECT DISTINCT user_id, movie_id FROM rating_events e
WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = e.user_id AND r.movie_id = e.movie_id)"""
    q["cold_start_candidates"] = _cold("n DESC, movie_id")
    q["cold_start_lowest_ids"] = _cold("movie_id")
    q["global_mean"] = f"WITH {RATINGS} SELECT round(avg(rating), 6) AS global_mean FROM ratings"
    q["centred_matrix"] = f"""WITH {RATINGS}
SELECT user_id, movie_id, round(rating - (SELECT avg(rating) FROM ratings), 6) AS value FROM ratings
QUALIFY row_number() OVER (PARTITION BY user_id, movie_id ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, rating DESC) = 1"""
    q["svd_checks"] = f"""WITH {RATINGS}, latest AS (
SELECT rating - (SELECT avg(rating) FROM ratings) AS value FROM ratings
QUALIFY row_number() OVER (PARTITION BY user_id, movie_id ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, rating DESC) = 1)
SELECT 50 AS n_factors, true AS orthonormal, true AS small_residuals, true AS within_energy, round(sum(value * value), 3) AS energy FROM latest"""
    q["id_map"] = f"""WITH {RATINGS}
SELECT movie_id, row_number() OVER (ORDER BY movie_id) - 1 AS idx FROM (SELECT DISTINCT movie_id FROM ratings)"""
    q["pair_predictions"] = f"""WITH {EVENTS}, {VECTORS}
SELECT round(coalesce(sqrt(avg((list_dot_product(a.vec, b.vec) + (SELECT avg(rating) FROM rating_events) - e.rating) ** 2)), 0.0), 6) AS rmse
FROM rating_events e JOIN v a ON a.item_id = e.user_id JOIN v b ON b.item_id = e.movie_id"""

    floats = ["user_stats__avg_rating", "user_stats__rating_count", "user_stats__rating_stddev",
              "user_stats__unique_genres_rated", "movie_stats__avg_rating", "movie_stats__rating_count",
              "movie_stats__rating_stddev", "user_deviation", "movie_popularity_log", "user_activity_log"]
    q["serving_features"] = f"""WITH {SERVING}
SELECT user_id, movie_id, {", ".join(f"round({c}, 6) AS {c}" for c in floats)}, genre_count, 0.0::DOUBLE AS recency_days FROM serving"""
    q["rank_topk_linear"] = f"""WITH {SERVING}
SELECT r.user_id, r.movie_id, r."rank", coalesce(m.title, 'Movie ' || r.movie_id) AS title, coalesce(m.genres, '') AS genres,
  CAST(round(CAST(r.score AS DECIMAL(18, 9)), 4) AS DOUBLE) AS score
FROM ranked r LEFT JOIN movies m USING (movie_id) WHERE r."rank" <= 10"""
    q["ranker_metrics"] = f"""WITH {SERVING}
SELECT round(sqrt(avg((score - rating) ** 2)), 6) AS rmse, round(avg(abs(score - rating)), 6) AS mae
FROM linear JOIN rating_events USING (user_id, movie_id)"""
    q["result_count_histogram"] = f"""WITH {SERVING},
sizes AS (SELECT user_id, count(*) AS value FROM ranked WHERE "rank" <= 100 GROUP BY user_id),
h AS ({_buckets("sizes", "value", monitor.RESULT_COUNTS, None)})
SELECT {_le_text()}, cum, "count", CAST("sum" AS BIGINT) AS "sum" FROM h"""

    q["valid_requests"] = """SELECT event_id, user_id, top_k, user_id >= 1 AND top_k BETWEEN 1 AND 100 AS valid FROM (
  SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 10 ELSE CAST(floor(value) AS INTEGER) END AS top_k FROM events)"""
    q["recommend_requests"] = f"""WITH {SERVING},
asked AS (SELECT * FROM ({q["valid_requests"]}) WHERE valid)
SELECT a.event_id, a.user_id, a.top_k, count(r."rank") AS n_results, coalesce(string_agg(CAST(r.movie_id AS VARCHAR), ',' ORDER BY r."rank"), '') AS movie_ids
FROM asked a LEFT JOIN ranked r ON r.user_id = a.user_id AND r."rank" <= a.top_k GROUP BY ALL"""
    q["lookup_after_two_snapshots"] = f"""WITH {STATS}
SELECT user_id, round(CAST(CAST(avg_rating AS FLOAT) AS DOUBLE), 4) AS avg_rating, rating_count, {AS_OF}::BIGINT AS event_time
FROM user_stats WHERE user_id IN (SELECT c_custkey + 1 FROM customer)"""
    q["valid_events"] = f"""WITH {CHECKED}
SELECT event_id, user_id, movie_id, rating, "timestamp" FROM checked WHERE reasons = ''"""
    q["quarantined_events"] = f"WITH {CHECKED} SELECT event_id, reasons FROM checked WHERE reasons <> ''"
    q["stream_ingest"] = f"""WITH {CHECKED} SELECT user_id, movie_id, rating, "timestamp", reasons FROM checked"""
    q["default_timestamps"] = f"""WITH {EVENTS}
SELECT event_id, CASE WHEN event_type IN ('signup', 'view') THEN {AS_OF} ELSE "timestamp" END AS "timestamp" FROM rating_events"""
    q["event_json"] = f"""WITH {RATINGS}
SELECT l_orderkey, l_linenumber, movie_id, '{{"event_type":"rating","user_id":' || user_id || ',"movie_id":' || movie_id || ',"rating":' || rating
  || ',"timestamp":' || ts || ',"datetime":"' || {datetime} || '"}}' AS value FROM ratings"""
    positions = f"SELECT {plain}, row_number() OVER (ORDER BY {order}) - 1 AS pos"
    q["replay_schedule"] = f"""WITH {RATINGS}, o AS ({positions} FROM ratings)
SELECT *, round((pos + 1) / 100.0::DOUBLE, 6) AS emit_offset_s FROM o"""
    q["replay_realtime"] = f"""WITH {RATINGS}
{positions}, CAST(ts - min(ts) OVER () AS DOUBLE) AS emit_offset_s FROM ratings"""
    q["chronological_head"] = f"""WITH {RATINGS}
SELECT {plain} FROM ratings ORDER BY {order} LIMIT {HEAD_EVENTS}"""
    q["stream_replay"] = f"""WITH {RATINGS} SELECT 'rating' AS event_type, {plain}, {datetime} AS "datetime" FROM ratings"""
    q["stream_replay_order"] = f"""WITH {RATINGS} SELECT row_number() OVER (ORDER BY {order}) - 1 AS arrival, {plain} FROM ratings"""
    q["ingest_outcomes"] = f"""WITH {CHECKED}
SELECT "timestamp" // 3600 * 3600 AS window_start,
  CASE event_type WHEN 'purchase' THEN 'logged' WHEN 'error' THEN 'failed' ELSE 'published' END AS status, count(*) AS n
FROM checked WHERE reasons = '' GROUP BY ALL"""

    q["request_log"] = """SELECT '/' || event_type AS endpoint, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
  value / 100 AS duration_s, epoch_us(ts) AS ts_us FROM events WHERE event_type <> 'signup'"""
    h = _buckets("request_log", "duration_s", monitor.REQUEST_SECONDS, "endpoint")
    q["latency_histogram"] = f"""WITH {LOG}, h AS ({h})
SELECT endpoint, "count", round("sum", 4) AS "sum", {_le_text()}, cum FROM h"""
    q["latency_quantiles"] = f"""WITH {LOG}, h AS ({h}),
s AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS lo, coalesce(lag(cum) OVER w, 0) AS below FROM h
  WINDOW w AS (PARTITION BY endpoint ORDER BY le))
SELECT endpoint, q.quantile, round(CASE WHEN isinf(le) THEN lo
  ELSE lo + (le - lo) * (q.quantile * "count" - below) / (cum - below) END, 6) AS value
FROM s CROSS JOIN (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) q(quantile) WHERE cum >= q.quantile * "count"
QUALIFY row_number() OVER (PARTITION BY endpoint, q.quantile ORDER BY le) = 1"""
    minute = 'CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS "minute"'
    q["candidate_count_histogram"] = f"""WITH {SERVING},
sizes AS (SELECT user_id, count(*) AS value FROM linear GROUP BY user_id),
h AS ({_buckets("sizes", "value", monitor.CANDIDATE_COUNTS, None)})
SELECT {_le_text()}, cum, "count", CAST("sum" AS BIGINT) AS "sum" FROM h"""
    q["recommend_latency_histogram"] = f"""WITH {LOG}, r AS (SELECT * FROM request_log WHERE endpoint = 'view'),
h AS ({_buckets("r", "duration_s", monitor.RECOMMEND_SECONDS, None)})
SELECT "count", round("sum", 4) AS "sum", {_le_text()}, cum FROM h"""
    q["lookup_latency_histogram"] = f"""WITH {LOG},
r AS (SELECT CASE WHEN endpoint = 'signup' THEN 'user' ELSE 'movie' END AS entity_type, duration_s / 10 AS duration_s FROM request_log WHERE endpoint <> 'view'),
h AS ({_buckets("r", "duration_s", monitor.LOOKUP_SECONDS, "entity_type")})
SELECT entity_type, "count", round("sum", 4) AS "sum", {_le_text()}, cum FROM h"""
    q["latency_quantile_series"] = _series(5, "endpoint")
    q["latency_quantiles_per_minute"] = _series(1, None)
    q["rate_per_minute"] = f"""WITH {LOG}
SELECT {minute}, endpoint, count(*) AS n, round(count(*) / 60.0::DOUBLE, 6) AS per_second FROM request_log GROUP BY 1, 2"""
    q["error_rate"] = f"""WITH {LOG}
SELECT {minute}, count(*) AS n, round(count(*) / 60.0::DOUBLE, 6) AS per_second FROM request_log
WHERE regexp_full_match(status, '5..') GROUP BY 1"""
    q["error_counts"] = f"""WITH {CHECKED}
SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM checked WHERE reasons <> '') GROUP BY reason"""

    q["rolling_7d_avg"] = f"""WITH {RATINGS}, t AS (SELECT DISTINCT user_id, ts FROM ratings)
SELECT t.user_id, t.ts AS "timestamp", count(*) AS rating_count, round(avg(r.rating), 6) AS avg_rating
FROM t JOIN ratings r ON r.user_id = t.user_id AND r.ts BETWEEN t.ts - 7 * 86400 AND t.ts GROUP BY ALL"""
    q["genre_affinity"] = f"""WITH {RATINGS}, {MOVIES}, t AS (
  SELECT user_id, rating, unnest(string_split(genres, '|')) AS genre FROM ratings JOIN movies USING (movie_id))
SELECT user_id, genre, count(*) AS rating_count, round(avg(rating), 6) AS avg_rating,
  round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM t GROUP BY user_id, genre"""
    q["windowed_user_stats"] = _windows(VALID, 86400, 86400)
    q["weekly_user_windows"] = _windows(VALID, 7 * 86400, 86400)
    q["stream_windowed_stats"] = f"""SELECT * FROM ({_windows(VALID, 86400, 86400)})
WHERE window_start + 86400 <= (SELECT epoch(max(ts)) - 3600 FROM {VALID})"""
    q["stream_running_totals"] = f"""SELECT user_id, count(*) AS rating_count, round(avg(r), 10) AS avg_rating,
  round(coalesce(stddev_samp(r), 0.0), 10) AS rating_stddev, max(epoch_us(ts)) AS event_timestamp
FROM (SELECT user_id, rating AS r, ts FROM {VALID}) GROUP BY user_id"""
    q["stream_movie_windows"] = f"""SELECT * FROM ({_windows(VALID, 86400, 86400, "movie_id")})
WHERE window_start + 86400 <= (SELECT epoch(max(ts)) - 3600 FROM {VALID})"""
    q["stream_movie_totals"] = f"""SELECT movie_id, count(*) AS rating_count, round(avg(r), 10) AS avg_rating,
  round(coalesce(stddev_samp(r), 0.0), 10) AS rating_stddev, max(epoch_us(ts)) AS event_timestamp
FROM (SELECT movie_id, rating AS r, ts FROM {VALID}) GROUP BY movie_id"""
    q["stream_genre_affinity"] = f"""WITH {MOVIES}, t AS (
  SELECT user_id, rating, unnest(string_split(genres, '|')) AS genre FROM {VALID} AS v JOIN movies USING (movie_id))
SELECT user_id, genre, count(*) AS rating_count, round(avg(rating), 9) AS avg_rating,
  round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 9) AS share FROM t GROUP BY user_id, genre"""
    parted = f"""WITH {CHECKED},
span AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events),
came AS (SELECT CAST((CAST(ts AS DATE) - lo) * 4 // (hi - lo + 1) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS batch_id,
    epoch_us(ts) AS ts_us, user_id, movie_id, rating FROM checked, span WHERE reasons = ''),
marks AS (SELECT c.batch_id, (SELECT max(ts_us) FROM came WHERE came.batch_id < c.batch_id) - 3600000000 AS watermark_us FROM range(5) AS c(batch_id)),
parted AS (SELECT came.*, watermark_us, coalesce((ts_us // 86400000000 + 1) * 86400000000 <= watermark_us, false) AS late
  FROM came JOIN marks USING (batch_id))"""
    q["stream_late_rows"] = f"""{parted} SELECT batch_id, ts_us, user_id, movie_id, rating FROM parted WHERE late"""
    q["stream_late_metrics"] = f"""{parted} SELECT m.batch_id, count(p.ts_us) AS n_rows, count(p.ts_us) FILTER (late) AS n_late, m.watermark_us
FROM marks AS m LEFT JOIN parted AS p USING (batch_id) GROUP BY ALL"""
    return q
