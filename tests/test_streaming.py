import json

import pytest
from pyspark.sql import functions as F

from tastelake.operators import rolling
from tastelake.sources import versions
from tastelake.streaming import ingest, replay, rolling as stream_rolling
from tests.conftest import rows

NOW = 1_700_000_000


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, *events):
        (folder / name).write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events) + "\n")

    return str(folder), put


def event(user, rating=3.0, **more):
    return {"user_id": user, "movie_id": 1, "rating": rating, "timestamp": 100, **more}


def test_ingest_continues_where_it_stopped(spark, inbox, tmp_path):
    folder, put = inbox
    out = str(tmp_path / "out")
    put("a.json", event(1), event(0), "{broken")
    ingest.ingest(ingest.read_lines(spark, folder), out, F.lit(NOW))
    put("b.json", event(2, timestamp=0), event(3, rating=9))
    ingest.ingest(ingest.read_lines(spark, folder), out, F.lit(NOW))
    assert rows(spark.read.parquet(f"{out}/valid"), "user_id", "timestamp") == [(1, 100), (2, NOW)]
    assert rows(spark.read.parquet(f"{out}/quarantine"), "user_id") == [(None,), (0,), (3,)]
    assert rows(spark.read.parquet(f"{out}/outcomes").groupBy("status").count()) == [("published", 2)]


def test_a_replayed_batch_leaves_its_rows_once(spark, tmp_path):
    batch = spark.createDataFrame([(json.dumps(event(1)),)], "value string")
    def away(lines):
        raise ConnectionError("no broker")

    write = ingest.batch_writer(str(tmp_path), primary=away)
    write(batch, 0)
    write(batch, 0)
    for name in ("valid", "outcomes"):
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 1
    assert spark.read.option("recursiveFileLookup", True).text(f"{tmp_path}/logged").count() == 1
    assert spark.read.parquet(f"{tmp_path}/quarantine").count() == 0


def test_one_clock_per_batch(spark, tmp_path):
    batch = spark.createDataFrame([(json.dumps(event(1, timestamp=None)),)], "value string")

    def away(lines):
        raise ConnectionError("no broker")

    ingest.batch_writer(str(tmp_path), primary=away)(batch, 0)
    valid, outcome = (spark.read.parquet(f"{tmp_path}/{n}").first()["timestamp"] for n in ("valid", "outcomes"))
    line = spark.read.option("recursiveFileLookup", True).text(f"{tmp_path}/logged").first()["value"]
    assert valid == outcome == json.loads(line)["timestamp"]


def test_events_are_logged_while_the_broker_is_away(spark, inbox, tmp_path):
    folder, put = inbox
    put("a.json", event(1), event(2))

    def away(lines):
        raise ConnectionError("no broker")

    out = ingest.ingest(ingest.read_lines(spark, folder), str(tmp_path / "out"), primary=away)
    logged = [json.loads(r["value"])["user_id"] for r in spark.read.option("recursiveFileLookup", True).text(f"{out}/logged").collect()]
    assert sorted(logged) == [1, 2]
    assert rows(spark.read.parquet(f"{out}/outcomes").select("status").distinct()) == [("logged",)]


def test_windows_close_in_order_and_late_rows_are_counted(spark, inbox):
    folder, put = inbox
    row = lambda s, r: json.dumps({"s": s, "user_id": 1, "rating": r})

    def run():
        source = spark.readStream.schema("s long, user_id long, rating double").option("maxFilesPerTrigger", 1).json(folder)
        stats = stream_rolling.windowed_stream(source.withColumn("ts", F.timestamp_seconds("s")), "user_id", "1 hour")
        return stream_rolling.drain_windows(stats)

    import os
    for i, (name, lines) in enumerate({
            "1": [row(10, 1.0), row(3700, 2.0)], "2": [row(20, 3.0), row(10_900, 4.0)],  # out of order within the hour
            "3": [row(30_000, 1.0)],
            "4": [row(30, 5.0)]}.items()):  # behind the watermark of the batch before
        put(name, *lines)
        os.utime(f"{folder}/{name}", (1_000 + i, 1_000 + i))
    closed, late = run()
    assert rows(closed, "window_start", "rating_count", "avg_rating") == [(0, 2, 2.0), (3600, 1, 2.0), (10_800, 1, 4.0)]
    assert late == 1


def test_running_totals_equal_the_batch(spark, inbox, tmp_path, ratings):
    folder, put = inbox
    data = [r.asDict() for r in ratings.collect()]
    for i in range(0, 10, 4):
        put(str(i), *data[i:i + 4])
    source = spark.readStream.schema(ratings.schema).option("maxFilesPerTrigger", 1).json(folder)
    path = str(tmp_path / "totals")
    stream_rolling.running_totals(source, "user_id", path).awaitTermination()
    online = stream_rolling.online_table(spark, path, "user_id")
    cols = ["user_id", "rating_count", "avg_rating", "event_timestamp"]
    assert rows(online, *cols) == rows(rolling.running_stats(ratings, "user_id"), *cols)


def test_totals_of_two_keys(spark, inbox, tmp_path, ratings):
    folder, put = inbox
    data = [r.asDict() for r in ratings.collect()]
    for i in range(0, 10, 3):
        put(str(i), *data[i:i + 3])
    movies = spark.createDataFrame([(m, "x|y" if m % 2 else "y") for m in sorted({r["movie_id"] for r in data})], "movie_id long, genres string")
    source = spark.readStream.schema(ratings.schema).option("maxFilesPerTrigger", 1).json(folder)
    path = str(tmp_path / "affinity")
    stream_rolling.running_totals(rolling.genre_events(source, movies), ["user_id", "genre"], path).awaitTermination()
    cols = ["user_id", "genre", "rating_count", "avg_rating", "share"]
    got = rolling.with_share(stream_rolling.online_table(spark, path, ["user_id", "genre"]))
    assert rows(got, *cols) == rows(rolling.genre_affinity(ratings, movies), *cols)


def test_replay_in_time_order(spark, ratings, tmp_path):
    path = str(tmp_path / "events")
    assert replay.write_replay(ratings.orderBy(F.desc("timestamp")), path, max_events=7, chunks=3) == 7
    assert spark.read.text(path).count() == 7
    seen = []
    source = replay.read_replay(spark, path)
    query = (source.writeStream.foreachBatch(lambda df, _: seen.append([json.loads(r["value"])["timestamp"] for r in df.collect()]))
             .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    query.awaitTermination()
    times = [t for batch in seen for t in batch]
    assert times == sorted(times) == [1_000_000 + 100 * i for i in range(7)] and len(seen) >= 3


def test_late_rows_of_all_batches_are_counted(spark, inbox):
    folder, put = inbox
    import os
    schema = "user_id long, rating double, ts timestamp"
    rows_of = [f'{{"user_id": 1, "rating": 3.0, "ts": "2024-01-{d:02d}T00:00:00Z"}}' for d in (20, 1, 2, 3, 21, 4)]
    for i, line in enumerate(rows_of):
        path = os.path.join(folder, f"{i}.json")
        with open(path, "w") as file:
            file.write(line)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
        _, late = stream_rolling.drain_windows(stream_rolling.windowed_stream(source, "user_id", "1 day"))
        assert spark.conf.get("spark.sql.streaming.numRecentProgressUpdates") == "2"
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert late == 3  # a batch drops what is behind the watermark of the batch before the last


def test_totals_are_compacted(spark, inbox, tmp_path):
    """The table takes as many folders after many batches as after a few, and a replayed batch changes nothing."""
    folder, put = inbox
    schema, path = "user_id long, rating double, timestamp long", str(tmp_path / "totals")
    events = []
    for batch in range(9):
        new = [{"user_id": 1 + (batch * 3 + i) % 4, "rating": 0.5 * (1 + batch % 5), "timestamp": batch * 10 + i} for i in range(3)]
        events += new
        put(f"{batch}.json", *new)
        source = spark.readStream.schema(schema).json(folder)
        stream_rolling.running_totals(source, "user_id", path, compact_every=2).awaitTermination()
        if batch in (0, 1, 4, 8):
            cols = ["user_id", "rating_count", "avg_rating", "rating_stddev", "event_timestamp"]
            now = stream_rolling.online_table(spark, path, "user_id", compact_every=2)
            want = rolling.running_stats(spark.createDataFrame(events, schema), "user_id")
            rounded = lambda df: df.withColumn("rating_stddev", F.round("rating_stddev", 9))
            assert rows(rounded(now), *cols) == rows(rounded(want), *cols)
    names = sorted(p.name for p in (tmp_path / "totals").iterdir())
    assert names == ["base", "batch-0", "batch-1", "batch-2", "batch-3"]
    assert len(list((tmp_path / "totals" / "base").iterdir())) == 2 * versions.SLOTS


def test_late_rows_are_kept_beside(spark, inbox, tmp_path):
    folder, put = inbox
    root, source = str(tmp_path / "parted"), lambda: spark.readStream.schema("s long").json(folder)
    timed = lambda: source().withColumn("ts", F.timestamp_seconds("s"))
    for name, times in (("a", [100, 8000, None]), ("b", [3599, 3600, 5000, 20_000]), ("c", [7199, 12_000, 16_399, 16_400])):
        put(f"{name}.json", *[{"s": t} for t in times])
        stream_rolling.part_late(timed(), root, width=3600).awaitTermination()
    late = spark.read.parquet(f"{root}/late")
    assert rows(late, "batch_id", "s") == [(0, None), (1, 3599), (2, 7199), (2, 12_000)]  # watermarks 4,400 and 16,400: windows up to 3,600 and 14,400 have ended
    assert rows(spark.read.parquet(f"{root}/timely"), "s") == [(100,), (3600,), (5000,), (8000,), (16_399,), (16_400,), (20_000,)]
    metrics = rows(spark.read.parquet(f"{root}/metrics"), "batch_id", "n_rows", "n_late", "watermark")
    assert metrics == [(0, 3, 1, None), (1, 4, 1, 4400 * 10**6), (2, 4, 2, 16_400 * 10**6)]
    assert len(list((tmp_path / "parted" / "watermark").iterdir())) == 2 * versions.SLOTS


def test_late_by_their_own_time(spark, inbox, tmp_path):
    folder, put = inbox
    root = str(tmp_path / "parted")
    for name, times in (("a", [10_000]), ("b", [6399, 6400, 6401])):
        put(f"{name}.json", *[{"s": t} for t in times])
        timed = spark.readStream.schema("s long").json(folder).withColumn("ts", F.timestamp_seconds("s"))
        stream_rolling.part_late(timed, root).awaitTermination()
    assert rows(spark.read.parquet(f"{root}/late"), "s") == [(6399,)]


def test_ordered_replay(spark, ratings, tmp_path):
    path, seen = str(tmp_path / "ordered"), []
    shuffled = ratings.repartition(5, "movie_id")
    assert replay.write_ordered_replay(shuffled, path, max_events=7, chunks=3) == 7

    def deliver(df, chunk):
        seen.append([json.loads(r["value"])["timestamp"] for r in df.collect()])

    replay.play_ordered(spark, path, deliver, str(tmp_path / "checkpoint")).awaitTermination()
    assert len(seen) == 3 and sum(seen, []) == [1_000_000 + 100 * i for i in range(7)]
    replay.play_ordered(spark, path, deliver, str(tmp_path / "checkpoint")).awaitTermination()
    assert len(seen) == 3  # nothing is delivered twice


def test_a_missing_chunk_is_an_error(spark, ratings, tmp_path):
    path = str(tmp_path / "ordered")
    replay.write_ordered_replay(ratings, path, chunks=1)
    spark.createDataFrame([("2",)], "value string").coalesce(1).write.mode("append").text(f"{path}/commits")
    with pytest.raises(Exception, match="committed where 1 is due"):
        replay.play_ordered(spark, path, lambda df, chunk: df.count(), str(tmp_path / "checkpoint")).awaitTermination()
