"""Decontamination, line dedup, similarity join and byte dedup against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tastelake.llm import decontamination, jaccard_join, line_dedup, suffix_dedup
from tastelake.llm.components import components
from tests.llm import brute, data


@pytest.fixture(scope="module")
def docs():
    return data.documents()


@pytest.fixture(scope="module")
def table(spark, docs):
    return data.frame(spark, docs)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_contamination(spark, docs, table, broadcast_rows):
    items = data.items(docs)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.contamination(table, bench, broadcast_rows=broadcast_rows)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()) == sorted(brute.contamination(docs, items))
    clean = {d for d, _, hit, _ in brute.contamination(docs, items) if not hit}
    left = decontamination.without_contaminated(table, bench)
    assert left.columns == table.columns and {r["doc_id"] for r in left.collect()} == clean


def test_contamination_of_nothing(spark, table):
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontamination.contamination(table, none).agg(F.sum("n_hit")).first()[0] == 0
    assert decontamination.contamination(table.limit(0), none).count() == 0


def test_contamination_of_repeated_and_unnamed_rows(spark):
    text = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"
    df = spark.createDataFrame([(1, text), (1, text), (1, "other"), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), ("a", text)], "item_id string, text string")
    got = decontamination.contamination(df, bench).collect()
    assert sorted((r["doc_id"] or 0, r["n_hit"], tuple(r["items"])) for r in got) == [(0, 11, ("a",)), (1, 0, ()), (1, 11, ("a",)), (1, 11, ("a",))]


def test_line_dedup(docs, table):
    got = line_dedup.without_repeats(table)
    assert {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["text"] or "") for r in got.collect()} == brute.line_dedup(docs)
    assert set(table.columns) <= set(got.columns)


def test_line_dedup_of_one_copied_text(spark):
    text = "\n".join(f"line {i} of a text" for i in range(5))
    df = spark.createDataFrame([(i, text) for i in range(60)] + [(None, text), (3, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_deleted"]) for r in line_dedup.without_repeats(df).collect())
    assert got == sorted([(-1, 0), (3, 5)] + [(i, 5) for i in range(60)])
    assert line_dedup.without_repeats(df.limit(0)).count() == 0


def test_line_dedup_of_short_runs(spark):
    one = "a single line of less than sixty letters that is copied"
    two = ["the first of two lines", "and the second one, of some thirty"]
    passage = [data.prose(random.Random(1), 30), data.prose(random.Random(2), 30)]
    docs = [(1, "\n".join([one, "own line", *two, "end"])), (2, "\n".join(["before", *two, "", one, "behind"])),
            (3, "\n".join([two[0], "not the second", two[1]])), (4, "\n".join(["x", *passage, "short tail", "y"])),
            (5, "\n".join([*passage, "short tail", "z"])), (6, "\n".join(["ha ha ha"] * 30)), (7, "short tail\nz\n\n"), (8, "\n".join(["  " + one, one + "  "]))]
    rng = random.Random(3)
    parts = ["yes", "no", "a b", "line of some length here", "another line, rather long, of fifty characters or so.", "", " "]
    docs += [(20 + i, "\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    got = {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["text"]) for r in line_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.line_dedup(docs)
    assert got[2][2] == "before\nbehind" and got[3][1] == 0 and got[5][2] == "z" and got[6][2] == "ha ha ha" and got[7][1] == 0


def test_line_dedup_of_a_long_text(spark):
    rng = random.Random(4)
    lines = [f"{rng.random()} is the number of this line, which stands in both of the texts" if i % 3 else f"short {i % 7}" for i in range(20_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(f"{x}{' own' if i % 5 == 0 else ''}" for i, x in enumerate(lines)))], "doc_id long, text string")
    got = line_dedup.without_repeats(df).filter("doc_id = 2").first()
    assert got["n_deleted"] > 10_000 and got["n_runs"] > 3_000 and got["n_lines"] == 20_000


@pytest.mark.parametrize("block_rows", [500, 4])
def test_near_duplicates(docs, table, block_rows):
    got = jaccard_join.near_duplicates(table, block_rows=block_rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got.collect()} == brute.near_duplicates(docs)


@pytest.mark.parametrize("words", [1, 7])
def test_near_duplicates_with_a_crowded_bitmap(docs, table, monkeypatch, words):
    monkeypatch.setattr(jaccard_join, "FILTER_WORDS", words)
    got = jaccard_join.near_duplicates(table)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got.collect()} == brute.near_duplicates(docs)


def test_one_of_each(spark, docs, table):
    kept = {d for d, (c, _) in brute.near_duplicates(docs).items() if c == d}
    assert {r["doc_id"] for r in jaccard_join.one_of_each(table).collect()} == kept
    lone = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert jaccard_join.one_of_each(lone).count() == 2 and jaccard_join.near_duplicates(lone.limit(0)).count() == 0


def test_least_matches():
    plan = jaccard_join.least_matches()
    assert [n for n, _ in plan] == [32, 64, 96, 128, 160] and all(0 < m < 0.8 * n for n, m in plan)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in (7, *range(200, 260))}}


def _bytes(result):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in result.collect()}


def test_byte_dedup(docs, table):
    assert _bytes(suffix_dedup.without_repeated_bytes(table)) == brute.byte_dedup(docs)


def test_byte_dedup_of_periods_and_hot_strings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 2)
    monkeypatch.setattr(suffix_dedup, "SORT_WINDOWS", 16)
    passage = "the passage that many of the documents share and that is long enough"
    docs = [(i, f"{i * 7919} before {passage} behind {i % 5}") for i in range(40)]
    docs += [(50 + i, "ab" * (40 + i) + "x" + "to " * (30 - i)) for i in range(8)] + [(70, None), (71, ""), (72, "é" * 60), (73, "é" * 61)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffix_dedup.without_repeated_bytes(df, keep=["doc_id"])
    assert _bytes(got) == brute.byte_dedup(docs)
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in got.collect()}
    assert all(sum(b - a for a, b in spans[d]) == n for d, (_, n, _, _) in brute.byte_dedup(docs).items())


def test_byte_dedup_of_unnamed_rows(spark):
    text = "x" * 20 + "the same text in every row of this small table, sixty bytes"
    df = spark.createDataFrame([(None, text), (None, text), (4, text), (4, text), (9, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.without_repeated_bytes(df).collect())
    assert got == [(0, 0), (0, 0), (4, 0), (4, 0), (9, len(text))]
    assert suffix_dedup.without_repeated_bytes(df.limit(0)).count() == 0


def test_byte_dedup_of_a_few_rows(spark):
    passage = "a passage of letters that two of the rows hold, the second with a number behind it"
    three = [(1, passage), (2, passage + " number 1710"), (3, "another text that has nothing in common with the other two rows of it")]
    got = suffix_dedup.without_repeated_bytes(spark.createDataFrame(three, "doc_id long, text string"))
    assert _bytes(got) == brute.byte_dedup(three) and {r["doc_id"]: r["n_removed"] for r in got.collect()} == {1: 0, 2: len(passage), 3: 0}
    rng = random.Random(8)
    for n in (2, 3, 5, 9, 14, 20):
        parts = [data.prose(rng, rng.randrange(4, 25)) for _ in range(4)]
        docs = [(i * 3, " ".join(rng.choice([rng.choice(parts), data.prose(rng, 12)]) for _ in range(rng.randrange(1, 4)))) for i in range(n)]
        assert _bytes(suffix_dedup.without_repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string"))) == brute.byte_dedup(docs)


def test_byte_dedup_of_two_texts_of_one_id(spark):
    rng = random.Random(9)
    shared, own = data.prose(rng, 30), data.prose(rng, 40)
    # short hashes of some of these texts agree; every one is judged by itself
    rows = [(1, shared), *[(7, f"{own} {i}" if i % 2 else f"{shared} {i}") for i in range(400)], (7, f"{own} 1"), (8, "short"), (8, None)]
    got = suffix_dedup.without_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep=["doc_id"])
    left = sorted(r["n_removed"] for r in got.filter("doc_id = 7").collect())
    assert left == [0] * 201 + [len(shared)] * 200
    assert got.filter("doc_id <> 7 AND n_removed > 0").count() == 0


@pytest.mark.parametrize("wide", [0, 60, 50_000])
def test_byte_dedup_in_small_pieces(spark, docs, table, monkeypatch, wide):
    """Ranges of an anchor meet as text, or window by window where an anchor has many."""
    for name, value in (("WIDE_GROUP", wide), ("MEET_WINDOWS", 40), ("FLUSH_BYTES", 500), ("FLUSH_WINDOWS", 300)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert _bytes(suffix_dedup.without_repeated_bytes(table, bucket_bytes=2_000)) == brute.byte_dedup(docs)


def test_open_ranges_travel_as_text(spark):
    """Every window was sent with all its bytes, about 40 after compression."""
    rng = random.Random(10)
    texts = [(i, 0, data.prose(rng, 200), [(5, 405, i % 9)]) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, variant long, text string, ranges array<struct<start: long, end: long, key: long>>")
    sent = suffix_dedup.sent_windows(df.coalesce(1), 50, 4)
    assert sent.agg(F.sum(F.length("blob"))).first()[0] < 60 * 400 * 2
    assert {r["bucket"] for r in sent.collect()} == {0, 1, 2, 3}


def test_suffix_order():
    import numpy as np
    rows = np.array([list(b"banana"), list(b"ananas"), list(b"banana"), list(b"anabas"), list(b"zzzzzz")], np.uint8)
    s = suffix_dedup.Suffixes(rows)
    assert [bytes(rows[i]).decode() for i in s.sort()] == ["anabas", "ananas", "banana", "banana", "zzzzzz"]
    kinds = s.classes()
    assert kinds[0] == kinds[2] and len(set(kinds.tolist())) == 4
    assert s.common(np.array([1]), np.array([3])).tolist() == [3]
