"""The pipeline stage by stage, on a small table with planted cases."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import brute, data

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    clean = [data.prose(rng, 80) for _ in range(60)]
    item = data.prose(rng, 30)
    shared = "\n".join(data.prose(rng, 6) for _ in range(4))
    texts = [*clean, clean[3], clean[4] + " and one", " ".join(f"{w}###" for w in data.prose(rng, 60).split()), None, "",
             clean[5] + " " + item, data.prose(rng, 90) + "\n" + shared, data.prose(rng, 90) + "\n" + shared]
    texts += [" ".join(f"{w}###" for w in data.prose(rng, 60).split()) for _ in range(20)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, data.prose(rng, 40), None, None, None)]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([("b", item)], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = STAGES["quality_rules"](spark, docs, folder)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and ids == set(texts) - {62, 63, 64, *range(68, 88)}

    lines = STAGES["line_dedup"](spark, kept, folder)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}
    assert set(got) == ids
    want = brute.line_dedup([(d, texts[d]) for d in ids if d is not None])
    assert all(got[d] == (text, len(text)) for d, (_, _, text) in want.items()) and got[None][0] == texts[None]
    assert got[67][0] == texts[67].split("\n")[0] and got[66][0] == texts[66]

    one = STAGES["near_duplicates"](spark, lines, folder)
    classes = brute.near_duplicates([(d, t) for d, (t, _) in got.items() if d is not None])
    assert {r["doc_id"] for r in one.collect()} == {d for d, (c, _) in classes.items() if c == d} | {None}

    clean = STAGES["decontamination"](spark, one, folder)
    assert {r["doc_id"] for r in one.collect()} - {r["doc_id"] for r in clean.collect()} == {65}

    done = STAGES["encoding"](spark, clean, folder)
    assert done.count() == clean.count() and done.filter("octet_length(ids) <> 4 * n_tokens").count() == 0


def test_run_and_empty_tables(spark, folder, tmp_path):
    stay = corpus_pipeline.run(spark, folder)
    # document 60 repeats a long line: it stays without text
    assert stay.count() == 64 and stay.filter("doc_id = 60 AND n_tokens = 0").count() == 1 and stay.filter("doc_id IS NULL").count() == 1
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
