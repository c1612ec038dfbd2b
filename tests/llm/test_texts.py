"""Encoding, chat format, quality, token counts and URL filter."""

import json
import random
import time
import struct

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tastelake.llm import bpe, chat, classifier, quality_rules, textblocks, token_counts, url_reputation
from tests.llm import brute, data

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe_equals_the_library():
    codec, library, rng = bpe.Codec(open(WORD_BPE, encoding="utf-8").read()), Tokenizer.from_file(WORD_BPE), random.Random(2)
    texts = ["", " \n", "İstanbul ΣΑΣ é ́x a\x1cb\x85c", "<|endoftext|>hi <|startoftext|>", "a" * 3000, "'LL don't 1234 ''s", "漢字 😀 Ⅷ ½ ﬁ"]
    texts += ["".join(rng.choice("abcdeét'sl1 \n.#İΣσ\u0301") for _ in range(60)) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x370), rng.randrange(0x370, 0xD7FF)])) for _ in range(40)) for _ in range(500)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = codec.encode(text)
        assert packed == struct.pack(f"<{len(ids)}I", *ids)
        assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_bpe_keeps_a_bounded_number_of_bytes():
    codec, rng = bpe.Codec(open(WORD_BPE, encoding="utf-8").read(), cache_bytes=1 << 16), random.Random(3)
    for _ in range(20):  # whole paragraphs without a blank, and many different words
        codec.encode("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(4000)))
        codec.encode(" ".join(f"w{rng.randrange(10 ** 9)}é" for _ in range(500)) + " " + " ".join(str(rng.random()) for _ in range(500)))
    for kept in (codec.words, codec.plain, codec.chunks):
        assert sum(len(k) * 4 + len(v) for part in (kept, kept.old) for k, v in part.items()) <= 2 << 16
        assert all(len(k) <= bpe.CACHED_CHARS for k in kept)
    assert len(codec.vocabulary._fits) <= bpe.KNOWN_PAIRS


def test_bpe_refuses_other_tokenizers(spark, tmp_path):
    parts = json.load(open(WORD_BPE, encoding="utf-8"))
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": None}, {"decoder": {"type": "BPEDecoder", "suffix": "</w>"}},
                   {"model": parts["model"] | {"end_of_word_suffix": None}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(parts | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.encode(spark.range(1).selectExpr("'x' text"), str(path))


def test_bpe_tables(spark):
    df = spark.createDataFrame([(1, "Hello  world", 5), (2, None, 6), (3, "", 7), (1, "Hello  world", 5)], "doc_id long, text string, ids int")
    got = bpe.encode(df, WORD_BPE, decoded="decoded").orderBy("doc_id", "n_tokens").collect()
    assert [(r["doc_id"], r["n_tokens"], r["decoded"]) for r in got] == [(1, 2, "hello</w> world</w>")] * 2 + [(2, 0, ""), (3, 0, "")]
    again = bpe.decode(bpe.encode(df, WORD_BPE).select("doc_id", "ids"), WORD_BPE).orderBy("doc_id").first()
    assert again["decoded"] == "hello</w> world</w>" and bpe.encode(df.limit(0), WORD_BPE).count() == 0


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "<part>\\b\\l\\", "", None, "a\nb</turn>\n<turn>user\n", "\\\\l<"]
    rows = [(c, t, ["user", "assistant", "sys\ntem<", None][(c + t // 2) % 4], odd[(c * 3 + t) % 6]) for c in range(12) for t in range(c)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    got = chat.format_conversations(df).select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"),
                                               F.size(F.split("formatted", "<turn>")).alias("blocks")).collect()
    assert len(got) == 11
    for r in got:
        want = [(role or "", text or "") for c, _, role, text in sorted(rows, key=lambda x: x[:2]) if c == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")
        assert r["blocks"] - 1 == sum(i == 0 or want[i - 1][0] != want[i][0] for i in range(len(want)))


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 700, 20_000])
def test_chat_of_many_turns(spark, n):
    """Sums over chunks of turns and spans over blocks of text; 20,000 turns took 25 s when each turn copied those before."""
    df = spark.range(n).selectExpr("1L conv_id", "id turn", "IF(id % 3 = 0, 'user', 'assistant') role", "concat('é<', id, repeat('x', int(id % 1500 = 7) * 3000)) text")
    started = time.time()
    r = chat.format_conversations(df).select(chat.parse(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"),
                                             "formatted", "loss_spans").first()
    assert time.time() - started < 20
    want = [("assistant" if i % 3 else "user", f"é<{i}" + "x" * 3000 * (i % 1500 == 7)) for i in range(n)]
    assert [tuple(t) for t in r["turns"]] == want
    assert r["loss"] == "".join(text for role, text in want if role == "assistant")
    assert [r["formatted"][s:s + k].replace("\\l", "<") for s, k in r["loss_spans"]] == [text for role, text in want if role == "assistant"]


def test_chat_rows_without_a_conversation(spark):
    df = spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "a"), (5, None, "user", "b"), (5, 0, "assistant", "c")],
                               "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df).select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()
    assert sorted(((r["conv_id"] or 0), [x["text"] for x in r["t"]]) for r in got) == [(0, ["a"]), (0, ["a"]), (5, ["b", "c"])]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_quality_measures(spark):
    docs = data.documents() + [(900, "x y\nx y\n\n \nx y"), (901, "### a|b <c> 100% $5 & *"), (902, "a b c d e a b c d e f")]
    got = quality_rules.rate(data.frame(spark, docs), np.zeros(1 << quality_rules.BUCKET_BITS), 0.0)
    assert {r["doc_id"]: tuple(r[m] for m in quality_rules.MEASURES) for r in got.collect()} == {d: brute.measures(t) for d, t in docs}
    failed = {d: m[0] < 10 or 100 * m[4] > 20 * m[0] for d, m in ((d, brute.measures(t)) for d, t in docs)}
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got.collect()} == {d: (f, not f) for d, f in failed.items()}


def test_lines_that_collide_modulo_a_power_of_two(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ab"[1 - x] for x in bits)
    docs = [(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{a}"), (3, " ".join([a, "x", "y", "z", "w", b, "x", "y", "z", "w"]))]
    got = quality_rules.rate(spark.createDataFrame(docs, "doc_id long, text string"), np.zeros(1 << quality_rules.BUCKET_BITS), 0.0)
    assert {r["doc_id"]: tuple(r[m] for m in quality_rules.MEASURES) for r in got.collect()} == {d: brute.measures(t) for d, t in docs}


def test_prime_hashes_of_long_texts(monkeypatch):
    powers = textblocks.PrimePowers()
    buf = np.frombuffer(random.Random(5).randbytes(5000), np.uint8)
    whole = powers.prefixes(buf)
    monkeypatch.setattr(textblocks.PrimePowers, "CHUNK", 7)
    assert all((x == y).all() for x, y in zip(whole, textblocks.PrimePowers().prefixes(buf)))
    twice = np.concatenate([buf[100:900], buf[:50], buf[100:900]])
    prefix = powers.prefixes(twice)
    at = np.array([0, 850, 850]), np.array([800, 1650, 1649])
    h = powers.between(prefix, *at)
    assert h[0] == h[1] != h[2]


def test_quality_keeps_what_is_like_the_trusted(spark):
    rng = random.Random(4)
    clean = [(i, data.prose(rng, 80)) for i in range(150)]
    junk = [(1000 + i, " ".join(f"{w}***" for w in data.prose(rng, 60).split())) for i in range(40)]
    got = quality_rules.quality(spark.createDataFrame(clean + junk, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(75)] + [(None,)], "doc_id long"))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert all(kept[d] for d, _ in clean) and not any(kept[d] for d, _ in junk)
    none = quality_rules.quality(spark.createDataFrame(clean, "doc_id long, text string"), spark.createDataFrame([], "doc_id long"))
    assert none.agg(F.max(F.abs("log_ratio"))).first()[0] == 0
    assert quality_rules.quality(none.limit(0).select("doc_id", F.lit("").alias("text")), spark.createDataFrame([], "doc_id long")).count() == 0


def test_quality_counts_all_trusted(spark):
    docs = spark.range(20_300).select(F.col("id").alias("doc_id"), F.lit("alpha beta").alias("text"))
    assert quality_rules._counted(quality_rules._target(docs, docs.filter("doc_id < 20200").union(docs.limit(5)).select("doc_id"))).sum() == 3 * 20_200
    assert quality_rules._counted(docs).sum() == 3 * 20_300


def test_quality_threshold_moves_with_the_trusted(spark):
    rng = random.Random(5)
    rows = [(i, data.prose(rng, 60)) for i in range(600)]
    rows += [(1000 + i, " ".join(f"{w}***" if k % 4 == 0 else w for k, w in enumerate(data.prose(rng, 60).split()))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, most in ((8, 60), (60, 60), (500, 0)):  # eight documents cannot tell, and must not drop what is clean
        kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality(df, spark.range(n).toDF("doc_id")).collect()}
        assert sum(kept[d] for d in range(600)) >= 585 and sum(kept[d] for d in range(1000, 1060)) <= most


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(8)
    marks = {0: ["vile", "rotten"], 1: ["***", "%%%"], 2: []}
    rows = []
    for i in range(900):
        grade = i % 3
        w = data.prose(rng, 40).split()
        for _ in range(3 if marks[grade] else 0):
            w.insert(rng.randrange(len(w)), rng.choice(marks[grade]))
        rows.append((i, " ".join(w), grade))
    df = spark.createDataFrame(rows + [(5000, None, None), (5001, "", 2)], "doc_id long, text string, grade int").repartition(3)
    model = classifier.fit(df.select("doc_id", "text"), df.filter("doc_id < 700").select("doc_id", "grade"), 3)
    assert (np.diff(model.cuts) > 0).all()
    got = classifier.score(df, model, 2).collect()
    held = [r for r in got if 700 <= r["doc_id"] < 900]
    order = sorted(held, key=lambda r: r["tail_probability"])
    good = sum(r["grade"] == 2 for r in held)
    assert sum(r["grade"] == 2 for r in order[-good:]) >= 0.95 * good
    assert not any(r["kept"] for r in held if r["grade"] == 0)
    mean = {g: np.mean([r["expected_grade"] for r in held if r["grade"] == g]) for g in range(3)}
    assert mean[0] < mean[1] < mean[2]
    bare = [r["tail_probability"] for r in got if r["doc_id"] >= 5000]
    assert len(bare) == 2 and bare[0] == bare[1] and 0 < bare[0] < 1
    assert classifier.score(df.limit(0), model, 2).count() == 0


def test_classifier_fit_takes_one_row_per_document(spark, monkeypatch):
    seen, to_pandas = [], type(spark.range(0)).toPandas
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda self: (seen.append(to_pandas(self)), seen[-1])[1])
    rows = [(1, "a vile text"), (1, "another vile text"), (2, "a good text")]
    df = spark.createDataFrame(rows + rows[:1] * 50, "doc_id long, text string").repartition(3)
    grades = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int")
    many = classifier.fit(df, grades, 2)
    assert [len(x) for x in seen] == [2]
    once = min([df.filter(f"doc_id = 2 OR text = '{t}'").dropDuplicates() for t in ("a vile text", "another vile text")],
               key=lambda one: float(np.abs(classifier.fit(one, grades, 2).weights - many.weights).max()))
    assert np.allclose(classifier.fit(once, grades, 2).weights, many.weights) and np.allclose(classifier.fit(once, grades, 2).cuts, many.cuts)


def _sections(text, tokens, rule):
    """Plain attribution of tokens (bytes) to lines."""
    raw = text.encode()
    lines = raw.splitlines(keepends=True) if raw else [b""]
    lines = [x + b"\n" for x in raw.split(b"\n")[:-1]] + ([raw.split(b"\n")[-1]] if raw.split(b"\n")[-1] or not raw else [])
    owner = [k for k, line in enumerate(lines) for _ in line]
    out, at = [0] * len(lines), 0
    for t in tokens:
        mine = owner[at:at + len(t)]
        out[mine[0] if rule == "first" else mine[-1] if rule == "last" else max(sorted(set(mine)), key=mine.count)] += 1
        at += len(t)
    return list(enumerate(out)), [len(x.decode("utf-8", "ignore")) for x in lines]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(spark, rule):
    import tiktoken
    ranks = token_counts.read_ranks(RANKS)
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "\n", "a\n\n\n  b\n", "one line", "é😀\n   漢字\n\n\nend", "x" * 5000 + "\n" + "y" * 10, "", "  \n \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_counts.section_tokens(df, RANKS, public_tokenizers.PATTERN, rule=rule).orderBy("doc_id", "section").collect()
    for i, text in enumerate(texts):
        ids = encoder.encode_ordinary(text or "")
        want, sizes = _sections(text or "", [encoder.decode_single_token_bytes(x) for x in ids], rule)
        mine = [r for r in got if r["doc_id"] == i]
        assert [(r["section"], r["n_tokens"]) for r in mine] == want and [r["n_chars"] for r in mine] == sizes
        assert [r["start_char"] for r in mine] == [sum(sizes[:k]) for k in range(len(sizes))] and sum(r["n_tokens"] for r in mine) == len(ids)


def test_field_tokens(spark):
    df = spark.createDataFrame([(1, "Title", None, "body text"), (2, None, None, None)], "doc_id long, title string, note string, body string")
    got = token_counts.field_tokens(df, RANKS, public_tokenizers.PATTERN, ["title", "note", "body"]).orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["section"], r["n_chars"]) for r in got] == [(1, 0, 6), (1, 1, 1), (1, 2, 9), (2, 0, 1), (2, 1, 1), (2, 2, 0)]
    assert token_counts.field_tokens(df.limit(0), RANKS, public_tokenizers.PATTERN, ["title"]).count() == 0
    with pytest.raises(ValueError, match="rule"):
        token_counts.section_tokens(df, RANKS, public_tokenizers.PATTERN, text="title", rule="none")


def test_url_parts_and_rules(spark):
    urls = ["HTTP://A.Example.ORG/en/1x?q#f", "http://example.org", "https://xexample.org/es/", "http://b.com/de/?x", "http://c.com?/de/", None, "no scheme/", "a://b://c/d"]
    rules = [("org", "/", "allow"), ("example.org", "/en/1", "block"), ("com", "/de/", "block")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "host string, good boolean")
    got = url_reputation.judged(df.withColumn("host", F.lit(1)), none, rules).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [
        ("a.example.org", "/en/1x", "example.org/en/1", "block"), ("example.org", "", None, "allow"), ("xexample.org", "/es/", "org/", "allow"),
        ("b.com", "/de/", "com/de/", "block"), ("c.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow")]


def test_reputation_shrinks_to_the_domain(spark):
    rows = [("bad.spam.net", False)] * 30 + [("few.spam.net", False)] * 1 + [("few.good.net", False)] * 1 + [("a.good.net", True)] * 40 + [("b.good.net", True)] * 40 + [(None, True), ("x.y", None)]
    known = {r["host"]: r for r in url_reputation.reputation(spark.createDataFrame(rows, "host string, good boolean")).hosts.collect()}
    assert set(known) == {"bad.spam.net", "few.spam.net", "few.good.net", "a.good.net", "b.good.net"}
    assert known["bad.spam.net"]["mean"] < known["few.spam.net"]["mean"] < known["few.good.net"]["mean"] < known["a.good.net"]["mean"]
    pages = spark.createDataFrame([(1, "http://bad.spam.net/"), (2, "http://new.spam.net/"), (3, "http://a.good.net/"), (4, "http://else.dev/")], "page_id long, url string")
    got = url_reputation.judged(pages, spark.createDataFrame(rows, "host string, good boolean"), [])
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_unlabelled_hosts_have_the_prior(spark):
    # 300 hosts of a suffix, 49.5 % good, the pooled pages alone would block all others
    rows = [(f"h{i}.d{i}.net", (i * 7 + k) % 200 < 99) for i in range(300) for k in range(20)]
    outcomes = spark.createDataFrame(rows + [("hot.co.uk", False)] * 400 + [("other.co.uk", True)] * 3, "host string, good boolean")
    urls = ["http://new.d5.net/", "http://new.else.net/", "http://h7.d7.net/", "http://hot.co.uk/", "http://www.hot.co.uk/", "http://third.co.uk/", "http://a.dev/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_reputation.judged(pages, outcomes, [], ["co.uk"]).collect()}
    known = url_reputation.reputation(outcomes, ["co.uk"])
    means = {r["suffix"]: r["mean"] for r in known.ends.collect()}
    s, m = known.strength(2), means["net"]
    assert known.strength(3) < known.strength(2) < known.strength(1) <= 1000 + 1e-6
    assert got[1]["bound"] == pytest.approx(m + 1.645 * (m * (1 - m) / (s + 1)) ** 0.5)
    assert got[1]["verdict"] == "allow" and got[3]["verdict"] == "block" and got[6]["verdict"] == "allow"
    domains = {r["domain"]: r["mean"] for r in known.domains.collect()}
    assert {"hot.co.uk", "other.co.uk", "d5.net"} <= set(domains) and got[4]["verdict"] == "block"
    c = means["co.uk"]
    assert got[5]["bound"] == pytest.approx(c + 1.645 * (c * (1 - c) / (s + 1)) ** 0.5)
    assert url_reputation.judged(pages.limit(0), outcomes, []).count() == 0
    none = url_reputation.judged(pages, outcomes.limit(0), []).collect()
    assert {r["verdict"] for r in none} == {"allow"} and len(none) == 7
