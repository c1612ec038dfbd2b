"""Similarity join on word shingles with Bayesian pruning of candidates (operator 2)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tastelake.llm.components import components
from tastelake.llm.textblocks import ALNUM, LOWER, PrimePowers, blocks, grams, mixed, spans
from tastelake.llm.winnowing import text_key
from tastelake.session import materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 5    # a pair at 0.8 shares no band with probability 3e-6
STEP = 32                   # MinHash values compared between two looks at the posterior
TOLERANCE = 1e-6            # a pair is dropped when the threshold is less likely than this
BLOCK_ROWS, BLOCK_SHINGLES = 500, 500_000
FILTER_WORDS = 1 << 20      # 64-bit words of the bitmap that keeps texts of no candidate out of the shuffle


def shingles(buf: np.ndarray, offsets: np.ndarray, powers: PrimePowers) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their texts. A text of fewer words than a shingle, but not none, is one."""
    low = LOWER[buf]
    starts, ends, rows = spans(ALNUM[low], offsets)
    words = powers.between(powers.prefixes(low), starts, ends)
    keys, first = grams(words, rows, SHINGLE)
    rows_of = rows[first]
    for n in range(1, SHINGLE):
        short, at = grams(words, rows, n)
        alone = np.bincount(rows, minlength=len(offsets) - 1)[rows[at]] == n
        keys, rows_of = np.concatenate([keys, short[alone]]), np.concatenate([rows_of, rows[at][alone]])
    order = np.lexsort((keys, rows_of))
    keys, rows_of = keys[order], rows_of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows_of[1:] != rows_of[:-1])
    return keys[new], rows_of[new]


def signatures(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """MinHash values of the sets keys[cuts[i]:cuts[i + 1]], none of them empty."""
    n = BANDS * BAND_ROWS
    seeds = mixed(np.arange(1, 2 * n + 1))
    out = np.empty((len(cuts) - 1, n), np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((keys ^ seeds[k]) * (seeds[n + k] | np.uint64(1)) >> np.uint64(16), cuts[:-1])
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, least number of equal ones with which a pair is still compared).

    With a uniform prior and m of n values equal, the similarity is Beta(m + 1, n - m + 1), and it reaches t with the
    probability that a binomial of n + 1 trials at t is at most m.
    """
    out = []
    for n in range(STEP, BANDS * BAND_ROWS + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = PrimePowers()
    for batch in batches:
        for i, j, buf, offsets in blocks(batch.column(2)):
            keys, rows = shingles(buf, offsets, powers)
            size = np.bincount(rows, minlength=j - i)
            some = np.flatnonzero(size)
            cuts = np.concatenate([[0], np.cumsum(size[some])])
            bands = np.zeros((j - i, BANDS), np.uint64)
            identity = np.zeros((j - i, 2), np.uint64)
            if len(some):
                values = signatures(keys, cuts).reshape(len(some), BANDS, BAND_ROWS)
                total = np.broadcast_to(mixed(np.arange(BANDS)), (len(some), BANDS)).copy()
                for k in range(BAND_ROWS):
                    total = mixed(total + values[:, :, k])
                bands[some] = total
                identity[some, 0] = np.add.reduceat(mixed(keys + np.uint64(0x51)), cuts[:-1])
                identity[some, 1] = np.add.reduceat(mixed(keys ^ np.uint64(0x3C6EF372FE94F82B)), cuts[:-1])
            lists = [row if n else None for row, n in zip(bands.astype(np.int64), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(size, pa.int64()), *(pa.array(identity[:, c].astype(np.int64)) for c in (0, 1)),
                 pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "set_a", "set_b", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = PrimePowers()
    names = [0, 1, 2, 3]
    for batch in batches:
        for i, j, buf, offsets in blocks(batch.column(4)):
            keys, rows = shingles(buf, offsets, powers)
            cuts = np.searchsorted(rows, np.arange(j - i + 1))
            values = signatures(keys, cuts).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(i, j - i) for c in names), pa.array([keys[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                 pa.array([v.tobytes() for v in values], pa.binary())], names=["root", "n_blocks", "rep", "copies", "keys", "sig"])


class Block:
    """Some sets of one candidate component."""

    def __init__(self, frame: pd.DataFrame):
        self.rep, self.copies = frame["rep"].to_numpy(), frame["copies"].to_numpy()
        self.sig = np.frombuffer(b"".join(frame["sig"]), np.uint16).reshape(len(frame), BANDS * BAND_ROWS)
        self.size = np.array([len(x) // 8 for x in frame["keys"]])
        self.keys = np.frombuffer(b"".join(frame["keys"]), np.uint64)
        self.cuts = np.concatenate([[0], np.cumsum(self.size)])


def linked(a: Block, b: Block, same: bool, threshold: float, plan: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of a, j of b) of at least the threshold; j > i if the blocks are the same."""
    codes, flat = np.unique(np.concatenate([a.keys, b.keys]), return_inverse=True)
    mine, other = flat[:len(a.keys)], flat[len(a.keys):]
    mark = np.zeros(len(codes), bool)
    for lo in range(0, len(a.rep), 64):
        i = np.arange(lo, min(lo + 64, len(a.rep)))
        alive = np.minimum.outer(a.size[i], b.size) >= threshold * np.maximum.outer(a.size[i], b.size) - 1e-9
        if same:
            alive &= np.arange(len(b.rep)) > i[:, None]
        x, y = np.nonzero(alive)
        equal, done = np.zeros(len(x), np.int64), 0
        for n, least in plan:
            part = np.empty(len(x), np.int64)
            for c in range(0, len(x), 20_000):
                part[c:c + 20_000] = (a.sig[i[x[c:c + 20_000]], done:n] == b.sig[y[c:c + 20_000], done:n]).sum(axis=1)
            equal = equal + part
            keep = equal >= least
            x, y, equal, done = x[keep], y[keep], equal[keep], n
        for k in np.unique(x):
            row, partners = i[k], y[x == k]
            mark[mine[a.cuts[row]:a.cuts[row + 1]]] = True
            if len(partners) * 8 > len(b.rep):
                common = np.add.reduceat(mark[other], b.cuts[:-1], dtype=np.int64)[partners]
            else:
                common = np.array([np.count_nonzero(mark[other[b.cuts[p]:b.cuts[p + 1]]]) for p in partners])
            mark[mine[a.cuts[row]:a.cuts[row + 1]]] = False
            union = a.size[row] + b.size[partners] - common
            good = partners[common >= threshold * union - 1e-9]
            if len(good):
                yield np.full(len(good), row), good


def _verify(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Links of each task's blocks: per set the copies it is linked to, and the least set it hangs together with."""
    plan = least_matches(threshold)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = group["low"].iloc[0], group["high"].iloc[0]
        first, second = Block(group[group["block"] == lo]), Block(group[group["block"] == hi])
        n, shift = len(first.rep), 0 if lo == hi else len(first.rep)
        rep = first.rep if lo == hi else np.concatenate([first.rep, second.rep])
        links, parent = np.zeros(len(rep), np.int64), list(range(len(rep)))

        def top(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        if n and len(second.rep):
            for i, j in linked(first, second, lo == hi, threshold, plan):
                links[i[0]] += second.copies[j].sum()
                np.add.at(links, j + shift, first.copies[i])
                for v in (j + shift).tolist():
                    p, q = top(int(i[0])), top(v)
                    if p != q:
                        if rep[q] < rep[p]:
                            p, q = q, p
                        parent[q] = p
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[some], "links": links[some], "hook": rep[[top(int(v)) for v in some]]})

    held: list[pd.DataFrame] = []
    for frame in frames:
        for _, group in frame.groupby(["root", "low", "high"], sort=False):
            if held and (held[0][["root", "low", "high"]].iloc[0].tolist() != group[["root", "low", "high"]].iloc[0].tolist()):
                yield solve(pd.concat(held))
                held = []
            held.append(group)
    if held:
        yield solve(pd.concat(held))


def _place(doc_id: str, key: str) -> tuple[Column, Column]:
    """Word and bit of a document in the bitmap."""
    h = F.xxhash64(doc_id, key)
    return F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def _likely(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``base`` whose bit is set by a row of ``wanted`` (vertex, key); others may pass, none is lost.

    The bitmap has at most FILTER_WORDS rows whatever the input, so it is broadcast.
    """
    word, bit = _place("vertex", "key")
    bitmap = wanted.select(word.alias("_w"), bit.alias("_bit")).groupBy("_w").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = _place("doc_id", "key")
    held = base.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bitmap), F.col("_word") == F.col("_w"))
    return held.filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*base.columns)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, key, class_id, n_links: one row per document.

    Two documents are linked if the Jaccard similarity of their sets of word shingles is ``threshold`` or more. n_links counts
    all linked documents, copies too; class_id is the least doc_id that links lead to.

    Documents with the same set are one vertex. Vertices that share a MinHash band, directly or over others, make a
    candidate component; it meets in blocks of bounded size, and each pair of blocks is one piece of work: pairs are
    compared by groups of MinHash values, dropped once the threshold is too unlikely, and the rest compared as whole
    sets. Links are counted and contracted where they are found, so no pair is a row.

    Words are those of A-Z lower-cased text; a text of one to four words is one shingle. A text without words (null, empty) is
    linked to none and its own class. Repeated rows are copies of each other. Rows of one doc_id are one class's name, whatever
    their texts; a row without doc_id has a null class and no links, as it cannot be named. Empty tables give no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    profile = materialise(base.filter("doc_id IS NOT NULL").mapInArrow(
        _profile, "doc_id long, key long, n long, set_a long, set_b long, bands array<long>"), "profiles")
    sets = materialise(profile.filter("n > 0").groupBy("set_a", "set_b").agg(
        F.min(F.struct("doc_id", "key", "n", "bands")).alias("r"), F.count("*").alias("copies")).select(
        "set_a", "set_b", F.col("r.doc_id").alias("rep"), F.col("r.key").alias("key"), F.col("r.n").alias("n"), "copies", F.col("r.bands").alias("bands")), "sets")
    banded = sets.select("rep", F.explode_outer("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").drop("z")
    edges = banded.join(shared, "band").filter("rep <> a").select(F.col("rep").alias("b"), "a").distinct()
    near = components(edges)
    chosen = materialise(near.join(sets.select(F.col("rep").alias("vertex"), "key", "n", "copies"), "vertex"), "candidates")
    blocks_of = chosen.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    wanted = chosen.join(blocks_of, "root").select("root", "n_blocks", F.col("vertex").alias("rep"), "copies", F.col("key").alias("_k"))
    texts = _likely(base, chosen).join(wanted, (F.col("doc_id") == F.col("rep")) & (F.col("key") == F.col("_k"))).dropDuplicates(["rep", "_k"])
    vectors = texts.select("root", "n_blocks", "rep", "copies", "text").mapInArrow(
        _sets, "root long, n_blocks int, rep long, copies long, keys binary, sig binary")
    placed = vectors.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    work = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "root", F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high"), "block", "rep", "copies", "keys", "sig")
    dealt = work.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    found = materialise(dealt.mapInPandas(lambda frames: _verify(frames, threshold), "rep long, links long, hook long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.filter("rep <> hook").select(F.col("rep").alias("a"), F.col("hook").alias("b")))
    known = sets.select("set_a", "set_b", "rep", "copies").join(links, "rep", "left").join(classes.withColumnRenamed("vertex", "rep"), "rep", "left")
    known = materialise(known.select(F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), F.coalesce("root", "rep").alias("class_id"),
                                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    joined = profile.select("doc_id", "key", "n", "set_a", "set_b").join(known, (F.col("n") > 0) & (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")), "left")
    out = joined.select("doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.unionByName(base.filter("doc_id IS NULL").select("doc_id", "key", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, without those of a class whose least doc_id is another's. Exact
    repeats of a row stay with it, as do rows without doc_id."""
    drop = near_duplicates(docs, threshold).filter("class_id <> doc_id").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    left = docs.join(drop, (docs["doc_id"] == F.col("_d")) & (text_key() == F.col("_k")), "left_anti")
    return left
