"""Removal of repeated byte strings by a hash-compared suffix sort (operator 10)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tastelake.llm.textblocks import Powers, arrow_rows, blocks, running
from tastelake.llm.winnowing import text_key
from tastelake.session import materialise

GRAM = 16                   # bytes of an anchor; every window selects the least-hashed one inside it
BUCKET_BYTES = 16 << 20     # text per bucket of anchors
FLUSH_RECORDS = 1_000_000   # anchors a task holds before it sends them
HOT_CONTEXTS = 64           # an anchor with more surroundings than this in one flush is sent once
FLUSH_WINDOWS = 200_000
FLUSH_BYTES = 4 << 20       # text of open ranges a task holds before it sends it
MEET_WINDOWS = 100_000      # about as many windows of ranges are cut out at once
WIDE_GROUP = 50_000         # open windows of one anchor that meet as text at most; those of more are dealt one by one
SORT_WINDOWS = 4_000        # about as many suffixes are sorted at once
SEVERAL = 255
FILTER_WORDS = 1 << 20      # 64-bit words of the bitmap of doc_ids with several texts
DEPTHS = (4, 9)             # bytes beside an anchor that short hashes cover, besides half the rest of a window
_WINDOW_BASE = 0xC2B2AE3D27D4EB4F

SPAN = "doc_id long, variant long, kind int, start long, end long, key long"
ALONE = -1                  # key of an open range whose windows are dealt one by one
REMOVED, OPEN = 0, 1


def pack(arrays: dict[str, np.ndarray], plain: tuple[str, ...] = ()) -> bytes:
    """Byte planes of the arrays; those not ``plain`` are compressed."""
    out = {}
    for name, a in arrays.items():
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        out[name] = (a.dtype.str, len(a), planes if name in plain else None, None if name in plain else pa.compress(planes, "zstd", asbytes=True))
    return pickle.dumps(out)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, (kind, n, planes, packed) in pickle.loads(blob).items():
        size = np.dtype(kind).itemsize
        if planes is None:
            planes = pa.decompress(packed, n * size, "zstd", asbytes=True)
        out[name] = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).reshape(n)
    return out


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` neighbours."""
    out, have = x, 1
    while have * 2 <= n:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    more = n - have
    return np.minimum(out[:-more], out[more:]) if more else out


def merged_spans(doc: np.ndarray, variant: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Union of spans, per document."""
    order = np.lexsort((start, variant, doc))
    doc, variant, start, end = doc[order], variant[order], start[order], end[order]
    if not len(doc):
        return {"doc_id": doc, "variant": variant, "start": start, "end": end}
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])])
    # the farthest end so far within a document: lift every document above the ones before it
    lift = (np.cumsum(other) - 1) * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + lift)
    first = other.copy()
    first[1:] |= (start + lift)[1:] > far[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(doc)) - 1
    return {"doc_id": doc[at], "variant": variant[at], "start": start[at], "end": (far - lift)[last]}


class Anchors:
    """Selected anchors of texts: the windows that select one, and what stands around it."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.powers = window, gram, Powers()

    def of(self, buf: np.ndarray, offsets: np.ndarray, doc: np.ndarray, variant: np.ndarray) -> dict[str, np.ndarray] | None:
        """Records (fp, ctx, doc, variant, s, r, at, left.., right..): the windows at s .. s + r - 1 select the anchor at s + at
        with hash fp; ctx is the hash of all their bytes; left and right are short hashes of the bytes beside the anchor, up
        to half of what a window has besides it, 0 where the text ends before."""
        n, k, width = len(buf), self.gram, self.window - self.gram + 1
        if n < self.window:
            return None
        prefix = self.powers.prefixes(buf)
        at = np.arange(n - k + 1)
        grams = self.powers.between(prefix, at, at + k)
        least = sliding_least(grams, width)
        ends = np.repeat(offsets[1:], np.diff(offsets))[:n - self.window + 1]
        inside = ends - np.arange(len(ends)) >= self.window
        change = least[1:] != least[:-1]
        s = np.flatnonzero(inside & np.concatenate([[True], change | ~inside[:-1]]))
        e = np.flatnonzero(inside & np.concatenate([change | ~inside[1:], [True]])) + 1
        if not len(s):
            return None
        fp = least[s]
        place = np.full(len(s), -1)
        for o in range(width):
            place[(place < 0) & (grams[s + o] == fp)] = o
        again = np.zeros(len(s), bool)  # the anchor's bytes stand more than once in these windows
        for o in range(2 * width):
            again |= (o > place) & (s + o < e + width - 1) & (grams[np.minimum(s + o, n - k)] == fp)
        row = np.searchsorted(offsets, s, "right") - 1
        half, p = (self.window - k) // 2, s + place

        def short(a: np.ndarray, size: int, fits: np.ndarray) -> np.ndarray:
            out = np.zeros(len(s), np.uint8)
            out[fits] = (self.powers.between(prefix, a[fits], a[fits] + size) % np.uint64(255)).astype(np.uint8) + 1
            return out

        return {"fp": fp, "ctx": self.powers.between(prefix, s, e + self.window - 1) & np.uint64((1 << 48) - 1),
                "doc": doc[row], "variant": variant[row], "s": (s - offsets[row]).astype(np.int32), "r": (e - s).astype(np.int32),
                "at": np.where(again, SEVERAL, place).astype(np.uint8)} | {
            f"left{d}": short(p - d, d, p - d >= offsets[row]) for d in (*DEPTHS, half)} | {
            f"right{d}": short(p + k, d, p + k + d <= offsets[row + 1]) for d in (*DEPTHS, half)}


def settle(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The records in order of anchor, surroundings and document, with: group (number of the anchor), n_ctx (its different
    surroundings) and later (the same surroundings stand in a smaller document, so all windows are removed)."""
    order = np.lexsort((x["doc"], x["r"], x["ctx"], x["fp"]))
    x = {k: v[order] for k, v in x.items()}
    n = len(order)
    new_fp = np.concatenate([[True], x["fp"][1:] != x["fp"][:-1]])
    new = new_fp | np.concatenate([[True], (x["ctx"][1:] != x["ctx"][:-1]) | (x["r"][1:] != x["r"][:-1])])
    group = np.cumsum(new_fp) - 1
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return x | {"group": group, "n_ctx": np.bincount(group[new], minlength=group[-1] + 1)[group] if n else group,
                "later": x["doc"] > x["doc"][first]}


def _spans(x: dict[str, np.ndarray], chosen: np.ndarray, reach: int) -> dict[str, np.ndarray]:
    """Removed bytes of the windows of the chosen records."""
    s = x["s"][chosen].astype(np.int64)
    return merged_spans(x["doc"][chosen], x["variant"][chosen], s, s + x["r"][chosen] + reach)


def open_ranges(x: dict[str, np.ndarray], chosen: np.ndarray, whole: np.ndarray, window: int, gram: int) -> tuple:
    """Windows [start, end) of the chosen records that another text with the anchor may hold.

    A window is an anchor with ``window - gram`` bytes beside it. An equal one has the same bytes on both sides, so where no other
    surroundings agree with a record's on a side beyond some depth, windows that reach beyond are left out; not for the
    records ``whole``.
    """
    i = np.flatnonzero(chosen)
    group, rest = x["group"][i], window - gram
    repeats = (x["at"] == SEVERAL) | (x["r"] > rest + 1)  # then windows may agree by another place of the anchor
    everything = whole[i] | (np.bincount(x["group"], repeats)[x["group"]][i] > 0)

    def reach(side: str) -> np.ndarray:
        """Most bytes that may agree."""
        most = np.full(len(i), DEPTHS[0] - 1)
        for d, beyond in zip((*DEPTHS, rest // 2), (*DEPTHS[1:], rest // 2, rest + 1)):
            code = x[f"{side}{d}"][i]
            _, inverse, count = np.unique(group * 256 + code, return_inverse=True, return_counts=True)
            most = np.where((count[inverse] > 1) & (code > 0), beyond - 1, most)
        return np.where(everything, rest, most)

    start = x["s"][i].astype(np.int64)
    end, p = start + x["r"][i], start + x["at"][i]
    begin = np.where(everything, start, np.maximum(start, p - reach("left")))
    stop = np.where(everything, end, np.minimum(end, p - (rest - reach("right")) + 1))
    keep = begin < stop
    return x["doc"][i][keep], x["variant"][i][keep], begin[keep], stop[keep], group[keep]


def _rows(kind: int, doc, variant, start, end, key=ALONE) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": doc, "variant": variant.astype(np.int64), "kind": np.full(len(doc), kind, np.int32), "start": start, "end": end,
                         "key": np.broadcast_to(np.int64(key), len(doc))})


def anchor_spans(docs: DataFrame, window: int, gram: int, n_buckets: int) -> DataFrame:
    """Spans to remove that whole surroundings of anchors prove (kind 0), and ranges of windows still open (kind 1).

    A task sends each surroundings once, with its smallest document; later ones of its own texts are settled at once. Of an
    anchor with many surroundings it sends one record and leaves the others open, so no anchor fills a bucket. The open ranges of any other anchor
    have its number as their key: equal windows select the same anchor, so they have the same key.
    """
    bits = np.uint64(n_buckets)
    sides = [f"{side}{d}" for side in ("left", "right") for d in (*DEPTHS, (window - gram) // 2)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(window, gram)
        held: list[dict[str, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            x = settle(joined(held))
            held.clear()
            hot = (x["n_ctx"] > HOT_CONTEXTS) & ~x["later"]
            flag = hot & np.concatenate([[True], x["group"][1:] != x["group"][:-1]])
            done = _spans(x, x["later"], window - 1)
            still = [x[c][hot] for c in ("doc", "variant")] + [x["s"][hot].astype(np.int64), (x["s"] + x["r"])[hot].astype(np.int64)]
            rows = np.flatnonzero((~x["later"] & ~hot) | flag)
            rows = rows[np.lexsort((x["s"][rows], x["doc"][rows]))]
            bucket = (x["fp"][rows] % bits).astype(np.int64)
            blobs, names = [], []
            for b in np.unique(bucket):
                i = rows[bucket == b]
                fp = x["fp"][i] // bits
                blobs.append(pack({
                    "fp_low": (fp & np.uint64(0xFFFFFFFF)).astype(np.uint32), "fp_high": (fp >> np.uint64(32) & np.uint64(0xFF)).astype(np.uint8),
                    "ctx_low": (x["ctx"][i] & np.uint64(0xFFFFFFFF)).astype(np.uint32), "ctx_high": (x["ctx"][i] >> np.uint64(32)).astype(np.uint16),
                    "doc": np.diff(x["doc"][i], prepend=0), "variant": x["variant"][i], "s": x["s"][i], "r": x["r"][i], "at": x["at"][i],
                    "hot": flag[i]} | {c: x[c][i] for c in sides}, plain=("fp_low", "fp_high", "ctx_low", "ctx_high", *sides)))
                names.append(int(b))
            extra = pack({f"d_{k}": v for k, v in done.items()} | dict(zip(("o_doc", "o_variant", "o_start", "o_end"), still)))
            names.append(names[0])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([*blobs, extra], pa.binary())], names=["bucket", "blob"])

        size = 0
        for batch in batches:
            ids, variants = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, j, buf, offsets in blocks(batch.column(2)):
                found = anchors.of(buf, offsets, ids[i:j].astype(np.int64), variants[i:j].astype(np.int64))
                if found:
                    held.append(found)
                    size += len(found["fp"])
                if size >= FLUSH_RECORDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        parts, out = [], []
        for blob in frame["blob"]:
            x = unpack(blob)
            if "d_start" in x:
                out.append(_rows(REMOVED, x["d_doc_id"], x["d_variant"], x["d_start"], x["d_end"]))
                out.append(_rows(OPEN, x["o_doc"], x["o_variant"], x["o_start"], x["o_end"]))
            else:
                x["fp"] = x.pop("fp_low").astype(np.uint64) | x.pop("fp_high").astype(np.uint64) << np.uint64(32)
                x["ctx"] = x.pop("ctx_low").astype(np.uint64) | x.pop("ctx_high").astype(np.uint64) << np.uint64(32)
                x["doc"] = np.cumsum(x["doc"])
                parts.append(x)
        if parts:
            x = settle(joined(parts))
            hot = np.bincount(x["group"], x["hot"])[x["group"]] > 0
            later = x["later"] & ~x["hot"]  # a flagged record is open already
            out.append(_rows(REMOVED, *_spans(x, later, window - 1).values()))
            *ranges, group = open_ranges(x, ~later & ~x["hot"] & ((x["n_ctx"] > 1) | hot), hot, window, gram)
            spread = (np.bincount(x["group"], x["hot"]) > 0) | (np.bincount(group, ranges[3] - ranges[2], x["group"][-1] + 1) > WIDE_GROUP)
            out.append(_rows(OPEN, *ranges, np.where(spread[group], ALONE, group * n_buckets + frame["bucket"].iloc[0])))
        return pd.concat(out, ignore_index=True)

    sent = docs.select("doc_id", "variant", "text").mapInArrow(send, "bucket long, blob binary")
    return sent.groupBy("bucket").applyInPandas(lambda frame: meet(frame), SPAN)


class Suffixes:
    """The first ``length`` bytes of suffixes, compared by prefix hashes."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.length = rows, rows.shape[1]
        self.prefix = np.zeros((len(rows), self.length + 1), np.uint64)
        for m in range(self.length):
            self.prefix[:, m + 1] = self.prefix[:, m] * np.uint64(_WINDOW_BASE) + rows[:, m] + np.uint64(1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b: a binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefix[a, mid] == self.prefix[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Suffix a is smaller than b (or equal, if ``ties``)."""
        n = self.common(a, b)
        whole = n >= self.length
        n = np.minimum(n, self.length - 1)
        return np.where(whole, ties, self.rows[a, n] < self.rows[b, n])

    def sort(self) -> np.ndarray:
        """The numbers of the suffixes in their order: a mergesort, all runs of a level merged together.

        The place of an entry in the merged run is its place in its own run and the number of smaller entries of the
        neighbour run, found by binary search.
        """
        order, n, run = np.arange(len(self.rows)), len(self.rows), 1
        while run < n:
            i = np.arange(n)
            start = i // (2 * run) * (2 * run)
            right = i - start >= run
            low = np.where(right, start, np.minimum(start + run, n))
            base, high = low.copy(), np.where(right, start + run, np.minimum(start + 2 * run, n))
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                # of equal suffixes those of the left run come first
                smaller = np.where(right[open_], self.before(order[mid], order[open_], True), self.before(order[mid], order[open_], False))
                low[open_] = np.where(smaller, mid + 1, low[open_])
                high[open_] = np.where(smaller, high[open_], mid)
            own = i - np.where(right, start + run, start)
            merged = np.empty_like(order)
            merged[start + own + (low - base)] = order
            order, run = merged, 2 * run
        return order

    def classes(self) -> np.ndarray:
        """A class number for each suffix, the same for the same bytes; neighbours in order are compared as bytes."""
        order = self.sort()
        equal = self.common(order[1:], order[:-1]) >= self.length
        equal[equal] = (self.rows[order[1:][equal]] == self.rows[order[:-1][equal]]).all(axis=1)
        out = np.empty(len(order), np.int64)
        out[order] = np.concatenate([[0], np.cumsum(~equal)])
        return out


def sent_windows(texts: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """The open windows as packed rows (bucket, blob).

    :param texts: doc_id, variant, text, ranges (array of start, end, key).

    Ranges with a key go to its bucket as text, so neighbouring windows share their bytes. Windows of the others are dealt by the hash of all
    their bytes, and each task sends one of equal ones with its smallest document.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(_WINDOW_BASE)
        held: list[dict[str, np.ndarray]] = []
        ranges_held: list[dict[str, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            x = joined(held)
            held.clear()
            order = np.lexsort((x["doc"], x["hash"]))
            x = {k: v[order] for k, v in x.items()}
            new = np.concatenate([[True], x["hash"][1:] != x["hash"][:-1]])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (x["doc"] > x["doc"][first]) & (x["bytes"] == x["bytes"][first]).all(axis=1)
            s = x["s"][later].astype(np.int64)
            done = merged_spans(x["doc"][later], x["variant"][later], s, s + window)
            bucket = (x["hash"] % np.uint64(n_buckets)).astype(np.int64)
            names, blobs = [], []
            for b in np.unique(bucket[~later]):
                i = np.flatnonzero(~later & (bucket == b))
                blobs.append(pack({"hash": x["hash"][i], "doc": x["doc"][i], "variant": x["variant"][i], "s": x["s"][i],
                                   "bytes": x["bytes"][i].reshape(-1)}, plain=("hash",)))
                names.append(int(b))
            names.append(names[0])
            blobs.append(pack({f"d_{k}": v for k, v in done.items()}))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        def flush_ranges() -> pa.RecordBatch:
            x = joined(ranges_held)
            ranges_held.clear()
            text, length = x.pop("text"), x["r"] + np.int64(window - 1)
            begin, bucket = np.cumsum(length) - length, x["key"] % n_buckets
            order = np.argsort(bucket, kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            blobs = []
            for i in np.split(order, starts[1:]):
                blobs.append(pack({"key": x["key"][i] // n_buckets, "doc": np.diff(x["doc"][i], prepend=0), "variant": x["variant"][i], "s": x["s"][i], "r": x["r"][i],
                                   "text": text[_indexes(begin[i], length[i])]}))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        size = text_size = 0
        for batch in batches:
            ids, variants = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            ranges = batch.column(3)
            for i, j, buf, offsets in blocks(batch.column(2)):
                mine = ranges.slice(i, j - i)
                count = np.array([len(x) for x in mine], np.int64)
                flat = mine.flatten()
                low, high, key = (flat.field(f).to_numpy(zero_copy_only=False) for f in range(3))
                row = np.repeat(np.arange(j - i), count)
                met = np.flatnonzero(key != ALONE)
                if len(met):
                    r = row[met]
                    text = buf[_indexes(offsets[r] + low[met], high[met] - low[met] + window - 1)]
                    ranges_held.append({"key": key[met], "doc": ids[i:j][r].astype(np.int64), "variant": variants[i:j][r].astype(np.int64),
                                        "s": low[met].astype(np.int32), "r": (high - low)[met].astype(np.int32), "text": text})
                    text_size += len(text)
                    if text_size >= FLUSH_BYTES:
                        yield flush_ranges()
                        text_size = 0
                row, low, high = (x[key == ALONE] for x in (row, low, high))
                row, s = np.repeat(row, high - low), _indexes(low, high - low)
                if not len(s):
                    continue
                prefix = powers.prefixes(buf)
                for a in range(0, len(s), FLUSH_WINDOWS):
                    r, start = row[a:a + FLUSH_WINDOWS], s[a:a + FLUSH_WINDOWS]
                    at = offsets[r] + start
                    held.append({"hash": powers.between(prefix, at, at + window), "doc": ids[i:j][r].astype(np.int64),
                                 "variant": variants[i:j][r].astype(np.int64), "s": start.astype(np.int32),
                                 "bytes": np.lib.stride_tricks.sliding_window_view(buf, window)[at]})
                    size += len(r)
                    if size >= FLUSH_WINDOWS:
                        yield flush()
                        size = 0
        if held:
            yield flush()
        if ranges_held:
            yield flush_ranges()

    return texts.select("doc_id", "variant", "text", "ranges").mapInArrow(send, "bucket long, blob binary")


def _indexes(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one after another."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def _cut_out(x: dict[str, np.ndarray], window: int) -> Iterator[dict[str, np.ndarray]]:
    """The windows of ranges that came as text, by whole keys and about MEET_WINDOWS at once."""
    powers = Powers(_WINDOW_BASE)
    text, length = x.pop("text"), x["r"] + np.int64(window - 1)
    x["at"] = np.cumsum(length) - length
    order = np.argsort(x["key"], kind="stable")
    x = {k: v[order] for k, v in x.items()}
    new = np.concatenate([[True], x["key"][1:] != x["key"][:-1]])
    before = np.cumsum(x["r"], dtype=np.int64) - x["r"]
    part = before[np.flatnonzero(new)[np.cumsum(new) - 1]] // MEET_WINDOWS  # the same for all ranges of a key
    for i in np.split(np.arange(len(part)), np.flatnonzero(part[1:] != part[:-1]) + 1):
        r = x["r"][i].astype(np.int64)
        own = text[_indexes(x["at"][i], r + window - 1)]
        at = _indexes(np.cumsum(r + window - 1) - (r + window - 1), r)
        yield {"hash": powers.between(powers.prefixes(own), at, at + window), "doc": np.repeat(x["doc"][i], r), "variant": np.repeat(x["variant"][i], r),
               "s": _indexes(x["s"][i].astype(np.int64), r).astype(np.int32), "bytes": np.lib.stride_tricks.sliding_window_view(own, window)[at]}


def _later_windows(x: dict[str, np.ndarray], window: int) -> pd.DataFrame:
    """Spans of the windows that stand in a smaller document too. Suffixes whose hash is not alone are sorted, and neighbours compared as bytes."""
    order = np.argsort(x["hash"], kind="stable")
    same = x["hash"][order][1:] == x["hash"][order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    order = order[twice]
    if not len(order):  # no window stands twice
        return _rows(REMOVED, *np.zeros((4, 0), np.int64))
    x = {k: v[order] for k, v in x.items()}
    new = np.concatenate([[True], x["hash"][1:] != x["hash"][:-1]])
    begins, group = np.flatnonzero(new), np.cumsum(new) - 1
    # one suffix per hash is sorted, and those that have its hash but not its bytes
    odd = ~new & (x["bytes"] != x["bytes"][begins[group]]).any(axis=1)
    part = (group // SORT_WINDOWS).astype(np.int64)
    later = [np.zeros(0, np.int64)]
    for k in range(part[-1] + 1):
        lo, hi = np.searchsorted(part, [k, k + 1])
        sorted_ = lo + np.flatnonzero(new[lo:hi] | odd[lo:hi])
        kinds = Suffixes(x["bytes"][sorted_]).classes()
        own = np.searchsorted(sorted_, np.where(odd[lo:hi], np.arange(lo, hi), begins[group[lo:hi]]))
        kind, doc = kinds[own], x["doc"][lo:hi]
        least = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, doc)
        later.append(lo + np.flatnonzero(doc > least[kind]))
    later = np.concatenate(later)
    s = x["s"][later].astype(np.int64)
    return _rows(REMOVED, *merged_spans(x["doc"][later], x["variant"][later], s, s + window).values())


def window_spans(texts: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """Spans to remove among the open windows of :func:`sent_windows`; equal ones meet in a bucket."""
    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        windows, ranges, out = [], [], [_rows(REMOVED, *np.zeros((4, 0), np.int64))]
        for blob in frame["blob"]:
            x = unpack(blob)
            if "d_start" in x:
                out.append(_rows(REMOVED, x["d_doc_id"], x["d_variant"], x["d_start"], x["d_end"]))
            elif "text" in x:
                ranges.append(x | {"doc": np.cumsum(x["doc"])})
            else:
                windows.append(x | {"bytes": x["bytes"].reshape(-1, window)})
        if windows:
            out.append(_later_windows(joined(windows), window))
        if ranges:
            out += [_later_windows(x, window) for x in _cut_out(joined(ranges), window)]
        return pd.concat(out, ignore_index=True)

    return sent_windows(texts, window, n_buckets).groupBy("bucket").applyInPandas(lambda frame: meet(frame), SPAN)


def _variants(named: DataFrame) -> DataFrame:
    """``named`` with variant: 0 where a doc_id has one text, else the 64-bit key of the row's text.

    doc_ids with several texts are found by their least and greatest key and marked in a bitmap of at most FILTER_WORDS rows
    whatever the input, so it is broadcast; a doc_id that shares a bit with one of them has its key too, which changes nothing.
    """
    h = F.xxhash64("doc_id")
    word, bit = F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    several = named.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b")
    bitmap = materialise(several.select(word.alias("_w"), bit.alias("_bit")).groupBy("_w").agg(F.bit_or("_bit").alias("_bits")), "several-texts")
    marked = named.withColumn("_word", word).join(F.broadcast(bitmap), F.col("_word") == F.col("_w"), "left")
    own = F.coalesce(F.col("_bits"), F.lit(0).cast("long")).bitwiseAND(bit) != 0
    return marked.withColumn("variant", F.when(own, F.col("key")).otherwise(F.lit(0).cast("long"))).drop("key", "_word", "_w", "_bits")


def without_repeated_bytes(docs: DataFrame, window: int = 50, gram: int = GRAM, keep: list[str] | None = None, kept_bytes: str = "kept_bytes",
                           bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with spans (array of start, end in bytes: what is removed), n_bytes, n_removed, n_spans and the bytes that remain.

    Every byte covered by a string of ``window`` bytes that also starts in a document with a smaller doc_id is removed.
    Strings overlap freely, are judged on the input and lie inside one text.

    A null text is empty; texts under ``window`` bytes lose nothing. A row without doc_id is not smaller than any other and loses nothing. Rows
    of one doc_id do not remove anything from each other; each is judged by its own text. Empty tables stay empty; columns named like the new ones are
    replaced. Whole texts are searched, however long.
    """
    new = {"n_bytes", "n_removed", "n_spans", "spans", kept_bytes}
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    row = F.struct(*[docs[c] for c in names if c != "text"], F.lit(0).alias("_")).alias("_row")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"), row)
    named = _variants(base.filter("doc_id IS NOT NULL"))
    # without other columns both joins below shuffle the same texts, and Spark does so once
    texts = named.select("doc_id", "variant", "text")
    alone = names == ["doc_id"] and docs.schema["doc_id"].dataType == T.LongType()
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(16, -(-total // bucket_bytes))
    found = materialise(anchor_spans(texts, window, gram, n_buckets), "anchor-spans")
    pair = F.struct("start", "end")
    still = found.filter(F.col("kind") == OPEN).groupBy("doc_id", "variant").agg(F.collect_list(F.struct("start", "end", "key")).alias("ranges"))
    proved = found.filter(F.col("kind") == REMOVED)
    more = window_spans(texts.join(still, ["doc_id", "variant"]), window, n_buckets)
    spans = proved.unionByName(more).groupBy("doc_id", "variant").agg(F.array_sort(F.collect_list(pair)).alias("spans"))
    near = texts.join(spans, ["doc_id", "variant"], "left").withColumn("_row", F.struct("doc_id", F.lit(0).alias("_"))) if alone else \
        named.join(spans, ["doc_id", "variant"], "left")
    joined_ = near.select("text", "spans", "_row").unionByName(
        base.filter("doc_id IS NULL").select("text", "_row").withColumn("spans", F.lit(None).cast("array<struct<start:bigint,end:bigint>>")))
    out = T.StructType([base.schema["_row"], T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                        *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField(kept_bytes, T.BinaryType())])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of = batch.column(1)
            for i, j, buf, offsets in blocks(batch.column(0)):
                mine = spans_of.slice(i, j - i)
                count = np.array([len(x) if x.is_valid else 0 for x in mine], np.int64)
                flat = mine.flatten()
                start, end = (flat.field(f).to_numpy(zero_copy_only=False) for f in (0, 1))
                row = np.repeat(np.arange(j - i), count)
                u = merged_spans(row, np.zeros(len(row), np.int64), start, end)
                step = np.zeros(len(buf) + 1, np.int64)
                np.add.at(step, offsets[u["doc_id"]] + u["start"], 1)
                np.add.at(step, offsets[u["doc_id"]] + u["end"], -1)
                gone = np.cumsum(step)[:-1] > 0
                left = running(~gone)[offsets]
                rest = buf[~gone].tobytes()
                n_spans = np.bincount(u["doc_id"], minlength=j - i)
                values = pa.StructArray.from_arrays([pa.array(u["start"]), pa.array(u["end"])], names=["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]), pa.int32()), values).cast(span_type)
                size = np.diff(offsets)
                yield arrow_rows(batch, ["_row"], i, j, {
                    "spans": lists, "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(size - np.diff(left), pa.int64()),
                    "n_spans": pa.array(n_spans, pa.int64()), kept_bytes: pa.array([rest[a:b] for a, b in zip(left[:-1], left[1:])], pa.binary())})

    done = joined_.select("text", "spans", "_row").mapInArrow(cut, out)
    return done.select(*[f"_row.`{c}`" for c in names if c != "text"], "spans", "n_bytes", "n_removed", "n_spans", kept_bytes)
