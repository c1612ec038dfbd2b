"""Product codes of integer vectors: codebooks in rounds over Hilbert-sorted blocks (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tastelake.llm.vectors import common_width, floors, usable, usable_rows
from tastelake.session import materialise

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
CHUNK_ROWS = 1 << 16       # vectors sorted together; places in a chunk fit 16 bits
BLOCK_ROWS = 128
HILBERT_BITS = 8
LABEL_BYTES = 16 * 1024 * 1024   # sums of labels up to this size are broadcast
SALTS = 32


def hilbert(points: np.ndarray, bits: int = HILBERT_BITS) -> np.ndarray:
    """Places of integer points on a Hilbert curve over their bounding box.

    The box is laid on a grid of ``2 ** bits`` cells a side, fewer where the place would not fit 63 bits. The order only
    makes blocks compact; nothing else depends on it.
    """
    points = points[:, :63]
    n, dims = points.shape
    bits = max(1, min(bits, 63 // dims))
    low = points.min(axis=0)
    span = max(int((points.max(axis=0) - low).max()), 1)
    x = np.minimum(((points - low) * ((1 << bits) - 1)) // span, (1 << bits) - 1).T.copy()
    side = 1 << (bits - 1)
    while side > 1:  # undo the rotations, the coarsest cells first
        low_bits = side - 1
        for d in range(dims):
            turned = (x[d] & side) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low_bits)
            x[0] = np.where(turned, x[0] ^ low_bits, x[0] ^ swap)
            x[d] ^= swap
        side >>= 1
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    flip = np.zeros(n, np.int64)
    side = 1 << (bits - 1)
    while side > 1:
        flip ^= np.where((x[dims - 1] & side) != 0, side - 1, 0)
        side >>= 1
    x ^= flip
    place = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << 1) | ((x[d] >> bit) & 1)
    return place


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Flags block x entry: the entry may be the nearest of some point of the block's box.

    An entry is left out when even the box's nearest corner to it is farther than another entry is from all of the box.
    """
    least = np.zeros((len(low), len(book)), np.int64)
    most = np.zeros_like(least)
    for d in range(book.shape[1]):
        below, above = low[:, d, None] - book[:, d], book[:, d] - high[:, d, None]
        least += np.maximum(np.maximum(below, above), 0) ** 2
        most += np.maximum(np.abs(below), np.abs(above)) ** 2
    return least <= most.min(axis=1)[:, None]


def _pack_chunk(points: np.ndarray) -> dict[str, bytes | int]:
    """A chunk's parts, each sorted along its own curve and cut into blocks with boxes and sums."""
    n, width = points.shape
    step = width // PARTS
    starts = np.arange(0, n, BLOCK_ROWS)
    small = points.dtype if not n else np.int16 if np.abs(points).max() < 1 << 15 else np.int32
    orders, flat, low, high, total = [], [], [], [], []
    for p in range(PARTS):
        part = points[:, p * step:(p + 1) * step]
        order = np.argsort(hilbert(part), kind="stable")
        part = part[order]
        orders.append(order.astype(np.uint16))
        flat.append(part.astype(small))
        low.append(np.minimum.reduceat(part, starts))
        high.append(np.maximum.reduceat(part, starts))
        total.append(np.add.reduceat(part, starts))
    return {"n": n, "bytes_each": np.dtype(small).itemsize, "orders": np.concatenate(orders).tobytes(), "points": np.concatenate(flat).tobytes(),
            "boxes": np.stack([np.concatenate(low), np.concatenate(high)]).astype(np.int32).tobytes(), "sums": np.concatenate(total).tobytes()}


class _Chunk:
    """A packed chunk, read back."""

    def __init__(self, row: dict, width: int):
        self.n, self.step = row["n"], width // PARTS
        self.blocks = -(-self.n // BLOCK_ROWS)
        self.points = np.frombuffer(row["points"], f"<i{row['bytes_each']}").reshape(PARTS, self.n, self.step)
        self.low, self.high = np.frombuffer(row["boxes"], "<i4").reshape(2, PARTS, self.blocks, self.step).astype(np.int64)
        self.sums = np.frombuffer(row["sums"], "<i8").reshape(PARTS, self.blocks, self.step) if row.get("sums") is not None else None
        self.orders = np.frombuffer(row["orders"], "<u2").reshape(PARTS, self.n) if row.get("orders") is not None else None

    def nearest(self, p: int, book: np.ndarray, alone: bool) -> Iterator[tuple[int, slice, np.ndarray | int, np.ndarray | None]]:
        """(block, its points, entry of each, squared distance of each) of one part.

        With ``alone`` a block whose shortlist is one entry is not looked into: its entry is a number, without distances.
        """
        flags = shortlists(self.low[p], self.high[p], book)
        for b in range(self.blocks):
            at = slice(b * BLOCK_ROWS, min((b + 1) * BLOCK_ROWS, self.n))
            entries = np.flatnonzero(flags[b])
            if alone and len(entries) == 1:
                yield b, at, int(entries[0]), None
                continue
            points, short = self.points[p, at].astype(np.int64), book[entries]
            far = np.zeros((len(points), len(entries)), np.int64)
            for d in range(self.step):
                far += (points[:, d, None] - short[:, d]) ** 2
            best = far.argmin(axis=1)  # the first of equals: entries ascend
            yield b, at, entries[best], far[np.arange(len(points)), best]


def _packed(df: DataFrame, width: int) -> DataFrame:
    """Usable rows of (kept, label, vec), a chunk of them a row: kept and label as an array of structs, and the packed parts."""
    names, vec = ["kept", "label"], "vec"
    kept = T.StructType([df.schema[c] for c in names])
    schema = T.StructType([T.StructField("rows", T.ArrayType(kept)), T.StructField("n", T.LongType()), T.StructField("bytes_each", T.LongType()),
                           *[T.StructField(c, T.BinaryType()) for c in ("orders", "points", "boxes", "sums")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, points, size = [], [], 0

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            rows = pa.StructArray.from_arrays([c.chunk(0) for c in table.columns], names=table.column_names)
            packed = _pack_chunk(np.concatenate(points))
            return pa.RecordBatch.from_pydict({"rows": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)}
                                              | {c: pa.array([packed[c]], pa.int64() if isinstance(packed[c], int) else pa.binary()) for c in packed})

        for batch in batches:
            good, found = usable_rows(batch.column(batch.schema.get_field_index(vec)), width)
            batch, found = batch.select(names).filter(pa.array(good)), floors(found, SCALE)
            while len(found):
                take = min(len(found), CHUNK_ROWS - size)
                held.append(batch.slice(0, take))
                points.append(found[:take])
                batch, found, size = batch.slice(take), found[take:], size + take
                if size == CHUNK_ROWS:
                    yield chunk()
                    held, points, size = [], [], 0
        if size:
            yield chunk()

    return df.select(*names, vec).mapInArrow(run, schema)


def _round(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one assignment: every entry becomes the floored mean of its parts; unused entries stay."""
    parts, entries, step = books.shape
    totals = [f"t{d}" for d in range(step)]
    schema = "part int, entry int, n long, " + ", ".join(f"{t} long" for t in totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, step), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, parts * step)
                for p in range(parts):
                    for b, at, entry, _ in chunk.nearest(p, books[p], alone=True):
                        if isinstance(entry, int):
                            counts[p, entry] += at.stop - at.start
                            sums[p, entry] += chunk.sums[p, b]
                        else:
                            np.add.at(counts[p], entry, 1)
                            np.add.at(sums[p], entry, chunk.points[p, at].astype(np.int64))
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e])}
                                         | {t: pa.array(sums[p, e, d]) for d, t in enumerate(totals)})

    found = (chunks.select("n", "bytes_each", "points", "boxes", "sums").mapInArrow(run, schema)
             .groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in totals]))
    books = books.copy()
    for row in found.collect():  # at most parts x entries rows
        books[row["part"], row["entry"]] = [row[t] // row["n"] for t in totals]
    return books


def fit(chunks: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) after ``rounds`` of assignment and replacement from the vectors ``first``."""
    books = first.reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _round(chunks, books)
    return books


def coded(chunks: DataFrame, books: np.ndarray, code: str = "code", error: str = "error") -> DataFrame:
    """The rows of the chunks with the entries of their parts as hexadecimal digits and the squared distance to them."""
    kept = chunks.schema["rows"].dataType.elementType
    schema = T.StructType([*kept.fields, T.StructField(code, T.StringType()), T.StructField(error, T.LongType())])
    parts, _, step = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows = one.column(0).flatten()
                chunk = _Chunk(one.drop_columns(["rows"]).to_pylist()[0], parts * step)
                codes, errors = np.zeros((chunk.n, parts), np.uint8), np.zeros(chunk.n, np.int64)
                for p in range(parts):
                    for _, at, entry, far in chunk.nearest(p, books[p], alone=False):
                        places = chunk.orders[p, at]
                        codes[places, p] = entry
                        errors[places] += far
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array([text[k:k + 2 * parts] for k in range(0, len(text), 2 * parts)]), pa.array(errors)],
                                                 names=[*kept.names, code, error])

    return chunks.select("rows", "n", "bytes_each", "orders", "points", "boxes").mapInArrow(run, schema)


def with_label_sum(df: DataFrame, label: str, value: str, total: str, broadcast_bytes: int = LABEL_BYTES) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its label; null labels are one label.

    Sums of all labels are one small row a label. Up to ``broadcast_bytes`` they go to every executor; more of them meet
    the rows in a shuffle, every label in ``SALTS`` places, so a hot label is no single task.
    """
    sums = materialise(df.groupBy(label).agg(F.sum(value).alias(total)), "label-sums").withColumnRenamed(label, "_label")
    size = sums.agg(F.sum(F.coalesce(F.octet_length(F.col("_label").cast("string")), F.lit(0)) + 24)).first()[0] or 0
    same = F.col(label).eqNullSafe(F.col("_label"))
    if size <= broadcast_bytes:
        return df.join(F.broadcast(sums), same).drop("_label")
    left = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    right = sums.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right.hint("shuffle_hash"), same & (F.col("_salt") == F.col("_copy"))).drop("_label", "_salt", "_copy")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers in order of part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, vec: str = "embedding", key: str = "vec_id", label: str = "label", keep: list[str] | None = None,
             dim: int | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows with ``code``, ``error`` and ``label_error``, and the codebooks.

    Components become floor(256 x). Vectors are cut into 16 equal parts; a part position's codebook starts as that part of the
    64 rows with the smallest key (null keys last, then the smaller vector), and is fitted in ``rounds`` over all rows. Every
    task packs its rows in chunks: per part sorted along a Hilbert curve, in flat blocks with box and sums. Boxes leave few
    entries per block; the rest is integer arithmetic, so results do not depend on the partitions and nothing is shuffled but
    one row per task and entry.

    :param keep: columns to return besides the new ones; all but the vector if None. New columns replace columns of their name.
    :param dim: length of the vectors, a multiple of 16; the most frequent length if None.

    Rows whose vector is null, empty, of another length, or holds a null, NaN or infinity are dropped. Repeated rows stay and
    count each. Null labels are one label; null keys stay. An empty table gives an empty table and no entries. With fewer than
    64 rows the codebooks are smaller. Components beyond 2^26 / 256 are a ValueError, as is a length not divisible by 16.
    """
    spark = df.sparkSession
    new = ("code", "error", "label_error")
    names = [c for c in (df.columns if keep is None else keep) if c not in (vec, *new)]
    parted = df.select(F.struct(*names).alias("kept"), F.col(key).alias("key"), F.col(label).alias("label"), F.col(vec).alias("vec"))
    width = dim or common_width(parted, "vec")
    if width % PARTS:
        raise ValueError(f"{PARTS} equal parts need a length divisible by {PARTS}, not {width}")
    if not width:
        empty = T.StructType([df.schema[c] for c in names] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
                                                             T.StructField("label_error", T.LongType())])
        return spark.createDataFrame([], empty), np.zeros((PARTS, 0, 0), np.int64)
    chunks = materialise(_packed(parted, width), "vector-blocks")
    scaled = F.transform("vec", lambda x: F.floor(x.cast("double") * SCALE))
    first = parted.filter(usable("vec", width)).select("key", scaled.alias("x")).orderBy(F.asc_nulls_last("key"), "x").limit(ENTRIES).collect()
    books = fit(chunks, np.array([r["x"] for r in first], np.int64).reshape(len(first), width), rounds)
    done = materialise(coded(chunks, books), "vector-codes")
    return with_label_sum(done, "label", "error", "label_error").select("kept.*", *new), books
