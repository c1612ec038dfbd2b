"""Token counts of fields or sections from one encoding of the whole document (operator 7)."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from tastelake.llm.textblocks import blocks, running

RULES = ("first", "most", "last")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(i) for token, i in map(bytes.split, file)}


def _allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token [start, end) and whether it crosses a border; section k is [bounds[k], bounds[k + 1])."""
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    at = first if rule == "first" else last if rule == "last" else first.copy()
    if rule == "most":
        for i in np.flatnonzero(last > first):
            cuts = np.clip(bounds[first[i]:last[i] + 2], starts[i], ends[i])
            at[i] = first[i] + int(np.argmax(np.diff(cuts)))  # of equal parts the first
    return at, last > first


def section_tokens(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", rule: str = "first",
                   keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per line of every text: the kept columns, section (from 0), start_char, n_chars, n_tokens, n_crossing.

    A line holds its line feed. The whole text is encoded once; each token's character span is joined to the lines
    it touches, and a token that crosses a border counts for one of them only, so the counts of a text add up to its
    tokens. ``rule``: ``first`` gives it to the line of its first byte, ``last`` to that of its last byte, ``most`` to
    the line that holds most of its bytes (of equal parts the first). ``n_crossing`` counts the tokens that also touch
    a later line. start_char and n_chars are code points.

    A null or empty text has one section without characters and tokens. Repeated rows give repeated sections. Columns
    of ``df`` that are not kept may have any name. No text is cut.
    """
    return _sections(df, ranks_path, pattern, text, rule, list(keep), None)


def field_tokens(df: DataFrame, ranks_path: str, pattern: str, fields: Sequence[str], separator: str = "\n",
                 rule: str = "first", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per field of every document: the kept columns, section (position of the field), start_char, n_chars,
    n_tokens, n_crossing. The document is the fields joined by ``separator``, which counts for the field before it.
    A null field is empty. Else as :func:`section_tokens`.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    sizes = [F.octet_length(p) for p in parts]
    whole = df.select(*keep, F.concat_ws(separator, *parts).alias("_text"), F.array(*sizes).alias("_sizes"))
    return _sections(whole, ranks_path, pattern, "_text", rule, list(keep), len(separator.encode()))


def _sections(df, ranks_path, pattern, text, rule, keep, gap):
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    ranks = read_ranks(ranks_path)
    new = [T.StructField("section", T.LongType()), T.StructField("start_char", T.LongType()), T.StructField("n_chars", T.LongType()),
           T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType())]
    keep = [c for c in keep if c not in {f.name for f in new}]
    schema = T.StructType([df.schema[c] for c in keep] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            length[i] = len(token)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for i, j, buf, offsets in blocks(column):
                texts = column.slice(i, j - i).to_pylist()
                ids = [np.array(encoder.encode_ordinary(t or ""), np.int64) for t in texts]
                ends = np.cumsum(length[np.concatenate(ids)])
                starts = ends - length[np.concatenate(ids)]
                if gap is None:
                    feeds = np.flatnonzero(buf == 10)
                    owner = np.searchsorted(offsets, feeds, "right") - 1
                    inner = feeds + 1 < offsets[owner + 1]
                    bounds = np.concatenate([offsets[:-1], feeds[inner] + 1])
                    rows = np.concatenate([np.arange(len(texts)), owner[inner]])
                    order = np.lexsort((bounds, rows))
                    bounds, rows = bounds[order], rows[order]
                else:
                    sizes = np.array(batch.column(batch.schema.get_field_index("_sizes")).slice(i, j - i).to_pylist(), np.int64)
                    sizes[:, :-1] += gap
                    bounds = (offsets[:-1, None] + np.cumsum(sizes, axis=1) - sizes).ravel()
                    rows = np.repeat(np.arange(len(texts)), sizes.shape[1])
                at, crossing = _allocate(starts, ends, bounds, rule)
                # the last of several sections that begin at one place holds what stands there
                chars = running((buf & 0xC0) != 0x80)
                begin, end = chars[bounds], chars[np.append(bounds[1:], len(buf))]
                n = len(bounds)
                first_of = np.searchsorted(rows, rows, "left")
                first_char = chars[offsets[:-1]][rows]
                out = {"section": np.arange(n) - first_of, "start_char": begin - first_char, "n_chars": end - begin,
                       "n_tokens": np.bincount(at, minlength=n), "n_crossing": np.bincount(at[crossing], minlength=n)}
                kept = [batch.column(batch.schema.get_field_index(c)).slice(i, j - i).take(pa.array(rows)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, pa.int64()) for v in out.values())], names=[*keep, *out])

    return df.select(*dict.fromkeys([*keep, text, *(["_sizes"] if gap is not None else [])])).mapInArrow(run, schema)
