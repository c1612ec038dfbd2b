"""Byte-pair encoding by dynamic programming over prefixes, and decoding (operator 6)."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from tokenizers import Tokenizer

from tastelake.llm.textblocks import arrow_rows, blocks

WORD_END = "</w>"
_SHIFT = 0x1000         # the last symbol of a word is another symbol than the same byte before the end
_NEVER = 1 << 60
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
#: the pre-tokenizer's pattern, on lower-cased text of the characters in _PLAIN (fixed value)
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-z0-9ß-öø-ÿ]+")
CACHE_BYTES = 32 << 20   # of each of two generations, all kept words of a codec together
CACHED_CHARS = 64        # longer pieces are not kept: they hardly come again
KNOWN_PAIRS = 1 << 17
_ENTRY = 200             # bytes of a kept word besides its characters and ids, about


#: the parts of a tokenizer's JSON that the splitting here stands for (fixed values)
PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": WORD_END, "fuse_unk": False,
         "byte_fallback": False, "ignore_merges": False}


def check_parts(tokenizer: dict) -> None:
    """A ValueError unless texts are split, merged and decoded as it is done here; any vocabulary and merges of that kind will do."""
    model = tokenizer.get("model", {})
    wrong = [k for k, v in PARTS.items() if tokenizer.get(k) != v] + [f"model.{k}" for k, v in MODEL.items() if model.get(k, v) != v]
    wrong += ["added_tokens" for t in tokenizer.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")][:1]
    if wrong:
        raise ValueError(f"this encoder does not handle the tokenizer's {', '.join(wrong)}")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary with word ends, read from a tokenizer's JSON.

    The encoding of every prefix of a word ends in exactly one token. That token is a vocabulary entry that ends
    there (found by one automaton over all entries) and that may follow the last token of the prefix before it:
    replaying the merges of both in order of rank, no merge is ever due across their border.
    """

    def __init__(self, source: str):
        parts = json.loads(source)
        check_parts(parts)
        model = parts["model"]
        ids = model["vocab"]
        self.library = Tokenizer.from_str(source)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.text = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        merges = [(ids[a], ids[b]) for a, b in model["merges"]]
        self.pair_rank = {pair: rank for rank, pair in enumerate(merges)}
        self.parts: dict[int, tuple[int, int]] = {}
        for (a, b), (x, y) in zip(merges, model["merges"]):
            self.parts[ids[x + y]] = (a, b)
        self.rank = {t: self.pair_rank[p] for t, p in self.parts.items()}
        if len(self.parts) != len(merges) or any(self.rank.get(p, -1) >= r for t, r in self.rank.items() for p in self.parts[t]):
            raise ValueError("every token needs one merge, of tokens with earlier merges")
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            symbols = self.closed(token[:-len(WORD_END)]) if token.endswith(WORD_END) and token != WORD_END else token
            self.automaton.add_word(symbols, (i, len(symbols)))
        self.automaton.make_automaton()
        self.bytes = dict(enumerate(byte_symbols()))
        self._edges: dict[tuple[int, int], list[int]] = {}
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    @staticmethod
    def closed(word: str) -> str:
        return word[:-1] + chr(ord(word[-1]) + _SHIFT)

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at one side (0 left, 1 right) of ``token`` while it is merged, the smallest first."""
        if (token, side) not in self._edges:
            chain, t = [token], token
            while t in self.parts:
                t = self.parts[t][side]
                chain.append(t)
            self._edges[token, side] = chain[::-1]
        return self._edges[token, side]

    def first_crossing(self, left: int, right: int) -> tuple[int, int] | None:
        """The tokens beside the border when a merge across it is due first; None if never.

        Merges run by rank and, at one rank, from the left.
        """
        a, b = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            due = self.pair_rank.get((a[i], b[j]), _NEVER)
            grow_a = self.rank[a[i + 1]] if i + 1 < len(a) else _NEVER
            grow_b = self.rank[b[j + 1]] if j + 1 < len(b) else _NEVER
            if due < grow_a and due <= grow_b:
                return a[i], b[j]
            if grow_a == grow_b == _NEVER:
                return None
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """The token's own text is encoded as the token."""
        if token not in self._whole:
            if token not in self.parts:
                self._whole[token] = True
            else:
                a, b = self.parts[token]
                self._whole[token] = self.whole(a) and self.whole(b) and self.first_crossing(a, b) == (a, b)
        return self._whole[token]

    def fits(self, left: int, right: int) -> bool:
        """The ids ``left, right`` are how their joined text is encoded."""
        return self.whole(right) and self.first_crossing(left, right) is None

    def word_ids(self, symbols: str) -> list[int]:
        """Ids of one pre-token, written in byte symbols."""
        length, known = len(symbols), self._fits
        last = [-1] * (length + 1)
        size = [0] * (length + 1)
        for end, (token, n) in self.automaton.iter(self.closed(symbols)):
            end += 1
            if last[end] >= 0:
                continue
            if end == n:
                good = self.whole(token)
            else:
                before = last[end - n]
                if before < 0:
                    continue
                pair = before << 32 | token
                good = known.get(pair)
                if good is None:
                    if len(known) >= KNOWN_PAIRS:
                        known.clear()
                    good = known[pair] = self.fits(before, token)
            if good:
                last[end], size[end] = token, n
        out, at = [], length
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def symbols(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.bytes)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens, in byte symbols, of a text without special tokens."""
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def has_special(self, text: str) -> bool:
        return any(t in text for t in self.special)

    def parted(self, chunk: str) -> list[str]:
        """Special tokens and the texts between them, in turn."""
        return self._special.split(chunk) if self._special else [chunk]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Kept(dict):
    """The newest entries, of ``limit`` bytes at least and twice as many at most; others are made again when asked for."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.size, self.old = make, limit, 0, {}

    def __missing__(self, key):
        if len(key) > CACHED_CHARS:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.size += _ENTRY + 4 * len(key) + len(value)
        if self.size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encodes and decodes texts; short words are kept, as most come again, up to a number of bytes."""

    def __init__(self, source: str, cache_bytes: int = CACHE_BYTES):
        self.vocabulary = v = Vocabulary(source)
        self.names = [v.text.get(i, "") for i in range(max(v.text) + 1)]
        self.words = _Kept(lambda w: _packed(v.word_ids(w)), cache_bytes // 8)
        self.plain = _Kept(lambda w: _packed(v.word_ids(v.symbols(w))), cache_bytes * 3 // 4)
        self.chunks = _Kept(self._chunk, cache_bytes // 8)

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for k, part in enumerate(self.vocabulary.parted(chunk)):
            if k % 2:
                out.append(_packed([self.vocabulary.special[part]]))
            elif part:
                out += [self.words[p] for p in self.vocabulary.pieces(part)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids.

        Texts of common letters are split here, by the same pattern. In others white space ends every pre-token,
        so the parts between are independent, and the library normalises and splits those it has not seen lately.
        """
        if _PLAIN.fullmatch(text) and not self.vocabulary.has_special(text):
            return b"".join(map(self.plain.__getitem__, _PIECES.findall(text.lower())))
        parts = re.split("[ \t-\r]+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join(map(self.chunks.__getitem__, parts))

    def decode(self, ids: bytes) -> str:
        """Token strings joined by blanks, as a tokenizer without a decoder does."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _checked(vocabulary: str) -> str:
    with open(vocabulary, encoding="utf-8") as file:
        source = file.read()
    check_parts(json.loads(source))
    return source


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens",
           decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the ids of every whole text: binary, little-endian unsigned 32-bit.

    :param vocabulary: path of a tokenizer's JSON (BPE with word ends, byte level), read by the driver. A ValueError if its normalizer,
        pre-tokenizer, decoder or kind of model is another than :data:`PARTS` and :data:`MODEL`.
    :param decoded: name of a column for the text decoded from the ids again; None for none.
    :param keep: columns of ``df`` to return; all if None. New columns replace columns of their name.

    A null or empty text has no ids and decodes to the empty text. Repeated rows stay, each encoded alike; an
    empty table gives an empty table. No text is cut, however long.
    """
    source = _checked(vocabulary)
    new = {n_tokens: T.LongType(), ids: T.BinaryType()} | ({decoded: T.StringType()} if decoded else {})
    names = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(c, t) for c, t in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(source)  # goes with the task, so a worker keeps nothing for the next stage
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first, end, _, _ in blocks(column):
                packed = [codec.encode(t or "") for t in column.slice(first, end - first).to_pylist()]
                out = {n_tokens: pa.array([len(x) // 4 for x in packed], pa.int64()), ids: pa.array(packed, pa.binary())}
                if decoded:
                    out[decoded] = pa.array([codec.decode(x) for x in packed], pa.string())
                yield arrow_rows(batch, names, first, end, out)

    return df.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids. Null ids give the empty text."""
    source = _checked(vocabulary)
    names = [c for c in df.columns if c != decoded]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(source)  # goes with the task, so a worker keeps nothing for the next stage
        for batch in batches:
            texts = [codec.decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield arrow_rows(batch, names, 0, batch.num_rows, {decoded: pa.array(texts, pa.string())})

    return df.select(*dict.fromkeys([*names, ids])).mapInArrow(run, schema)
