"""Vectorised word, line and hash helpers over Arrow text batches; used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE, _SALT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BLOCK_BYTES = 1 << 20


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, true inside the closed byte ranges."""
    flags = np.zeros(256, bool)
    for a, b in ranges:
        flags[a:b + 1] = True
    return flags


#: word bytes of `[^\x20\x09-\x0D]+`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z
SPACED = ~table((0x20, 0x20), (0x09, 0x0D))
ALNUM = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of whole texts; a run holds ``limit`` bytes or one longer text.

    A null text is empty.
    """
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of true flags; no run crosses a text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True flags per text."""
    return np.diff(running(flags)[offsets])


def running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of an odd base modulo 2^64 and their inverses, made longer as needed."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefixes(self, buf: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes."""
        self.upto(len(buf) + 1)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[:len(buf)], out=out[1:], dtype=np.uint64)
        return out

    def between(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the strings [start, end), the same wherever a string stands."""
        return mixed((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


class PrimePowers:
    """String hashes as those of :class:`Powers`, modulo two primes of 31 bits.

    A power of two as the modulus gives some long texts the same hash whatever the base; primes do not.
    """

    PRIMES = (2_147_483_647, 2_147_483_629)
    CHUNK = 1 << 22  # sums of so many terms fit 64 bits

    def __init__(self, bases: tuple[int, int] = (1_103_515_245, 1_664_525_017)):
        self.bases, self.up, self.down = bases, [np.ones(1, np.uint32)] * 2, [np.ones(1, np.uint32)] * 2

    def upto(self, n: int) -> None:
        for k, p in enumerate(self.PRIMES):
            for held, base in ((self.up, self.bases[k]), (self.down, pow(self.bases[k], -1, p))):
                while len(held[k]) < n:
                    more = held[k].astype(np.uint64) * np.uint64(pow(base, len(held[k]), p)) % np.uint64(p)
                    held[k] = np.concatenate([held[k], more.astype(np.uint32)])

    def prefixes(self, buf: np.ndarray) -> list[np.ndarray]:
        """Polynomial hashes of all prefixes, for each prime."""
        self.upto(len(buf) + 1)
        out = []
        for up, p in zip(self.up, self.PRIMES):
            prefix, carry = np.zeros(len(buf) + 1, np.uint32), np.uint64(0)
            for i in range(0, len(buf), self.CHUNK):
                terms = buf[i:i + self.CHUNK].astype(np.uint64)
                terms += np.uint64(1)
                terms *= up[i:i + len(terms)]
                np.cumsum(terms, out=terms)
                terms += carry
                terms %= np.uint64(p)
                prefix[i + 1:i + 1 + len(terms)] = terms
                carry = terms[-1]
            out.append(prefix)
        return out

    def between(self, prefix: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the strings [start, end), the same wherever a string stands."""
        first, second = (
            (x[ends].astype(np.uint64) + np.uint64(p) - x[starts]) % np.uint64(p) * down[starts] % np.uint64(p)
            for x, down, p in zip(prefix, self.down, self.PRIMES))
        return mixed((first << np.uint64(32) | second) + (ends - starts).astype(np.uint64) * np.uint64(_SALT))


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words of one text, and the index of their first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[n - 1:] == rows[:len(rows) - n + 1])
    total = np.zeros(len(first), np.uint64)
    for k in range(n):
        total = total * np.uint64(_SALT) + hashes[first + k]
    return mixed(total + np.uint64(n)), first


def salted(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that agree only for equal hashes of one text."""
    return mixed(hashes + mixed(rows.astype(np.uint64) + np.uint64(1)))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the key stands at an earlier index; the key stands at two or more indices."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, either = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    either[order[1:]] = same
    either[order[:-1]] |= same
    return later, either


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Flags of the ``n`` places inside a window of ``length`` that begins at one of ``starts``."""
    step = np.zeros(n + length + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step)[:n] > 0


def arrow_rows(batch: pa.RecordBatch, names: list[str], first: int, end: int, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of rows [first, end) with new columns behind."""
    kept = [batch.column(n).slice(first, end - first) for n in names]
    return pa.RecordBatch.from_arrays([*kept, *new.values()], names=[*names, *new])
