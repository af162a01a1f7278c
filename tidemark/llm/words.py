"""Vectorised words, hashes and shingles over Arrow string columns; the shared task-side helpers of this subpackage.

All functions work on a *chunk*: the texts of some rows, one after the other in one byte array.  A null text has no
bytes.  Nothing here knows about Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are worked on at a time (a longer text is a chunk of its own).
CHUNK_BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def hash_bytes(text: str | bytes) -> int:
    """The hash that :meth:`Chunk.word_hashes` gives a word of these bytes."""
    raw = text.encode() if isinstance(text, str) else text
    one = Chunk(np.frombuffer(raw + b" ", np.uint8), np.array([0, len(raw)], np.int64))
    return int(one.word_hashes(np.array([0]), np.array([len(raw)]))[0])


#: Bytes of a word beyond which hashlib hashes it.
_LONG = 512
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


#: Separators of words: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of alphanumeric words (after lower-casing): ASCII but for digits and a-z.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: A-Z to a-z, other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Chunk:
    """``data``: the bytes; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``; ``first``: the row of text 0 in its batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int = 0

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Chunk:
        return Chunk(LOWER[self.data], self.offsets, self.first)

    def words(self, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each word, and ``at`` with the words of text i at ``at[i]:at[i + 1]``."""
        inside = ~separators[self.data]
        n = len(inside)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self) + 1, np.int64)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return s, e, np.searchsorted(s, self.offsets)

    def word_hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word's bytes: eight at a time are mixed into what those before gave, so that words of equal length
        up to eight bytes never share one and no others do by their structure."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded.data, strides=(1,))
        left = e - s
        out = mix64(left.astype(U64) + U64(0x9E3779B97F4A7C15))
        active, at = np.flatnonzero(left <= _LONG), s
        if len(active) < len(left):
            for i in np.flatnonzero(left > _LONG).tolist():
                out[i] = int.from_bytes(hashlib.blake2b(self.data[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
            at, left = s[active], left[active]
        while len(active):
            out[active] = mix64(out[active] ^ (eight[at] & _FIRST_BYTES[np.minimum(left, 8)]))
            more = np.flatnonzero(left > 8)
            active, at, left = active[more], at[more] + 8, left[more] - 8
        return out


def row_of(at: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words from each word on (``len(words) - k + 1`` of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for j in range(1, k):
            out ^= out >> U64(32)
            out *= U64(0xD6E8FEB86659FD93)
            out += words[j : j + n]
        return mix64(out)


def starts_within(at: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words from which k words of the same text follow, itself included."""
    n = int(at[-1])
    if n < k:
        return np.zeros(0, np.int64)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    return np.flatnonzero(left >= k)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... count[i] of them, for each i in turn."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count - begin, count)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without copying; a null has no bytes."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return offsets, data


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of whole texts of about ``most`` bytes."""
    offsets, data = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches, cut anew so that no key is in two."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(x).to_numpy() for x in keys]
        new = np.zeros(len(batch), bool)
        new[0] = last is not None and last != tuple(c[0] for c in columns)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in columns)
        cut = len(batch) - 1 - int(np.argmax(new[::-1])) if new.any() else 0
        if (cut or new[0]) and rows + cut >= most:
            held.append(batch.slice(0, cut))
            yield joined()
            held, rows = [batch.slice(cut)], len(batch) - cut
        else:
            held.append(batch)
            rows += len(batch)
    if held:
        yield joined()
