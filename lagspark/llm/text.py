"""Vectorised word handling shared by the text operators.

Arrow string columns are read as one flat UTF-8 buffer with document offsets,
so splitting, lower-casing and hashing run as numpy passes over the buffer
instead of Python loops over documents.  White space is ``[\\x20\\x09-\\x0D]``
everywhere; null texts count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: The same class for Java and SQL regular expressions.
WORD_RE = "[^\\x20\\x09-\\x0D]+"
#: Bytes of a word that are hashed for all words at once.
LONG_WORD = 128
#: Masks of the first 0 to 8 bytes of a little-endian integer.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes that one numpy pass handles; a longer document is still one pass.
PASS_BYTES = 1 << 20


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Give freed memory back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable) -> Callable:
    """A batch iterator function that releases memory after every batch."""

    def wrapped(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            del out
            release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random multipliers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)) | U64(1)


_weights = stream(256, 17)


def weights(n: int) -> np.ndarray:
    global _weights
    if len(_weights) < n:
        _weights = stream(max(n, 2 * len(_weights)), 17)
    return _weights


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES):
    """Ranges (first, end) of documents of at most `limit` bytes, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of some documents: byte spans, document numbers, first word of each document."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # one longer than the documents

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """64-bit hash of every word: eight bytes at a time, mixed; words of one length up to eight never collide."""
        lens = self.ends - self.starts
        data = np.zeros(len(self.buf) + 8, np.uint8)
        data[: len(self.buf)] = LOWER[self.buf] if lower else self.buf
        eight = np.ndarray((len(self.buf) + 1,), "<u8", data, strides=(1,))
        out = lens.astype(U64) * U64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            at, left, todo = self.starts, lens, None
            for _ in range(LONG_WORD // 8):
                own = eight[at] & _HEAD[np.minimum(left, 8)]
                if todo is None:
                    out = mix(out ^ own)
                else:
                    out[todo] = mix(out[todo] ^ own)
                more = left > 8
                todo = np.flatnonzero(more) if todo is None else todo[more]
                if not len(todo):
                    break
                at, left = at[more] + 8, left[more] - 8
            for i in todo.tolist() if todo is not None else ():  # what is left of very long words, one by one
                part = np.zeros(-(-int(self.ends[i] - self.starts[i] - LONG_WORD) // 8) * 8, np.uint8)
                part[: self.ends[i] - self.starts[i] - LONG_WORD] = data[self.starts[i] + LONG_WORD : self.ends[i]]
                own = part.view("<u8")
                out[i] = mix(out[i : i + 1] ^ (mix(own) * weights(len(own))[: len(own)]).sum(dtype=U64))[0]
        return out


def split(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of non-white bytes within each document."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    np.logical_not(SPACE[buf], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    finish = inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inside[1:-1][edge]
    finish[edge - 1] = inside[1:-1][edge - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finish) + 1
    first = np.searchsorted(starts, offsets, "left")
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(buf, starts, ends, doc, first)


def batches(column) -> "list[tuple[int, int, Words]]":
    """(first document, end, words) of one Arrow column, pass by pass."""
    buf, offsets = flat(column)
    for i, j in passes(offsets):
        own = offsets[i : j + 1]
        yield i, j, split(buf[own[0] : own[-1]], own - own[0])


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document.

    A shingle is k consecutive lower-cased words; a document of fewer words has
    one shingle, its whole sequence; a document without words has none.
    """
    h = words.hashes()
    salt = stream(k, 101)
    n = len(h)
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, n - k + 1), U64)
        for j in range(k):
            whole += mix(h[j : n - k + 1 + j] ^ salt[j]) if len(whole) else whole
        whole = mix(whole)
        out = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= k:
                own = np.sort(whole[a : b - k + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif b > a:
                part = mix(h[a:b] ^ salt[: b - a]).sum(dtype=U64) + U64(b - a)
                out.append(mix(np.array([part], U64)))
            else:
                out.append(np.zeros(0, U64))
    return out


def signed(x) -> np.ndarray:
    return np.asarray(x, U64).view(np.int64)
