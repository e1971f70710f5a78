"""Words of whole texts as flat numpy arrays.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text.
Texts of a batch are handled together: every function works on the flat word
list of many documents, with the documents' bounds kept beside it. Batches are
cut by bytes, so one very long text is a batch of its own and short ones share.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U64 = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = splitmix(np.arange(256, dtype=U64) + U64(1 << 40))


class Words(NamedTuple):
    """Words of several texts: data holds their bytes without white space, word
    i is data[offsets[i]:offsets[i + 1]], text d has words docs[d]:docs[d + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    docs: np.ndarray

    def array(self) -> pa.Array:
        n = len(self.offsets) - 1
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(self.offsets), pa.py_buffer(self.data)])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the bounds of each; null counts as empty."""
    texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def split(texts: pa.Array, lower: bool = False, space: np.ndarray = _SPACE) -> Words:
    """The words of each text, optionally with A-Z lower-cased; space: which bytes are between words."""
    data, bounds = raw(texts)
    if lower:
        data = _LOWER[data]
    solid = ~space[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first[edges] = solid[edges]  # a word never runs from one text into the next
    last[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(first)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=offsets[1:])
    return Words(data[solid], offsets, np.searchsorted(starts, bounds).astype(np.int64))


_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123))
_STOP = np.isin(np.arange(256), np.frombuffer(b".,:;!?", np.uint8))


def stops(data: np.ndarray) -> np.ndarray:
    """Where one of .,:;!? follows an ASCII letter: no tokenizer here joins across it."""
    return np.flatnonzero(_STOP[data[1:]] & _LETTER[data[:-1]]) + 1


def finer(words: Words, at: np.ndarray) -> Words:
    """The words cut at further places, given as byte positions in their data."""
    mark = np.zeros(len(words.data) + 1, bool)
    mark[words.offsets] = mark[at] = True
    offsets = np.flatnonzero(mark)
    return Words(words.data, offsets, np.searchsorted(offsets, words.offsets[words.docs]))


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word: a multilinear sum over (byte, place), mixed with the length."""
    sizes = np.diff(words.offsets)
    if not len(sizes):
        return np.zeros(0, U64)
    place = np.arange(len(words.data)) - np.repeat(words.offsets[:-1], sizes)
    odd = splitmix(np.arange(int(sizes.max()), dtype=U64)) | U64(1)
    sums = np.add.reduceat(_BYTE[words.data] * odd[place], words.offsets[:-1])
    return splitmix(sums + sizes.astype(U64))


def runs(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values; run i starts at value i."""
    if len(values) < k:
        return np.zeros(0, U64)
    odd = splitmix(np.arange(k, dtype=U64) + U64(1 << 41)) | U64(1)
    n = len(values) - k + 1
    out = values[:n] * odd[0]
    for j in range(1, k):
        out += values[j : j + n] * odd[j]
    return splitmix(out + U64(k))


def rising(keys: np.ndarray) -> np.ndarray:
    """The order of 64-bit keys, as argsort gives it. Keys are sorted together with their places, in one
    number each, which is many times faster; where both do not fit, keys that are alike in all bits but
    the lowest are put in order after that."""
    if len(keys) < 2:
        return np.arange(len(keys))
    bits = (len(keys) - 1).bit_length()
    cut = max(0, int(keys.max()).bit_length() + bits - 64)
    packed = np.sort(keys >> U64(cut) << U64(bits) | np.arange(len(keys), dtype=U64))
    order = (packed & U64((1 << bits) - 1)).astype(np.int64)
    if cut:
        sorted_, upper = keys[order], packed >> U64(bits)
        alike = upper[1:] == upper[:-1]
        mixed = alike & (sorted_[1:] != sorted_[:-1])
        if mixed.any():
            run = np.concatenate([[0], np.cumsum(~alike)])
            own = np.zeros(run[-1] + 1, bool)
            own[run[1:][mixed]] = True
            at = np.flatnonzero(own[run])
            order[at] = order[at][np.argsort(sorted_[at], kind="stable")]
    return order


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit keys in rising order, and of each key its place among them."""
    order = rising(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[new], back


def inside(docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs of k values over a flat list: those that stay within one
    document (a mask over runs), and how many each document has."""
    sizes = np.diff(docs)
    n = max(0, int(docs[-1]) - k + 1)
    count = np.maximum(sizes - k + 1, 0)
    room = np.repeat(docs[1:], sizes)[:n] - np.arange(n)
    return room >= k, count


def release() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task keeps little."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has at most `limit` bytes of `column`, or one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(size):
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
        del batch, size
        release()
