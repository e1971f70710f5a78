"""Elias-Fano lists in flat arrays that can be mapped from a file.

A monotone list keeps the low bits of its values packed and the high parts as a
unary bit vector; a count of zeros for every 256 bits finds the k-th zero. All
look-ups take and give arrays.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

from .words import U64

_STEP = 4  # words of the bit vector to a count
_PAIRS, _FOURS, _BYTES, _ONES, _TOPS = (U64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))
_SELECT = np.array([([b for b in range(8) if x >> b & 1] + [0] * 8)[:8] for x in range(256)], np.int64).ravel()  # the k-th one of a byte


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of the nondecreasing values, all below universe."""
    n = len(values)
    low = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    high = (values >> U64(low)).astype(np.int64)
    size = n + (max(1, universe) >> low) + 1
    words = -(-size // (64 * _STEP)) * _STEP
    bits = np.zeros(words * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    upper = np.packbits(bits, bitorder="little").view(U64)
    zeros = 64 - np.bitwise_count(upper).astype(np.int64)
    lower = np.zeros(-(-n * low // 64) + 2, U64)
    if low and n:
        at = np.arange(n, dtype=np.int64) * low
        value, shift = values & U64((1 << low) - 1), (at & 63).astype(U64)
        np.bitwise_or.at(lower, at >> 6, value << shift)
        np.bitwise_or.at(lower, (at >> 6) + 1, (value >> U64(1)) >> (U64(63) - shift))
    return {"shape": np.array([n, low], np.int64), "upper": upper, "zeros": np.concatenate([[0], zeros.reshape(-1, _STEP).sum(1).cumsum()]).astype(np.int64), "lower": lower}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.upper, self.zeros, self.lower = (arrays[f"{name}.{x}"] for x in ("upper", "zeros", "lower"))
        self.n, self.low = map(int, arrays[f"{name}.shape"])

    def _place(self, block: np.ndarray, rest: np.ndarray, flip: bool) -> np.ndarray:
        """Bit place of the rest-th one (or zero) from a block on."""
        word = block * _STEP
        for _ in range(_STEP - 1):
            w = self.upper[word]
            c = np.bitwise_count(~w if flip else w).astype(np.int64)
            on = rest >= c
            on &= (word + 1) % _STEP != 0
            rest = np.where(on, rest - c, rest)
            word = word + on
        w = ~self.upper[word] if flip else self.upper[word]
        # ones of each byte, summed up to it; the byte is where that passes rest
        sums = w - ((w >> U64(1)) & _PAIRS)
        sums = (sums & _FOURS) + ((sums >> U64(2)) & _FOURS)
        sums = ((sums + (sums >> U64(4))) & _BYTES) * _ONES
        passed = (((rest.astype(U64) * _ONES) | _TOPS) - sums) & _TOPS
        byte = np.bitwise_count(passed).astype(np.int64) << 3
        before = (sums << U64(8) >> byte.astype(U64) & U64(255)).astype(np.int64)
        return word * 64 + byte + _SELECT[(w >> byte.astype(U64) & U64(255)).astype(np.int64) << 3 | rest - before]

    def run_after(self, at: np.ndarray) -> np.ndarray:
        """How many ones follow the bit places at, up to the next zero; 64 if it is farther."""
        word, shift = (at + 1) >> 6, ((at + 1) & 63).astype(U64)
        more = np.where(word + 1 < len(self.upper), self.upper[np.minimum(word + 1, len(self.upper) - 1)], U64(0))
        rest = ~(self.upper[word] >> shift | (more << U64(1)) << (U64(63) - shift))
        return np.bitwise_count((rest & (~rest + U64(1))) - U64(1)).astype(np.int64)

    def zero(self, k: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.zeros, k, "right") - 1
        return self._place(block, k - self.zeros[block], True)

    def one(self, i: np.ndarray) -> np.ndarray:
        """Bit places of the i-th ones."""
        ones = np.arange(len(self.zeros)) * 64 * _STEP - self.zeros
        block = np.searchsorted(ones, i, "right") - 1
        return self._place(block, i - ones[block], False)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        return (self.one(i) - i).astype(U64) << U64(self.low) | self.small(i)

    def small(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), U64)
        at = i * self.low
        shift = (at & 63).astype(U64)
        word = at >> 6
        return (self.lower[word] >> shift | (self.lower[word + 1] << U64(1)) << (U64(63) - shift)) & U64((1 << self.low) - 1)

    def find(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each value within [begin, end), or -1: a successor search in the
        values that share its high part."""
        high = (value >> U64(self.low)).astype(np.int64)
        zero = np.where(high > 0, self.zero(np.maximum(high - 1, 0)), -1)
        left = zero - high + 1
        right = left + self.run_after(zero)
        far = np.flatnonzero(right == left + 64)
        if len(far):
            right[far] = self.zero(high[far]) - high[far]
        right = np.minimum(right, end)
        left, stop = np.maximum(left, begin), np.maximum(right, begin)
        want = value & U64((1 << self.low) - 1)
        a, b = left.copy(), np.maximum(stop, left)
        while True:
            live = np.flatnonzero(a < b)
            if not len(live):
                break
            mid = (a[live] + b[live]) >> 1
            less = self.small(mid) < want[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
        hit = a < np.maximum(stop, left)
        hit[hit] = self.small(a[hit]) == want[hit]
        return np.where(hit, a, -1)


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file, put in place whole: a repeated task writes the same again."""
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = (at, len(v), v.dtype.str)
        at += -(-v.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    new = f"{path}.{uuid.uuid4().hex}"
    with open(new, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for v in arrays.values():
            f.write(np.ascontiguousarray(v).tobytes() + bytes(-v.nbytes % 8))
    os.replace(new, path)


def load(path: str) -> dict[str, np.ndarray]:
    whole = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(whole[:8].tobytes(), "little")
    head = json.loads(whole[8 : 8 + size].tobytes())
    data = whole[8 + size :]
    return {k: np.asarray(data[at : at + n * np.dtype(t).itemsize].view(t)) for k, (at, n, t) in head.items()}
