"""Telephony audio: G.711 and IMA ADPCM in, resampled 16-bit PCM out.

mu-law and A-law bytes are expanded by 256-entry tables, ADPCM blocks are
encoded and decoded step by step over all blocks of a batch at once, and 8 kHz samples are
brought to 16 kHz by a four-tap half-band filter in integers. Media are WAV
files in a binary column; what is stored is read back from those bytes alone.

Null and empty media or texts are legal: an empty text still has one block of
64 zero bytes. WAVs of 8 kHz (doubled) and 16 kHz (kept) are read: G.711 and
16-bit PCM of any number of channels, which are averaged, and mono ADPCM of any
block size. A media value that is none of these gives null samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces

RATE, BLOCK = 8000, 64
PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11

# The IMA ADPCM step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw() -> np.ndarray:
    b = 255 - np.arange(256)
    size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return np.where(b & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    b = np.arange(256) ^ 0x55
    part, fine = b >> 4 & 7, (b & 15) << 4
    size = np.where(part == 0, fine + 8, fine + 264 << np.maximum(part - 1, 0))
    return np.where(b & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw(), _alaw()
# By step index and nibble: the signed change of the sample, and the next index.
_nibble = np.arange(16)
_delta = (STEPS[:, None] >> 3) + sum(np.where(_nibble & 4 >> j, STEPS[:, None] >> j, 0) for j in range(3))
DELTAS = np.where(_nibble & 8, -_delta, _delta).astype(np.int32).ravel()
NEXT = (np.clip(np.arange(len(STEPS))[:, None] + CHANGES, 0, len(STEPS) - 1) * 16).astype(np.int32).ravel()


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA blocks, one row a block: (n, size) uint8 to (n, 2 * size - 7) int16."""
    n, size = blocks.shape
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    out[0] = sample
    for k in range(size - 4):
        for half, code in enumerate((codes[k] & 15, codes[k] >> 4)):
            at = index + code
            sample += DELTAS[at]
            np.clip(sample, -32768, 32767, out=sample)
            index = NEXT[at]
            out[2 * k + 1 + half] = sample
    return out.T


def ima_encode(x: np.ndarray) -> np.ndarray:
    """Mono IMA blocks of samples, one row a block: (n, 2 * size - 7) int16 to (n, size) uint8. A block starts
    with its first sample and with the step next to the mean change in it, so blocks do not hang on each other."""
    n, width = x.shape
    wide = x.astype(np.int32).T
    sample = wide[0].copy()
    index = np.searchsorted(STEPS[:-1], np.abs(np.diff(wide, axis=0)).sum(0) // max(1, width - 1)).astype(np.int32)
    out = np.zeros((n, 4 + width // 2), np.uint8)
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    out[:, 2] = index
    index *= 16
    for k in range(width - 1):
        gap = wide[k + 1] - sample
        code = np.minimum(7, 4 * np.abs(gap) // STEPS[index >> 4]) | np.where(gap < 0, 8, 0)
        at = index + code
        sample = np.clip(sample + DELTAS[at], -32768, 32767)
        index = NEXT[at]
        out[:, 4 + k // 2] |= (code << 4 * (k % 2)).astype(np.uint8)
    return out


def ima_blocks(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of signals in a flat x, and how many each has; a last block repeats the last sample."""
    width = 2 * size - 7
    n = -(-sizes // width)
    first = np.repeat(starts, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * width
    return ima_encode(x[np.minimum(first[:, None] + np.arange(width), np.repeat(starts + sizes - 1, n)[:, None])]), n


def double_rate(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Twice the rate; starts: where each signal of the flat x begins. Ends repeat."""
    wide = x.astype(np.int32)
    last = np.append(starts[1:], len(x)) - 1
    left, right = np.empty_like(wide), np.empty_like(wide)
    left[1:], right[:-1] = wide[:-1], wide[1:]
    left[starts], right[last] = wide[starts], wide[last]
    far = np.empty_like(wide)
    far[:-1] = right[1:]
    far[last] = wide[last]
    out = np.empty(2 * len(x), np.int16)
    out[0::2] = x
    out[1::2] = np.clip(9 * (wide + right) - left - far + 8 >> 4, -32768, 32767)
    return out


def wav(kind: int, payload: bytes, rate: int = RATE, bits: int = 8, align: int = 1) -> bytes:
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * align, align, bits)
    return b"RIFF" + struct.pack("<I", 20 + len(fmt) + len(payload)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload


class Format(NamedTuple):
    kind: int
    channels: int
    rate: int
    align: int
    bits: int


def read_wav(media: bytes) -> tuple[int, memoryview] | None:
    """(format code, samples) of a WAV, or None if it is not one."""
    found = read_chunks(media)
    return found and (found[0].kind, found[1])


def read_chunks(media: bytes) -> tuple[Format, memoryview] | None:
    """(whole format, samples) of a WAV, or None if it is not one."""
    view, kind, at = memoryview(media), None, 12
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        return None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack("<I", view[at + 4 : at + 8])[0]
        if name == b"fmt " and size >= 16:
            code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", view[at + 8 : at + 24])
            kind = Format(code, channels, rate, align, bits)
        elif name == b"data":
            return None if kind is None or at + 8 + size > len(view) else (kind, view[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return None


def samples(media: bytes) -> np.ndarray | None:
    """Mono samples of a stored WAV in any of the telephony formats, at its own rate."""
    if not (found := read_chunks(media)):
        return None
    f, data = found[0], np.frombuffer(found[1], np.uint8)
    if f.kind == IMA:
        if f.channels != 1 or f.bits != 4 or f.align < 5:
            return None
        whole = len(data) // f.align * f.align
        out = [ima_decode(data[:whole].reshape(-1, f.align)).ravel()]
        if len(data) - whole >= 4:  # the last block may be shorter
            out.append(ima_decode(data[None, whole:])[0])
        return np.concatenate(out)
    if (f.kind, f.bits) not in ((MULAW, 8), (ALAW, 8), (PCM, 16)) or not f.channels:
        return None
    x = {MULAW: lambda: MULAW_TABLE[data], ALAW: lambda: ALAW_TABLE[data], PCM: lambda: data[: len(data) // 2 * 2].view("<i2")}[f.kind]()
    if f.channels == 1:
        return x
    return np.rint(x[: len(x) // f.channels * f.channels].reshape(-1, f.channels).mean(1)).astype(np.int16)


def pcm(media: bytes) -> bytes | None:
    """A stored WAV as PCM at 16 kHz, itself a WAV; None if it cannot be read."""
    found, x = read_chunks(media), samples(media)
    if x is None or found[0].rate not in (RATE, 2 * RATE):
        return None
    if found[0].rate == RATE and len(x):
        x = double_rate(x, np.zeros(1, int))
    return wav(PCM, x.astype("<i2").tobytes(), 2 * RATE, 16, 2)


def to_pcm(df: DataFrame, media: str = "media", out: str = "pcm") -> DataFrame:
    """df with `out`, the media at 16 kHz as a PCM WAV: null where media is null or
    unreadable. An `out` of df is replaced."""
    keep = [c for c in df.columns if c != out]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, media, 4 << 20):
            made = []
            for x in b.column(media):
                made.append(None if x.as_py() is None else pcm(x.as_py()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(made, pa.binary())], [*keep, out])

    schema = df.select(*keep).withColumn(out, F.lit(None).cast("binary")).schema
    return df.mapInArrow(decode, schema)


def store_text(text: bytes) -> bytes:
    """The bytes padded with 0 to a positive multiple of 64, as a mu-law WAV."""
    return wav(MULAW, text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text)))


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media: each whole text stored as mu-law samples."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text, 4 << 20):
            raw = [(x.as_py() or "").encode() for x in b.column(text)]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(map(len, raw), pa.int64()), pa.array(map(store_text, raw), pa.binary())], [key, "n_bytes", "media"])

    return df.select(key, text).mapInArrow(store, df.select(key, F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string, ima_bytes long, ima_sha256 string, ima_error long"


def measure(media: list[bytes]) -> list[list]:
    """FEATURES of stored mu-law WAVs, from their bytes alone. The feature has, of
    the mu-law samples: peak, mean size and sign changes; the peak of the same
    bytes as A-law; the mean size as ADPCM blocks; the CRC of the resampled PCM, stored and read back.
    pcm is the stored 16 kHz PCM; ima the samples stored as ADPCM, and ima_error the mean size of what
    they differ by when they are read back and decoded."""
    loads = [read_wav(m)[1] for m in media]
    flat = np.frombuffer(b"".join(loads), np.uint8)
    size = np.array([len(x) for x in loads])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    x = MULAW_TABLE[flat]
    far = np.abs(x.astype(np.int32))
    signs = np.zeros(len(x), np.int32)
    signs[1:] = (x[1:] < 0) != (x[:-1] < 0)
    signs[starts] = 0
    blocks = np.abs(ima_decode(flat.reshape(-1, BLOCK)).astype(np.int32)).sum(1)
    ima = np.add.reduceat(blocks, starts // BLOCK) // (size // BLOCK * (2 * BLOCK - 7))
    peak, mean, cross = np.maximum.reduceat(far, starts), np.add.reduceat(far.astype(np.int64), starts) // size, np.add.reduceat(signs, starts)
    alaw = np.maximum.reduceat(np.abs(ALAW_TABLE[flat].astype(np.int32)), starts)
    wide = memoryview(double_rate(x, starts).astype("<i2", copy=False)).cast("B")
    stored = [wav(PCM, wide[4 * s : 4 * (s + n)].tobytes(), 2 * RATE, 16, 2) for s, n in zip(starts.tolist(), size.tolist(), strict=True)]
    crc = [zlib.crc32(read_wav(m)[1]) for m in stored]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    made, n = ima_blocks(x, starts, size)
    ends = np.concatenate([[0], np.cumsum(n)])
    coded = [wav(IMA, made[a:z].tobytes(), RATE, 4, BLOCK) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    back = ima_decode(np.frombuffer(b"".join(read_wav(m)[1] for m in coded), np.uint8).reshape(-1, BLOCK))
    width = back.shape[1]
    place = np.repeat(ends[:-1] * width, size) + np.arange(len(x)) - np.repeat(starts, size)
    error = np.add.reduceat(np.abs(back.ravel()[place].astype(np.int64) - x), starts) // size
    return [
        size.tolist(), [sha(p) for p in loads], [zlib.crc32(p[-BLOCK:]) for p in loads], [len(m) for m in media], [sha(m) for m in media],
        [f"mulaw peak={a} mean={b} cross={c} alaw peak={d} ima mean={e} pcm16k crc={f:08x}" for a, b, c, d, e, f in zip(peak, mean, cross, alaw, ima, crc, strict=True)],
        [len(m) for m in stored], [sha(m) for m in stored], [len(m) for m in coded], [sha(m) for m in coded], error.tolist(),
    ]


def text_features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and FEATURES of each whole text, stored and read back in one
    pass so that media need not travel. Null texts count as empty."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text, 1 << 20):
            media, n = [], []
            for x in b.column(text):
                raw = (x.as_py() or "").encode()
                n.append(len(raw))
                media.append(store_text(raw))
            names = [f.split(" ")[0] for f in FEATURES.split(", ")]
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), *[pa.array(v, t) for v, t in zip(measure(media), kinds, strict=True)]], [key, "n_bytes", *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(both, f"`{key}` {kind}, n_bytes long, {FEATURES}")
