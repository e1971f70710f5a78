"""Embedders: a registry of models from files (and texts) to vectors, applied in batches.

A model is made once in each worker. It is a function of one file, or has
`embed_batch` for many at once and `embed_text` for texts, which are looked for
by name. A file that fails has a null vector and a reason; when a batch fails
as a whole its files are taken one by one, so that only the bad ones fail.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from ..sources.library import clip

Embed = Callable[[str, bytes | None], np.ndarray]
_REGISTRY: dict[str, tuple[Callable[[], Embed], int]] = {}
_AUDIO: dict[str, dict[str, object]] = {}


class UnknownEmbedder(KeyError):
    pass


def register(name: str, make: Callable[[], Embed], dim: int, audio: dict[str, object] | None = None) -> None:
    """make is called once in each worker, so models load there. audio: how it loads sound (rate, seconds, hop, ...; plain
    values), kept with every index that is built with it."""
    if name in _REGISTRY:
        raise ValueError(f"{name} is registered already")
    if dim <= 0:
        raise ValueError("an embedder has a width")
    _REGISTRY[name] = make, dim
    _AUDIO[name] = dict(audio or {})


def audio_config(name: str) -> dict[str, object]:
    find(name)
    return dict(_AUDIO[name])


def names() -> list[str]:
    return sorted(_REGISTRY)


def find(name: str) -> tuple[Callable[[], Embed], int]:
    if name not in _REGISTRY:
        raise UnknownEmbedder(f"{name} is none of {', '.join(names())}")
    return _REGISTRY[name]


def checked(v: np.ndarray, dim: int) -> np.ndarray:
    v = np.asarray(v, np.float32)
    if v.shape != (dim,):
        raise ValueError(f"the vector has shape {v.shape}, not ({dim},)")
    if not np.isfinite(v).all():
        raise ValueError("the vector is not finite")
    return v


def normalised(v: np.ndarray, strict: bool = False, floor: float = 1e-8) -> np.ndarray:
    """Of length one. A zero vector stays, or with strict one shorter than floor is an error."""
    n = float(np.linalg.norm(v))
    if strict and n < floor:
        raise ValueError("the vector is zero")
    return v / n if n else v


def each(model: Embed, keys: list, contents: list, dim: int) -> tuple[list, list]:
    """Vectors and errors of a batch."""
    if hasattr(model, "embed_batch"):
        try:
            return [checked(v, dim) for v in model.embed_batch(keys, contents)], [None] * len(keys)
        except Exception:  # one bad file fails a batch: find it below
            pass
    out, errors = [], []
    for key, content in zip(keys, contents, strict=True):
        try:
            out.append(checked(model(key, content), dim))
            errors.append(None)
        except Exception as e:  # any model may be plugged in; its errors belong to the row
            out.append(None)
            errors.append(str(e) or type(e).__name__)
    return out, errors


def embed(df: DataFrame, name: str, path: str = "path", content: str | None = None, batch: int = 64) -> DataFrame:
    """df with embedding and embed_error; columns of those names are replaced."""
    make, dim = find(name)
    columns = [c for c in df.columns if c not in ("embedding", "embed_error")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for whole in frames:
            for at in range(0, len(whole), batch):
                frame = whole.iloc[at : at + batch]
                out, errors = each(model, list(frame[path]), list(frame[content]) if content else [None] * len(frame), dim)
                yield frame[columns].assign(embedding=out, embed_error=errors)

    fields = [*df.select(*columns).schema, StructField("embedding", ArrayType(FloatType())), StructField("embed_error", StringType())]
    return df.mapInPandas(run, StructType(fields))


class TextUnsupported(ValueError):
    pass


def embed_text(name: str, text: str) -> np.ndarray:
    """The vector of a text, by embedders that have `embed_text`."""
    make, dim = find(name)
    model = make()
    if not hasattr(model, "embed_text"):
        raise TextUnsupported(f"{name} takes no texts")
    return checked(model.embed_text(text), dim)


def mock(key: str, _: bytes | None = None, dim: int = 64) -> np.ndarray:
    """A unit vector that depends on the key alone."""
    v = np.random.default_rng(int.from_bytes(hashlib.sha256(key.encode()).digest()[:4], "big")).standard_normal(dim)
    return (v / np.linalg.norm(v)).astype(np.float32)


def spectra(x: np.ndarray, size: int = 2048, hop: int = 512) -> np.ndarray:
    """(frames, size / 2 + 1) magnitudes of centred Hann frames."""
    x = np.pad(np.asarray(x, np.float64), size // 2)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * hann))


def decibels(power: np.ndarray, range_: float = 80.0) -> np.ndarray:
    db = 10 * np.log10(np.maximum(power, 1e-10))
    return np.maximum(db, db.max(initial=-100) - range_)


def slaney(f: np.ndarray, back: bool = False) -> np.ndarray:
    """Hertz to mel: linear up to 1 kHz, logarithmic above; or back."""
    f, corner, step = np.asarray(f, np.float64), 15.0, np.log(6.4) / 27
    if back:
        return np.where(f < corner, f * 200 / 3, 1000 * np.exp(step * (f - corner)))
    return np.where(f < 1000, f * 3 / 200, corner + np.log(np.maximum(f, 1e-9) / 1000) / step)


def mel_power(x: np.ndarray, rate: int, bands: int, size: int = 2048, hop: int = 512) -> np.ndarray:
    """(bands, frames) power in triangular mel bands of equal area."""
    edge = slaney(np.linspace(0, slaney(rate / 2), bands + 2), back=True)
    f = np.fft.rfftfreq(size, 1 / rate)
    bank = np.maximum(0, np.minimum((f - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None], (edge[2:, None] - f) / (edge[2:] - edge[1:-1])[:, None]))
    return (bank * (2 / (edge[2:] - edge[:-2]))[:, None]) @ (spectra(x, size, hop) ** 2).T


def mel(x: np.ndarray, rate: int = 16_000, bands: int = 128, size: int = 2048, hop: int = 512) -> np.ndarray:
    """(bands, frames) mel bands in decibels, at most 80 below the maximum."""
    return decibels(mel_power(x, rate, bands, size, hop)).astype(np.float32)


def cepstra(x: np.ndarray, rate: int, n: int = 20, bands: int = 128) -> np.ndarray:
    """(n, frames): the orthonormal cosine transform (II) of mel bands in decibels."""
    db = decibels(mel_power(x, rate, bands))
    k = np.cos(np.pi / bands * (np.arange(bands) + 0.5) * np.arange(n)[:, None]) * np.sqrt(2 / bands)
    k[0] /= np.sqrt(2)
    return k @ db


def chroma(x: np.ndarray, rate: int, size: int = 2048) -> np.ndarray:
    """(12, frames): power by pitch class from C on, the largest of a frame being 1."""
    power, f = spectra(x, size) ** 2, np.fft.rfftfreq(size, 1 / rate)
    pitch = 12 * np.log2(np.maximum(f, 1e-9) / 440) + 9
    width = np.maximum(1, 12 * np.log2(np.maximum(f[2], f + f[1]) / np.maximum(f[1], f)))  # a bin, in semitones
    off = (pitch - np.arange(12)[:, None] + 6) % 12 - 6
    bank = np.exp(-2 * (off / width) ** 2) * (f > 0)
    bank *= np.exp(-0.5 * ((np.log2(np.maximum(f, 1e-9) / 440) + 4 - 5) / 2) ** 2) / np.maximum(np.sqrt((bank**2).sum(0)), 1e-12)
    out = bank @ power.T
    top = out.max(0)
    return out / np.where(top > 0, top, 1)


def contrast(x: np.ndarray, rate: int, size: int = 2048, bands: int = 6, lowest: float = 200.0, share: float = 0.02) -> np.ndarray:
    """(bands + 1, frames): decibels between the peaks and the valleys of octave bands."""
    s, f = spectra(x, size).T, np.fft.rfftfreq(size, 1 / rate)
    edges, out = [0.0, *(lowest * 2.0 ** np.arange(bands + 1))], []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        own = np.flatnonzero((f >= a) & ((f <= b) if k < bands else (f >= a)))
        part = np.sort(s[own], axis=0)
        n = max(1, round(share * len(own)))
        out.append(10 * np.log10(np.maximum(part[-n:].mean(0), 1e-10)) - 10 * np.log10(np.maximum(part[:n].mean(0), 1e-10)))
    return np.array(out)


def mfcc(_: str, content: bytes | None, rate: int = 22_050) -> np.ndarray:
    """78 numbers of length one: means and deviations over frames of 20 cepstra, 12 chroma and 7 contrast bands."""
    if content is None:
        with open(_, "rb") as f:
            content = f.read()
    x = clip(content, rate)
    if not len(x):
        raise ValueError("the clip is empty")
    return normalised(np.concatenate([m for part in (cepstra(x, rate), chroma(x, rate), contrast(x, rate)) for m in (part.mean(1), part.std(1))])).astype(np.float32)


def patches(m: np.ndarray, width: int = 96) -> np.ndarray:
    """(n, bands, width) standardised patches; a rest is dropped, too short a clip fails."""
    n = m.shape[1] // width
    if not n:
        raise ValueError("too short")
    p = m[:, : n * width].reshape(m.shape[0], n, width).transpose(1, 0, 2)
    return (p - p.mean((1, 2), keepdims=True)) / (p.std((1, 2), keepdims=True) + 1e-6)


def pooled(parts: np.ndarray) -> np.ndarray:
    """One vector of length one for the vectors of a file's patches; a zero mean is an error."""
    return normalised(np.asarray(parts, np.float32).mean(0), strict=True)


def spectral(_: str, content: bytes | None) -> np.ndarray:
    """Mean and deviation of 39 log mel bands of a WAV, of length one."""
    m = mel(clip(content), 22_050, 39)
    return normalised(np.concatenate([m.mean(1), m.std(1)]))


register("mfcc", lambda: mfcc, 78)
register("mock", lambda: mock, 64)
register("spectral", lambda: spectral, 78)
