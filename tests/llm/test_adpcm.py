"""ADPCM against a plain coder, and what is stored of a text against the stored bytes alone."""

import hashlib
import struct

import numpy as np

from tessella.llm import telephony as T

# What the format says, written out again.
STEP = [int(x) for x in T.STEPS]
MOVE = [-1, -1, -1, -1, 2, 4, 6, 8]


def decoded(block):
    value, index = struct.unpack("<hB", block[:3])
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = STEP[index]
            change = step >> 3
            if code & 4:
                change += step
            if code & 2:
                change += step >> 1
            if code & 1:
                change += step >> 2
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + MOVE[code & 7]))
            out.append(value)
    return out


def mulaw(byte):
    byte = ~byte & 255
    size = ((byte & 15) * 2 + 33 << (byte >> 4 & 7)) - 33
    return -4 * size if byte & 128 else 4 * size


def test_coder_follows_a_signal():
    rng = np.random.default_rng(1)
    t = np.arange(121 * 40)
    for x in (8000 * np.sin(t / 9), 200 * np.sin(t / 3) + 30_000 * (t % 700 > 350), rng.integers(-32768, 32768, len(t)), np.zeros(len(t)), np.full(len(t), -32768)):
        x = np.clip(np.rint(x), -32768, 32767).astype(np.int16).reshape(-1, 121)
        blocks = T.ima_encode(x)
        assert blocks.shape == (40, 64) and blocks.dtype == np.uint8
        back = T.ima_decode(blocks)
        assert back.tolist() == [decoded(b.tobytes()) for b in blocks] and (back[:, 0] == x[:, 0]).all()
    smooth = np.rint(8000 * np.sin(t / 9)).astype(np.int16).reshape(-1, 121)
    error = np.abs(T.ima_decode(T.ima_encode(smooth)).astype(int) - smooth)
    assert error.mean() < 250  # 3 % of its peak


def test_what_is_stored(spark):
    texts = ["héllo " * 60, None, "", "x" * 64, "a\n" * 5000]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, ima_error int").repartition(2)
    for r in T.text_features(df).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        x = [mulaw(b) for b in raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))]
        up = []
        for i, v in enumerate(x):
            far = [x[max(0, min(len(x) - 1, i + d))] for d in (-1, 1, 2)]
            up += [v, max(-32768, min(32767, 9 * (v + far[1]) - far[0] - far[2] + 8 >> 4))]
        data = np.array(up, "<i2").tobytes()
        head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16_000, 32_000, 2, 16) + b"data" + struct.pack("<I", len(data))
        assert (r["pcm_bytes"], r["pcm_sha256"]) == (44 + len(data), hashlib.sha256(head + data).hexdigest())
        padded = x + [x[-1]] * (-len(x) % 121)
        blocks = T.ima_encode(np.array(padded, np.int16).reshape(-1, 121))
        media = T.wav(T.IMA, blocks.tobytes(), 8000, 4, 64)
        assert (r["ima_bytes"], r["ima_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        back = [v for b in blocks for v in decoded(b.tobytes())][: len(x)]
        assert r["ima_error"] == sum(abs(a - b) for a, b in zip(back, x)) // len(x)
        assert T.samples(media)[: len(x)].tolist() == back
