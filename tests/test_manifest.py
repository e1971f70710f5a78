"""The manifest of chunks against plain Python, and what goes with an index."""

import hashlib
import random

import pytest

from tessella.functions import embed
from tessella.operators import build, manifest, store

from test_library import tone


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes, fan):
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
    return nodes[0] if nodes else sha("")


def by_hand(files, chunk, fan):
    tops = []
    for path, data in sorted(files.items()):
        cut = [data[i : i + chunk] for i in range(0, len(data), chunk)] or [b""]
        tops.append(sha(f"{path}\n{len(data)}\n{climb([hashlib.sha256(c).hexdigest() for c in cut], fan)}"))
    return climb(tops, fan)


def write(root, files):
    for path, data in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)


def listed(spark, files):
    return spark.createDataFrame([(p, len(d)) for p, d in files.items()], "path string, size long")


def test_root_and_changes(spark, tmp_path):
    rng = random.Random(3)
    files = {f"d{i % 3}/f{i}.bin": rng.randbytes(n) for i, n in enumerate((0, 1, 16, 17, 160, 1000, 48, 5))}
    write(tmp_path / "a", files)
    old = manifest.build(spark, listed(spark, files), str(tmp_path / "a"), chunk=16, fan=3)
    assert old.root == by_hand(files, 16, 3)
    new = dict(files)
    big = bytearray(files["d2/f5.bin"])
    big[500] ^= 1
    new["d2/f5.bin"] = bytes(big)
    del new["d0/f0.bin"]
    new["d9/n.bin"] = b"new"
    new["d1/f4.bin"] = files["d1/f4.bin"] + rng.randbytes(40)
    new["d0/f6.bin"] = files["d0/f6.bin"][:20]
    write(tmp_path / "b", new)
    now = manifest.build(spark, listed(spark, new), str(tmp_path / "b"), chunk=16, fan=3)
    assert now.root == by_hand(new, 16, 3) != old.root
    want = {("d2/f5.bin", 31, "changed"), ("d0/f0.bin", None, "removed"), ("d9/n.bin", None, "added"), ("d0/f6.bin", 1, "changed"), ("d0/f6.bin", 2, "removed")}
    want |= {("d1/f4.bin", i, "added") for i in (10, 11, 12)}
    assert {tuple(r) for r in now.changed(old, fan=3).collect()} == want
    again = manifest.build(spark, listed(spark, files).repartition(5), str(tmp_path / "a"), chunk=16, fan=3)
    assert again.root == old.root and again.changed(old, fan=3).count() == 0
    assert manifest.build(spark, listed(spark, files).where("false"), str(tmp_path / "a")).root == sha("")
    with pytest.raises(Exception, match="changed while"):
        manifest.build(spark, spark.createDataFrame([("d1/f1.bin", 5)], "path string, size long"), str(tmp_path / "a"))


def test_audio_config_goes_with_the_index(spark, tmp_path):
    if "configured" not in embed.names():
        embed.register("configured", lambda: embed.mock, 64, {"rate": 16_000, "hop": 512})
    (tmp_path / "songs").mkdir()
    tone(tmp_path / "songs" / "a.wav", 440)
    root = str(tmp_path / "lib")
    build.build(spark, root, str(tmp_path / "songs"), "configured")
    assert store.current(spark, root)["audio"] == {"rate": 16_000, "hop": 512} == embed.audio_config("configured")
    assert embed.audio_config("mock") == {}
    with pytest.raises(embed.UnknownEmbedder):
        embed.audio_config("nope")
