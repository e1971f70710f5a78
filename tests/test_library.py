"""Builds, catalogs, embedders, sources and the search engine over generated files."""

import hashlib
import io
import json
import math
import struct
import tarfile
import wave

import numpy as np
import pytest

from tessella.functions import embed, resolve
from tessella.functions import text as T
from tessella.operators import build, engine, store
from tessella.operators.catalog import Catalog, put, tracks
from tessella.operators.index import DimensionError, MissingError, VectorIndex
from tessella.operators.tables import enrich, failures, incremental, keep_first
from tessella.sources import library, remote
from tessella.streaming.continuous import index_stream


def tone(path, hz, seconds=1.0, rate=22_050, width=2, info=b""):
    x = np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate) * 0.9
    with wave.open(str(path), "w") as w:
        w.setnchannels(1), w.setsampwidth(width), w.setframerate(rate)
        full = np.round(x * (2 ** (8 * width - 1) - 1)).astype("<i4")
        w.writeframes(full.view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
    if info:
        with open(path, "ab") as f:
            f.write(info)


@pytest.fixture
def songs(tmp_path):
    folder = tmp_path / "songs"
    folder.mkdir()
    for i, hz in enumerate((220, 330, 440, 550, 660)):
        tone(folder / f"tone_{i}.wav", hz)
    return folder


def test_incremental_build_equals_full(spark, songs, tmp_path):
    root = str(tmp_path / "lib")
    r = build.build(spark, root, str(songs), "mock")
    assert (r.indexed, r.skipped, r.failed) == (5, 0, 0)
    assert (lambda r: (r.indexed, r.skipped))(build.build(spark, root, str(songs), "mock")) == (0, 5)
    tone(songs / "tone_2.wav", 777)
    assert (lambda r: (r.indexed, r.skipped))(build.build(spark, root, str(songs), "mock")) == (1, 4)
    assert store.load(spark, root, "catalog").count() == 6  # the old content stays
    (songs / "broken.mp3").write_bytes(b"x")
    steps = engine.Engine.load(spark, root)
    key = steps.catalog.rows.where("path like '%tone_0.wav'").first()["id"]
    a = [(x["id"], round(x["score"], 9)) for x in steps.like(key, 3).collect()]
    fresh = str(tmp_path / "fresh")
    store.save(fresh, {"vectors": store.load(spark, root, "vectors"), "catalog": store.load(spark, root, "catalog")}, "mock", 64)
    assert a == [(x["id"], round(x["score"], 9)) for x in engine.Engine.load(spark, fresh).like(key, 3).collect()] and len(a) == 3
    full = build.build(spark, root, str(songs), "mfcc", full=True)
    assert (full.indexed, full.failed, full.first_failed) == (5, 1, [str(songs / "broken.mp3")])
    with pytest.raises(store.EmbedderMismatch):
        build.build(spark, root, str(songs), "mock")
    one = build.add_file(spark, root, str(songs / "tone_1.wav"), "mfcc")
    assert (one.indexed, one.skipped) == (0, 1)
    with pytest.raises(FileNotFoundError):
        build.add_file(spark, root, str(songs / "none.wav"), "mfcc")
    with pytest.raises(NotADirectoryError):
        library.scan(spark, str(songs / "tone_1.wav"))


def test_two_writers(spark, tmp_path):
    root, df = str(tmp_path / "lib"), spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    store.save(root, {"vectors": df}, "mock", 1)
    store.save(root, {"vectors": df}, "mock", 1, after=1)
    with pytest.raises(store.ConcurrentWrite):
        store.save(root, {"vectors": df}, "mock", 1, after=1)
    assert store.current(spark, root)["number"] == 2
    store.save(root, {"vectors": df}, "mock", 2)
    with pytest.raises(Exception, match="not of width"):
        store.load(spark, root, "vectors").collect()


def test_engine(spark, songs, tmp_path):
    root = str(tmp_path / "lib")
    with pytest.raises(engine.NoIndex):
        engine.Engine.load(spark, root)
    build.build(spark, root, str(songs), "mfcc")
    e = engine.Engine.load(spark, root)
    copy = tmp_path / "copy.wav"
    copy.write_bytes((songs / "tone_0.wav").read_bytes())
    near = e.search(str(copy), 5).collect()  # in the library by content: leaves itself out
    assert len(near) == 4 and not any(r["path"].endswith("tone_0.wav") for r in near) and [r["rank"] for r in near] == [1, 2, 3, 4]
    by_url = e.search(f"file://{copy}", 5).collect()
    assert by_url[0]["path"].endswith("tone_0.wav") and math.isclose(by_url[0]["raw_score"], 1, abs_tol=1e-5)
    with pytest.raises(embed.TextUnsupported):
        e.search("dark ambient drone")
    with pytest.raises(resolve.UnsupportedSource):
        e.search("https://example.org/a.mp3")
    e.chain.fetch["ytdlp"] = lambda source, folder: resolve.Resolved(str(copy), source)
    assert e.search("https://example.org/a.mp3", 1).count() == 1
    rows = engine.api_rows(e.like(near[0]["id"], 2), library.rows_of(spark, [near[1]["path"]]))
    assert rows.columns == ["rank", "score", "raw_score", "track_id", "title", "artist", "album", "duration", "has_audio", "extra"]
    assert json.loads(engine.json_rows(e.like(near[0]["id"], 1)).first()["line"])["artist"] is None
    e.catalog = e.catalog.remove(e.catalog.ids().where(e.catalog.rows["id"] == near[0]["id"]))
    assert [r["rank"] for r in e.search(str(copy), 5).collect()] == [2, 3, 4]


def test_text_queries():
    class Words:
        def __call__(self, key, content):
            return embed.mock(key)

        def embed_text(self, text):
            return embed.mock(text)

        def embed_batch(self, keys, contents):
            if "bad" in keys:
                raise ValueError("bad one")
            return [embed.mock(k) for k in keys]

    if "words" not in embed.names():
        embed.register("words", Words, 64)
    assert np.allclose(embed.embed_text("words", "drone"), embed.mock("drone"))
    v, errors = embed.each(Words(), ["a", "b"], [None, None], 64)
    assert errors == [None, None] and np.allclose(v[1], embed.mock("b"))
    _, errors = embed.each(lambda k, c: np.zeros(3), ["a"], [None], 64)
    assert "shape" in errors[0]
    with pytest.raises(ValueError):
        embed.register("words", Words, 64)
    with pytest.raises(embed.UnknownEmbedder, match="mfcc"):
        embed.find("nope")
    with pytest.raises(ValueError, match="zero"):
        embed.pooled(np.zeros((2, 4)))


def test_guards():
    for bad in (("", 1, 0), ("file:///a", 1, 0), ("a", 0, 0), ("a", 101, 0), ("a", 1, 1.5)):
        with pytest.raises(engine.BadRequest):
            engine.check_request(*bad)
    engine.check_request("a", 100, -1)
    assert [engine.status_of(e) for e in (engine.NoIndex(), engine.BadRequest(), resolve.PreviewUnavailable(), resolve.ResolverError(), KeyError())] == [503, 422, 422, 502, 500]
    c = resolve.Chain()
    assert [c.name(s) for s in ("/a.mp3", "file:///a", "https://open.spotify.com/track/1?x", "https://open.spotify.com/album/1", "http://x")] == ["local", "local", "spotify", "ytdlp", "ytdlp"]
    with pytest.raises(resolve.UnsupportedSource):
        c.name("ftp://x")


def test_upsert_is_checked(spark):
    t = lambda rows: spark.createDataFrame(rows, "id long, v array<double>, seq int")
    i = VectorIndex(t([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 1.0], 0)]).select("id", "v"), 2)
    for bad in ([float("nan"), 1.0], [float("inf"), 1.0], [1.0], None):
        with pytest.raises(Exception, match="bad vector"):
            i.upsert(t([(4, bad, 0)])).rows.collect()
        assert i.upsert(t([(4, bad, 0)]), strict=False).search([1.0, 0.0], 5).count() == 3
    twice = i.upsert(t([(1, [5.0, 5.0], 2), (1, [9.0, 9.0], 1)]), "seq").rows.where("id = 1").collect()
    assert [r["v"] for r in twice] == [[5.0, 5.0]]
    with pytest.raises(ValueError, match="finite"):
        i.search([float("nan"), 0.0])
    with pytest.raises(DimensionError):
        i.search([1.0])
    assert i.like(99).count() == 0 and i.get(3, centred=True).count() == 1


def test_batch_search_in_blocks(spark, monkeypatch):
    from tessella.operators import kernel

    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(-2, 3, 3).astype(float).tolist()) for k in range(80)]  # many ties
    i = VectorIndex(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), 3)
    ask = i.rows.where("id % 9 = 0").selectExpr("id AS query_id", "v")
    few = sorted(map(tuple, i.search_batch(ask, 7).collect()))
    monkeypatch.setattr(kernel, "SENT", 0), monkeypatch.setattr(kernel, "ROWS", 20)
    many = sorted(map(tuple, i.search_batch(ask, 7).collect()))
    assert [(r[0], r[1], r[3]) for r in few] == [(r[0], r[1], r[3]) for r in many] and len(few) == 63


def test_stream_keeps_bad_vectors_out(spark, tmp_path):
    spark.createDataFrame([(1, [1.0], 1), (2, [float("nan")], 1), (3, [1.0, 2.0], 1)], "id long, v array<double>, seq int").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("id long, v array<double>, seq int").parquet(f"{tmp_path}/in")
    index_stream(spark, rows, f"{tmp_path}/lib", f"{tmp_path}/cp", "mock", 1).awaitTermination()
    assert [r["id"] for r in store.load(spark, f"{tmp_path}/lib", "vectors").collect()] == [1]


def test_catalog(spark, tmp_path):
    rows = spark.createDataFrame([("id1", "a\\b.mp3", "x"), ("id1", "z.mp3", "y"), ("b", "b.mp3", None)], "id string, path string, title string")
    c = Catalog.of(rows, "lib")
    assert {(r["id"], r["path"], r["title"]) for r in c.rows.collect()} == {("id1", "z.mp3", "y"), ("b", "b.mp3", None)}
    c = c.add(spark.createDataFrame([("id1", "a\\b.mp3", "new")], "id string, path string, title string"))
    assert c.get("id1").first()["path"] == "a/b.mp3" and c.rows.count() == 2 and c.get("zz").isEmpty()
    with pytest.raises(MissingError):
        c.remove(spark.createDataFrame([("zz",)], "id string"))
    assert [r["id"] for r in c.remove(spark.createDataFrame([("b",)], "id string")).ids().collect()] == ["id1"]
    with pytest.raises(store.SchemaError):
        tracks(spark.createDataFrame([("a",)], "id string"))
    made = c.rows.select(put(c.rows["extra"], {"k": c.rows["title"], "n": c.rows["artist"]}).alias("e")).collect()
    assert {"k": "new"} in [r["e"] for r in made]
    whole = {"schema_version": 1, "library_id": "lib", "tracks": [json.loads(r["value"]) for r in c.lines().collect()] + [{"id": "b", "path": "later.mp3", "unknown": 1}]}
    (tmp_path / "catalog.json").write_text(json.dumps(whole))
    with pytest.warns(UserWarning, match="lib"):
        back = Catalog.read_json(spark, f"{tmp_path}/catalog.json", "other")
    assert back.get("b").first()["path"] == "later.mp3" and back.rows.count() == 2
    (tmp_path / "catalog.json").write_text(json.dumps(whole | {"schema_version": 9}))
    with pytest.raises(store.SchemaError):
        Catalog.read_json(spark, f"{tmp_path}/catalog.json")


def test_tables_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, None, "c")], "_n long, key long, row string")
    assert {tuple(r) for r in keep_first(df, "_n", "key").collect()} == {(1, 1, "b"), (2, None, "c")}
    got = incremental(df, df.where("key = 1"), "_n", "key")
    assert got.columns == ["_n", "key", "row", "status"] and got.where("status = 'skipped'").count() == 1
    t = spark.createDataFrame([("a", "", 1)], "key string, title string, side long")
    s = spark.createDataFrame([("a", "x", 5), ("a", "y", 7)], "key string, title string, side long")
    assert [tuple(r) for r in enrich(t, s, "key", ["title"], ["side"]).collect()] == [("a", "y", 7)]
    f = spark.createDataFrame([(f"p{i:02d}", "failed") for i in range(13)], "path string, status string")
    assert (lambda r: (len(r["first"]), r["first"][0], r["more"]))(failures(f).first()) == (10, "p00", 3)
    assert failures(f.where("false")).first()["more"] == 0


def test_tags(tmp_path):
    text = lambda name, x: name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2)
    body = b"INFO" + text(b"INAM", b"Song") + text(b"IART", b"Someone") + text(b"IPRD", b"Disc")
    tone(tmp_path / "a.wav", 440, info=b"LIST" + struct.pack("<I", len(body)) + body)
    assert library.tags(str(tmp_path / "a.wav")) == ("Song", "Someone", "Disc", 1.0)
    frame = lambda name, x: name + len(x).to_bytes(4, "big") + b"\0\0" + x
    frames = frame(b"TIT2", b"\x03Na\xc3\xafve") + frame(b"TPE1", b"\x01" + "Zwei\0Drei".encode("utf-16")) + frame(b"TALB", b"\0Disc")
    n = len(frames)
    head = b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    (tmp_path / "a.mp3").write_bytes(head + frames + b"\xff\xfb")
    assert library.tags(str(tmp_path / "a.mp3")) == ("Naïve", "Zwei", "Disc", None)
    notes = [b"TITLE=One", b"title=Two", b"Album=Disc"]
    block = struct.pack("<I", 1) + b"v" + struct.pack("<I", 3) + b"".join(struct.pack("<I", len(x)) + x for x in notes)
    info = bytes(10) + (44_100 << 44 | 88_200).to_bytes(8, "big") + bytes(16)
    (tmp_path / "a.flac").write_bytes(b"fLaC\0" + len(info).to_bytes(3, "big") + info + b"\x84" + len(block).to_bytes(3, "big") + block)
    assert library.tags(str(tmp_path / "a.flac")) == ("One", None, "Disc", 2.0)
    (tmp_path / "bad.flac").write_bytes(b"fLaC\0\0\0\xff")
    assert library.tags(str(tmp_path / "bad.flac")) == library.tags(str(tmp_path / "none")) == (None, None, None, None)


def test_clip(tmp_path):
    clips = []
    for width in (2, 3, 4):
        tone(tmp_path / "x.wav", 440, 2.0, 44_100, width)
        clips.append(library.clip((tmp_path / "x.wav").read_bytes()))
    assert abs(len(clips[0]) - 1.8 * 22_050) <= 1 and np.allclose(clips[0], clips[1], atol=1e-4) and np.allclose(clips[1], clips[2], atol=1e-6)
    assert abs(np.abs(clips[0][1000:-1000]).max() - 0.9) < 0.01
    tone(tmp_path / "x.wav", 16_000, 1.0, 44_100)  # above the new Nyquist rate: filtered, not folded
    assert np.abs(library.clip((tmp_path / "x.wav").read_bytes())[1000:-1000]).max() < 0.01


def test_mfcc(tmp_path):
    tone(tmp_path / "a.wav", 440, 3.0), tone(tmp_path / "b.wav", 880, 3.0), tone(tmp_path / "c.wav", 220, 3.0)
    a, b, c = (embed.mfcc(None, (tmp_path / f"{x}.wav").read_bytes()) for x in "abc")
    assert a.shape == (78,) and a.dtype == np.float32 and abs(np.linalg.norm(a) - 1) < 1e-5 and np.isfinite(a).all()
    assert np.array_equal(a, embed.mfcc(str(tmp_path / "a.wav"), None)) and not np.allclose(a, b) and not np.allclose(a, c)
    x = library.clip((tmp_path / "a.wav").read_bytes())
    assert embed.chroma(x, 22_050).mean(1).argmax() == 9 and embed.contrast(x, 22_050).shape[0] == 7
    # the first cepstrum is the scaled mean of the mel bands
    db = embed.decibels(embed.mel_power(x, 22_050, 128))
    assert np.allclose(embed.cepstra(x, 22_050)[0], db.sum(0) / np.sqrt(128))
    for bad in (b"", b"RIFF"):
        with pytest.raises(Exception):
            embed.mfcc("p", bad)


def test_remote(spark, tmp_path):
    calls, waits = [], []

    def get(url):
        calls.append(url)
        if url == "flaky" and len(calls) < 3:
            raise OSError("down")
        if url == "busy" and len(calls) < 2:
            return 429, {"Retry-After": "3"}, b""
        return (404, {}, b"") if url == "gone" else (200, {}, b"body")

    assert remote.get_with_backoff(get, "flaky", sleep=waits.append) == b"body" and waits == [1, 2]
    calls.clear(), waits.clear()
    assert remote.get_with_backoff(get, "busy", sleep=waits.append) == b"body" and waits == [4]
    with pytest.raises(OSError, match="404"):
        remote.get_with_backoff(get, "gone")
    data = [{"n": i} for i in range(450)]
    assert len(list(remote.pages(lambda at: data[at : at + 200]))) == 450 and len(list(remote.pages(lambda at: data[at : at + 200], limit=210))) == 210
    folder = tmp_path / "pack"
    folder.mkdir()
    for n in ("b.txt", "a.txt"):
        (folder / n).write_text(n)
    manifest = remote.package(str(folder), str(tmp_path / "p.tar.gz"))
    data = (tmp_path / "p.tar.gz").read_bytes()
    assert manifest["sha256"] == hashlib.sha256(data).hexdigest() and remote.unpack(data, manifest["sha256"].upper(), str(tmp_path / "out")) == ["a.txt", "b.txt"]
    with pytest.raises(remote.ChecksumError):
        remote.unpack(data, "0" * 64, str(tmp_path / "out"))
    for name in ("/etc/x", "../x", "a/../../x"):
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w:gz") as tar:
            tar.addfile(tarfile.TarInfo(name))
        with pytest.raises(remote.UnsafeArchive):
            remote.unpack(raw.getvalue(), hashlib.sha256(raw.getvalue()).hexdigest(), str(tmp_path / "out"))
    (tmp_path / "bundled.json").write_text(json.dumps({"indexes": [{"name": "x", "description": "", "embedder": "mfcc", "tracks": 1, "url": "u", "sha256": manifest["sha256"], "size_bytes": 10 << 20, "more": 1}]}))
    assert remote.registry_entries(get, "gone", str(tmp_path / "bundled.json"))[0]["name"] == "x"
    entries = library.registry(spark, f"{tmp_path}/bundled.json")
    assert entries.first()["size_mb"] == 10 and remote.fetch_index(entries, "x", lambda u: (200, {}, data), str(tmp_path / "out2")) == ["a.txt", "b.txt"]
    with pytest.raises(KeyError):
        remote.fetch_index(entries, "y", get, str(tmp_path))
    (tmp_path / "bad.json").write_text(json.dumps({"indexes": [{"name": "x"}]}))
    with pytest.raises(Exception, match="lacks a field"):
        library.registry(spark, f"{tmp_path}/bad.json").collect()
    t = spark.createDataFrame([("1", "a\tb", None, 7)], "track_id string, title string, artist string, other int")
    remote.write_tsv(t, f"{tmp_path}/t", ["track_id", "title", "artist"])
    back = library.tsv(spark, f"{tmp_path}/t").first()
    assert back["title"] == "a\tb" and back["artist"] is None
    remote.write_sidecar(t.withColumnRenamed("track_id", "id"), f"{tmp_path}/side")
    assert remote.read_sidecar(spark, f"{tmp_path}/side", "title string, other int").first()["other"] == 7
    wanted = spark.createDataFrame([("k1", "http://a"), ("k2", "gone")], "track_id string, preview_url string")
    got = {r["track_id"]: r for r in remote.download(wanted, str(tmp_path), lambda u: (404 if u == "gone" else 200, {}, b"x" * 50), cap=20).collect()}
    assert got["k1"]["size"] == 20 and "404" in got["k2"]["error"]


def test_text_columns(spark):
    df = spark.createDataFrame([("file:///a%20b+c.mp3", "dir\\x.tar.gz", "1500")], "u string, p string, ms string")
    r = df.select(T.file_url_path(df["u"]).alias("u"), T.stem(T.posix(df["p"])).alias("s"), T.mime(df["p"]).alias("m"), T.seconds(df["ms"]).alias("t"), T.seconds(df["p"]).alias("n"), T.track_url(df["ms"]).alias("l")).first()
    assert tuple(r) == ("/a b+c.mp3", "x.tar", "audio/mpeg", 1.5, None, "https://open.spotify.com/track/1500")
