import math

import numpy as np
import pytest

from tessella.functions import embed
from tessella.operators import store
from tessella.operators.index import DimensionError, MissingError, VectorIndex, ranked
from tessella.operators.tables import incremental, keep_last
from tessella.sources import library
from tessella.streaming.continuous import index_stream


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>")


def test_steps_give_what_a_full_build_gives(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) + 5).tolist()) for i in range(40)]  # a strong common direction
    full = VectorIndex(table(spark, rows), 8)
    steps = VectorIndex(table(spark, rows[:20]), 8).upsert(table(spark, rows[20:])).upsert(table(spark, rows[:5]))
    a, b = ([(r["id"], round(r["raw_score"], 9)) for r in i.like(3, 5).collect()] for i in (full, steps))
    assert a == b and len(a) == 5 and 3 not in [x for x, _ in a]


def test_ties_zero_and_single(spark):
    i = VectorIndex(table(spark, [(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [-1.0, 0.0])]), 2)
    assert [r["id"] for r in i.search([1.0, 0.0], 2).collect()] == [1, 2]
    assert all(r["raw_score"] == 0 for r in i.search([0.0, 0.0], 4).collect())  # the centroid itself
    assert [r["raw_score"] for r in VectorIndex(table(spark, [(1, [3.0, 4.0])]), 2).search([1.0, 1.0]).collect()] == [0.0]
    assert i.search([1.0, 0.0], 0).count() == 0 and VectorIndex(table(spark, []), 2).search([1.0, 0.0]).count() == 0
    with pytest.raises(DimensionError):
        i.search([1.0])
    with pytest.raises(ValueError):
        ranked(i.rows, -1)


def test_bad_vectors(spark):
    rows = table(spark, [(1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, [1.0]), (4, None), (5, [float("inf"), 1.0]), (6, [None, 1.0])])
    assert [r["id"] for r in VectorIndex.of(rows, 2).rows.collect()] == [1]
    with pytest.raises(Exception, match="bad vector"):
        VectorIndex.of(rows, 2, strict=True).rows.collect()


def test_remove(spark):
    i = VectorIndex(table(spark, [(1, [1.0]), (2, [2.0])]), 1)
    assert [r["id"] for r in i.remove(spark.createDataFrame([(1,)], "id long")).rows.collect()] == [2]
    with pytest.raises(MissingError):
        i.remove(spark.createDataFrame([(9,)], "id long"))


def test_batch_equals_single(spark):
    rng = np.random.default_rng(2)
    i = VectorIndex(table(spark, [(k, rng.standard_normal(6).tolist()) for k in range(60)]), 6)
    got = i.search_batch(i.rows.where("id < 3").selectExpr("id AS query_id", "v"), 5).collect()
    for q in range(3):
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [r["id"] for r in i.like(q, 5).collect()]


def test_library_scan_and_embed(spark, tmp_path):
    import wave

    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("x.WAV", ".hidden.wav", "a/b/deep.wav", "note.txt"):
        with wave.open(str(tmp_path / name), "w") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(22_050)
            w.writeframes((np.sin(np.arange(22_050) / 10) * 9000).astype("<i2").tobytes())
    (tmp_path / "empty.mp3").touch()
    rows = {r["path"].rsplit("/", 1)[1]: r for r in library.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x.WAV", ".hidden.wav", "deep.wav", "empty.mp3"}
    assert rows["empty.mp3"]["id"] == "e3b0c44298fc1c149afbf4c8" and rows["empty.mp3"]["duration_seconds"] is None
    assert rows["x.WAV"]["id"] == rows["deep.wav"]["id"] and rows["x.WAV"]["duration_seconds"] == 1.0
    assert len(library.listing(str(tmp_path), 2)) == 3 and library.listing(str(tmp_path), 0) == []
    wavs = spark.read.format("binaryFile").load(f"{tmp_path}/x.WAV").select("path", "content")
    v = embed.embed(wavs, "spectral", content="content").first()
    assert v["embed_error"] is None and math.isclose(sum(x * x for x in v["embedding"]), 1, rel_tol=1e-5)
    bad = spark.createDataFrame([("p", bytearray(b"no wav"))], "path string, content binary")
    assert embed.embed(bad, "spectral", content="content").first()["embedding"] is None
    assert embed.names() == sorted(embed.names()) and {"mfcc", "mock", "spectral"} <= set(embed.names())
    p = embed.patches(embed.mel(np.random.default_rng(0).standard_normal(16_000 * 7).astype(np.float32)))
    assert p.shape[1:] == (128, 96) and abs(p.mean()) < 0.1 and abs(p.std() - 1) < 0.1


def test_store_and_stream(spark, tmp_path):
    root = str(tmp_path / "lib")
    assert store.current(spark, root) is None
    spark.createDataFrame([(1, [1.0], 1), (1, [2.0], 2), (2, [3.0], 1)], "id long, v array<double>, seq int").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("id long, v array<double>, seq int").parquet(f"{tmp_path}/in")
    index_stream(spark, rows, root, f"{tmp_path}/cp", "mock", 1).awaitTermination()
    assert sorted((r["id"], r["v"]) for r in store.load(spark, root, "vectors", "mock").collect()) == [(1, [2.0]), (2, [3.0])]
    with pytest.raises(store.EmbedderMismatch):
        store.load(spark, root, "vectors", "other")


def test_incremental(spark):
    found = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "id string, mtime double")
    stored = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "id string, mtime double")
    assert {r["id"]: r["status"] for r in incremental(found, stored).collect()} == {"a": "skipped", "b": "index", "c": "index"}
    assert keep_last(stored, "id", "mtime").count() == 2
