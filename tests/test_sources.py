"""The paged source in batches and streams, and keyed streams against their batch operators."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators.tables import keep_first, keep_last
from tessella.sources import library, paged
from tessella.streaming import keyed


@pytest.fixture
def api(spark, tmp_path):
    paged.register(spark)

    def write(rows, size):
        for n in range(-(-len(rows) // size)):
            (tmp_path / f"page-{n}.json").write_text(json.dumps({"results": rows[n * size : (n + 1) * size]}))
        return {"url": f"file://{tmp_path}/page-{{page}}.json", "size": str(size), "items": "results"}

    return write


def tracks(n):
    return [{"id": str(i), "duration": i * 10, "score": i / 4, "tags": ["x", i], "live": i % 2 == 0} for i in range(n)]


@pytest.mark.parametrize("n,size", [(0, 4), (1, 4), (3, 4), (4, 4), (5, 4), (23, 4), (64, 4), (7, 1)])
def test_pages_as_a_batch(spark, api, n, size):
    rows = tracks(n)
    options = api(rows, size)
    got = spark.read.format("paged").options(**options, span="2").load().orderBy("seq").collect()
    assert [(r["seq"], r["page"], json.loads(r["value"])) for r in got] == [(i, i // size, x) for i, x in enumerate(rows)]


def test_columns_limit_and_filters(spark, api):
    options = api(tracks(23), 4)
    df = spark.read.format("paged").schema("seq long, id string, duration long, score double, tags string, live boolean, none string").options(**options, limit="10").load()
    got = df.orderBy("seq").collect()
    assert len(got) == 10 and tuple(got[3]) == (3, "3", 30, 0.75, '["x", 3]', False, None)
    assert df.where("seq >= 5 AND seq < 7").count() == 2 and df.where("seq = 9").count() == 1 and df.where("seq > 9").count() == 0
    wrong = spark.read.format("paged").schema("id long, duration string, live long").options(**options).load().first()
    assert tuple(wrong) == (0, "0", 1)
    with pytest.raises(Exception, match="url"):
        spark.read.format("paged").load().collect()


def test_only_needed_pages_are_asked_for():
    asked = []

    class Counted(paged.Api):
        def page(self, number):
            asked.append(number)
            return list(range(10)) if number < 1000 else list(range(3)) if number == 1000 else []

    api = Counted("", 10, "", None, "")
    assert api.rows() == 10_003 and len(asked) < 25
    asked.clear()
    assert api.rows(10_003) == 10_003 and asked == [1000]
    reader = paged.Reader(api, None, 3)
    asked.clear()
    list(reader.pushFilters([paged.GreaterThanOrEqual(("seq",), 25), paged.LessThan(("seq",), 41)]))
    parts = reader.partitions()
    assert [(p.first, p.end) for p in parts] == [(25, 30), (30, 41)] and not asked


def test_a_stream_of_pages_reads_on(spark, api, tmp_path):
    options = api(tracks(6), 4)

    def run():
        stream = spark.readStream.format("paged").schema("seq long, id string").options(**options).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["seq"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [(i, str(i)) for i in range(6)]
    assert run() == [(i, str(i)) for i in range(6)]  # nothing twice
    api(tracks(11), 4)  # the short page has grown
    assert run() == [(i, str(i)) for i in range(11)]
    batch = spark.read.format("paged").schema("seq long, id string").options(**options).load()
    assert sorted((r["seq"], r["id"]) for r in batch.collect()) == run()


def played(spark, tmp_path, op, steps, delay="1 hour", expiry="3650 days"):
    """All that a keyed stream gives, batch after batch of rows."""
    schema = "user long, ts timestamp, n long, what string"
    out = []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, "user long, ts string, n long, what string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = op(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), "user", "ts", "n", delay, expiry)

        def take(batch, _):
            out.extend(tuple(r) for r in batch.select("user", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "n", "what").collect())

        stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return out


STEPS = [
    [(1, "2026-01-01 10:00", 5, "a"), (1, "2026-01-01 09:30", 6, "b"), (2, "2026-01-01 10:00", 1, "c"), (2, "2026-01-01 10:00", 2, "d"), (None, "2026-01-01 10:00", 2, "x"), (3, None, 2, "x")],
    [(1, "2026-01-01 09:10", 7, "e"), (1, "2026-01-01 10:30", 8, None), (4, "2026-01-01 12:00", 1, "g")],
    [(1, "2026-01-01 08:00", 9, "late"), (5, "2026-01-01 12:10", 1, "h")],
    [(9, "2026-03-01 00:00", 1, "end")],
    [(9, "2026-03-02 00:00", 2, "end")],
]


def test_first_and_last_of_a_stream(spark, tmp_path):
    day = lambda t: f"2026-01-01 {t}"
    got = played(spark, tmp_path / "first", keyed.keep_first, STEPS)
    want = {(1, day("09:10"), 7, "e"), (2, day("10:00"), 1, "c"), (4, day("12:00"), 1, "g"), (5, day("12:10"), 1, "h"), (9, "2026-03-01 00:00", 1, "end")}
    assert set(got) == want and len(got) == len(want)
    every = [r for s in STEPS for r in s if r[0] is not None and r[1] and r[3] != "late"]
    df = spark.createDataFrame(every, "user long, ts string, n long, what string").withColumn("ts", F.to_timestamp("ts"))
    shape = lambda d: {tuple(r) for r in d.select("user", F.date_format("ts", "yyyy-MM-dd HH:mm"), "n", "what").collect()}
    assert shape(keep_first(df, "user", "ts", "n")) == want
    got = played(spark, tmp_path / "last", keyed.keep_last, STEPS)
    assert set({r[0]: r for r in got}.values()) == shape(keep_last(df, "user", "ts", "n"))


def test_a_key_expires(spark, tmp_path):
    steps = [[(1, "2026-01-01 10:00", 1, "a")], [(2, "2026-01-05 10:00", 1, "b")], [(2, "2026-01-05 11:00", 2, "b")], [(1, "2026-01-05 12:00", 3, "again")], [(3, "2026-02-01 00:00", 1, "c")], [(3, "2026-02-02 00:00", 1, "c")]]
    got = played(spark, tmp_path / "first", keyed.keep_first, steps, expiry="1 day")
    assert [r[3] for r in got if r[0] == 1] == ["a", "again"]


def test_walk_is_the_listing(spark, tmp_path):
    for name in ("a.mp3", ".h.wav", "no.txt", "d/x.FLAC", "d/e/y.ogg", "d/e/f/z.mp3", ".hid/q.mp3", "é/ü.wav", "d a/s p.mp3", "empty/none"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).touch()
    (tmp_path / "link").symlink_to(tmp_path / "d", target_is_directory=True)
    (tmp_path / "file_link.mp3").symlink_to(tmp_path / "a.mp3")
    (tmp_path / "broken.mp3").symlink_to(tmp_path / "nowhere")
    for depth in (0, 1, 2, 3, 20):
        assert [r["path"] for r in library.walk(spark, str(tmp_path), depth).collect()] == library.listing(str(tmp_path), depth)
