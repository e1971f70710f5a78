"""A stream of urls against a scripted server: rates, rests, errors and a restart."""

import collections
import json
import os
import time

from tessella.streaming import fetching

GAP = 0.1


def server(log, folder):
    """Answers by the url; every request is a line in the log."""

    def get(url):
        host, name = url.split("://")[1].split("/")
        tried = os.path.join(folder, f"tried-{host}-{name}")
        first = not os.path.exists(tried)
        open(tried, "w").close()
        status = 404 if name == "gone" else 429 if name == "busy" and first else -1 if name == "flaky" and first else 200
        with open(log, "a") as f:
            f.write(json.dumps({"host": host, "name": name, "at": time.time(), "status": status}) + "\n")
        if status < 0:
            raise OSError("reset")
        return status, {"Retry-After": "0"}, name.encode() * 10

    return get


def test_stream_of_urls(spark, tmp_path):
    files, tried, log = tmp_path / "files", tmp_path / "tried", str(tmp_path / "log")
    files.mkdir(), tried.mkdir()
    names = ["a", "b", "busy", "c", "gone", "flaky", "d", "e"]
    rows = [(f"{h}-{n}", f"http://{h}/{n}") for h in ("one", "Two") for n in names] + [("../x", "http://one/x"), (None, "http://one/y"), ("z", None)]
    spark.createDataFrame(rows, "track_id string, preview_url string").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    out = {}

    def run(until, seconds):
        urls = spark.readStream.schema("track_id string, preview_url string").parquet(f"{tmp_path}/in/*")
        stream = fetching.fetched(urls, str(files), server(log, str(tried)), per_second=1 / GAP, hold=0.3)
        take = lambda batch, _: out.update({r["key"]: (r["size"], r["error"]) for r in batch.collect()})
        query = stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds").start()
        end = time.time() + seconds
        while time.time() < end and len(out) < until and query.exception() is None:
            time.sleep(0.2)
        query.stop()
        assert query.exception() is None, query.exception()

    run(4, 60)
    assert 4 <= len(out)
    run(17, 90)
    want = {f"{h}-{n}": (None, "status 404") if n == "gone" else (10 * len(n), None) for h in ("one", "Two") for n in names}
    assert out == want | {"../x": (None, "the key is no file name")}
    assert sorted(os.listdir(files)) == sorted(f"{k}.mp3" for k, (size, _) in want.items() if size)
    asked = [json.loads(x) for x in open(log)]
    good = collections.Counter((a["host"], a["name"]) for a in asked if a["status"] == 200)
    assert sum(good.values()) - len(good) <= 2  # at most what each host was being asked for when the stream stopped
    for host in ("one", "Two"):
        at = [(a["at"], a["name"], a["status"]) for a in asked if a["host"] == host]
        assert all(b[0] - a[0] >= 0.9 * GAP for a, b in zip(at, at[1:]))
        rests = [b[0] - a[0] for a, b in zip(at, at[1:]) if a[2] in (429, -1)]
        assert len(rests) >= 1 and min(rests) >= 0.95
