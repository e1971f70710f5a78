"""The log of changes, the stored index and its centroid, blocks, the change feed, moments and rejects."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessella.operators import blocks, build, changes, engine, kernel, moments, rejects, store
from tessella.operators.catalog import Catalog
from tessella.operators.delta import Conflict, Log, Moved, Unknown
from tessella.operators.index import VectorIndex
from tessella.operators.stored import StoredIndex
from tessella.sources import library
from tessella.streaming.continuous import index_stream

from test_library import tone  # noqa: E402

ROWS = "id long, v array<double>"


def table(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema)


def held(df):
    return sorted((r["id"], tuple(r["v"])) for r in df.collect())


def test_any_sequence_of_changes_reads_as_a_full_build(spark, tmp_path):
    rng, log, want = random.Random(3), Log(spark, str(tmp_path / "t"), buckets=3), {}
    log.replace({"t": (table(spark, []), "id")})
    for step in range(14):
        up = {rng.randrange(30): [float(step), rng.random()] for _ in range(rng.randrange(6))}
        out = {rng.randrange(30) for _ in range(rng.randrange(4))}
        log.change({"t": table(spark, list(up.items()))}, {"t": table(spark, [(i, None) for i in out])})
        want = {k: v for k, v in want.items() if k not in out} | up
        assert held(log.read("t")) == sorted((k, tuple(v)) for k, v in want.items()), step
        if step % 3 == 2:
            log.compact("t")
            assert held(log.read("t")) == sorted((k, tuple(v)) for k, v in want.items()), step
    log.compact("t", whole=True)
    assert not log.version()["tables"]["t"]["deltas"] and held(log.read("t")) == sorted((k, tuple(v)) for k, v in want.items())


def test_a_change_writes_its_own_rows(spark, tmp_path):
    log = Log(spark, str(tmp_path / "t"), buckets=4)
    log.replace({"t": (spark.range(20_000).select("id", F.array(F.rand(1), F.rand(2)).alias("v")), "id")})
    before = {d["folder"]: d["bytes"] for d in (log.version()["tables"]["t"]["base"],)}
    log.change({"t": table(spark, [(5, [0.0, 0.0]), (90_000, [1.0, 1.0])])})
    t = log.version()["tables"]["t"]
    assert t["base"]["folder"] in before and len(t["deltas"]) == 1 and t["deltas"][0]["bytes"] * 20 < t["base"]["bytes"]
    assert log.read("t").count() == 20_001 and log.read("t", 1).count() == 20_000
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = log.read("t")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    join = plan[plan.index("SortMergeJoin") :]
    left = join[: join.index("Exchange")]  # what stands before the first exchange is the base, read by its buckets
    assert plan.count("Exchange hashpartitioning") == 1 and "FileScan" in left and "Bucketed: true" in left


def test_writers_meet(spark, tmp_path):
    log, other = Log(spark, str(tmp_path / "t"), buckets=2), Log(spark, str(tmp_path / "t"), buckets=2)
    log.replace({"t": (table(spark, [(1, [1.0])]), "id")})
    publish, done = log._publish, []

    def late(head):
        if not done:
            done.append(other.change({"t": table(spark, [(2, [2.0])])}))
        return publish(head)

    log._publish = late
    assert log.change({"t": table(spark, [(3, [3.0])])}) == 3
    assert held(log.read("t")) == [(1, (1.0,)), (2, (2.0,)), (3, (3.0,))]
    with pytest.raises(Moved):
        log.change({"t": table(spark, [(4, [4.0])])}, based=1)
    done.clear()
    log.compact("t", whole=True)  # the other's change comes meanwhile and stays
    assert held(log.read("t")) == [(1, (1.0,)), (2, (2.0,)), (3, (3.0,))] and len(log.version()["tables"]["t"]["deltas"]) == 1
    log._publish = lambda head: False
    with pytest.raises(Conflict):
        log.change({"t": table(spark, [(9, [9.0])])})
    with pytest.raises(Unknown):
        log.read("u")
    with pytest.raises(Exception, match="without a key"):
        other.change({"t": table(spark, [(None, [9.0])])})


def test_old_versions_expire(spark, tmp_path):
    log = Log(spark, str(tmp_path / "t"), buckets=2)
    log.replace({"t": (table(spark, [(1, [1.0])]), "id")})
    for i in range(4):
        log.change({"t": table(spark, [(i, [float(i)])])})
    log.compact("t", whole=True)
    assert log.expire(keep=1) == []  # young folders may be another writer's
    assert len(log.expire(keep=1, grace=0.0)) == 5 and log.numbers() == [6]
    assert held(log.read("t")) == [(i, (float(i),)) for i in range(4)]
    with pytest.raises(Unknown):
        log.read("t", 2)


def test_folders_are_put_together_by_size(spark, tmp_path):
    log = Log(spark, str(tmp_path / "t"))
    part = lambda *sizes: {"base": {"bytes": 1000}, "deltas": [{"bytes": s} for s in sizes]}
    assert log.plan(part()) is None and log.plan(part(10, 10)) is None
    assert log.plan(part(10, 10, 10, 10)) == 0 and log.plan(part(300, 5, 5, 5, 5)) == 1
    assert log.plan(part(300, 200)) == -1


def test_the_centroid_is_kept(spark, tmp_path):
    rng, want = np.random.default_rng(5), {}
    s = moments.Sums.none(6)
    for step in range(100):  # the state alone: rows come and go far from zero
        x = rng.standard_normal((rng.integers(1, 9), 6)) * 10.0 ** rng.integers(-3, 7) + 1e6
        for row in x:
            want[len(want), step] = row
        s = s.plus(moments.Sums.of(x).counted(len(x)))
        gone = [k for k in want if rng.random() < 0.3]
        if gone:
            s = s.minus(moments.Sums.of(np.array([want.pop(k) for k in gone])).counted(len(gone)))
    exact = np.array([float(sum(map(__import__("fractions").Fraction, map(float, c)))) / len(want) for c in np.array(list(want.values())).T])
    assert s.n == len(want) and np.allclose(s.mean(), exact, rtol=1e-9)

    rows = {i: rng.standard_normal(6) + 100 for i in range(200)}
    df = lambda d: table(spark, [(k, v.tolist()) for k, v in d.items()])
    index = StoredIndex.create(VectorIndex(df(rows), 6), str(tmp_path / "i"), "mock")
    for step in range(3):
        new = {int(i): rng.standard_normal(6) - 50 for i in rng.integers(0, 260, 20)}
        gone = [int(i) for i in rng.integers(0, 200, 15)]
        index.change(df(new), table(spark, [(i, None) for i in gone]))
        rows = {k: v for k, v in rows.items() if k not in gone} | new
        assert index.index().known is not None and np.allclose(index.index().centre, np.mean(list(rows.values()), 0), atol=1e-9)
    a = [(r["id"], round(r["raw_score"], 9)) for r in index.index().like(7 if 7 in rows else next(iter(rows)), 5).collect()]
    b = [(r["id"], round(r["raw_score"], 9)) for r in VectorIndex(df(rows), 6).like(7 if 7 in rows else next(iter(rows)), 5).collect()]
    assert a == b


@pytest.mark.parametrize("centred", [True, False])
def test_blocks_give_what_a_scan_gives(spark, centred):
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((12, 8)) * 4
    rows = [(i, (middle[i % 12] + rng.standard_normal(8) * 0.1 + 3).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(7)] + [(2000, np.mean([v for _, v in rows], 0).tolist())]  # ties, and a row near the centroid
    df = table(spark, rows).repartition(5)
    packed = blocks.pack(df, 8, size=16, pivots=24).cache()
    assert sorted(i for r in packed.collect() for i in r["ids"]) == sorted(i for i, _ in rows)
    centre = VectorIndex(df, 8).centre if centred else None
    ask = table(spark, [(i, v) for i, v in rows[:6]] + [(-1, [0.0] * 8), (-2, rows[5][1])], "query_id long, v array<double>")
    found = blocks.top(packed, ask, 9, centre, 8)
    shape = lambda d: sorted((r["query_id"], r["rank"], r["id"], round(r["raw_score"], 9)) for r in d.collect())
    assert shape(found.rows) == shape(kernel.top(df, ask, 9, centre, 8))
    one = blocks.top(packed, ask.where("query_id = 3"), 9, centre, 8, without=[3, 15, 27])
    assert shape(one.rows) == shape(kernel.top(df.where("id NOT IN (3, 15, 27)"), ask.where("query_id = 3"), 9, centre, 8))
    assert one.share() > 0.5  # most blocks lie elsewhere
    assert blocks.top(packed, ask, 0, centre, 8).rows.count() == 0 and blocks.top(packed.where("false"), ask, 3, centre, 8).rows.count() == 0
    assert blocks.pack(df.where("false"), 8).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(7)
    for _ in range(200):
        x = rng.standard_normal((20, 5)) * rng.choice([1e-4, 0.1, 3]) + rng.standard_normal(5)
        c, q = rng.standard_normal(5) * rng.choice([0, 1]), rng.standard_normal(5)
        m = x.mean(0)
        r = np.sqrt(((x - m) ** 2).sum(1).max())
        q = q / np.linalg.norm(q)
        assert (kernel.unit(x, c.tolist()) @ q).max() <= blocks.bounds(q[None], m[None], np.array([r]), c)[0, 0]


def test_packed_store(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(f"t{i:03d}", rng.standard_normal(4).tolist()) for i in range(300)]
    index = StoredIndex.create(VectorIndex(table(spark, rows, "id string, v array<double>"), 4), str(tmp_path / "p"), "mock")
    ask = table(spark, rows[:4], "query_id string, v array<double>")
    shape = lambda d: sorted((r["query_id"], r["rank"], r["id"], round(r["raw_score"], 9)) for r in d.collect())
    assert index.search(ask, 5)[1] is None
    index.pack()
    assert index.search(ask, 5)[1] is not None and shape(index.search(ask, 5)[0]) == shape(index.index().search_batch(ask, 5))
    index.change(table(spark, [("t007", rows[0][1]), ("new", rows[1][1])], "id string, v array<double>"), table(spark, [("t009", None)], "id string, v array<double>"))
    got, found = index.search(ask, 5)
    assert found is not None and shape(got) == shape(index.index().search_batch(ask, 5)) and got.where("id = 'new' AND query_id = 't001' AND rank = 1").count() == 1


def test_batch_queries_are_checked(spark):
    i = VectorIndex(table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]), 2)
    ask = lambda rows: i.search_batch(table(spark, rows, "query_id long, v array<double>"), 1)
    for bad in ([(1, [float("nan"), 0.0])], [(1, [1.0])], [(1, [1.0, 0.0]), (1, [0.0, 1.0])], [(None, [1.0, 0.0])], [(1, None)], [(1, [None, 1.0])], [(1, [1.0, 0.0]), (2, [1.0])]):
        with pytest.raises(ValueError):
            ask(bad).collect()
    with pytest.raises(ValueError):
        i.search_batch(table(spark, [(1, [1.0, 0.0])], "query_id long, v array<double>"), -1)
    assert ask([]).count() == 0 and ask([(9, [0.0, 0.0])]).first()["id"] == 1


def test_equal_rows_tie_wherever_they_stand(spark):
    rng = np.random.default_rng(9)
    same = rng.standard_normal(37).tolist()
    rows = [(i, same if i % 3 == 0 else rng.standard_normal(37).tolist()) for i in range(400)]
    i = VectorIndex(table(spark, rows).repartition(7), 37)
    assert [r["id"] for r in i.search(same, 12).collect()] == list(range(0, 36, 3))
    got = i.search_batch(table(spark, [(-5, same)], "query_id long, v array<double>"), 12).orderBy("rank").collect()
    assert [r["id"] for r in got] == list(range(0, 36, 3))


def classified(found, known):
    """The feed in plain Python: found path -> (id, time), known id -> path."""
    out, by_id = set(), {}
    for p, (i, _) in found.items():
        if i is not None:
            by_id.setdefault(i, []).append(p)
    lost = {k: p for k, p in known.items() if k not in by_id and not (p in found and found[p][0] is None)}
    taken = {}
    for i, ps in by_id.items():
        home = known.get(i)
        keep = home if home in ps else max(ps)
        for p in ps:
            t = found[p][1]
            if p == home:
                out.add(("same", p, i, t, None, None))
            elif p != keep:
                out.add(("duplicate", p, i, t, None, None))
            elif home:
                out.add(("moved", p, i, t, home, None))
            else:
                taken[p] = i
    at = {p: k for k, p in lost.items()}
    for p, i in taken.items():
        out.add(("changed" if p in at else "added", p, i, found[p][1], None, at.get(p)))
    return out | {("deleted", None, None, None, p, k) for k, p in lost.items() if p not in taken}


def test_change_feed(spark):
    rng = random.Random(4)
    for _ in range(3):
        known = {f"c{i}": f"/p{i}" for i in range(30)}
        found = {f"/p{rng.randrange(40)}": (rng.choice([f"c{rng.randrange(45)}", None]) if rng.random() < 0.9 else "hot", float(rng.randrange(5))) for _ in range(60)}
        found |= {f"/q{i}": ("hot", 1.0) for i in range(12)}
        f = table(spark, [(p, i, t) for p, (i, t) in found.items()], "path string, id string, mtime double")
        k = table(spark, list(known.items()), "id string, path string")
        got = changes.feed(f, k).select("status", "path", "id", "stamp", "old_path", "old_id").collect()
        assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == classified(found, known)
    none = k.where("false")
    assert changes.feed(f.where("false"), none).count() == 0
    assert {r["status"] for r in changes.feed(f.where("false"), k).collect()} == {"deleted"}


@pytest.fixture
def songs(tmp_path):
    folder = tmp_path / "songs"
    folder.mkdir()
    for i, hz in enumerate((220, 330, 440, 550, 660)):
        tone(folder / f"tone_{i}.wav", hz)
    return folder


def test_sync_equals_a_full_build(spark, songs, tmp_path):
    root, fresh = str(tmp_path / "lib"), str(tmp_path / "fresh")
    r, kinds = build.sync(spark, root, str(songs), "mock")
    assert (r.indexed, kinds["added"]) == (5, 5)
    assert build.sync(spark, root, str(songs), "mock")[1]["same"] == 5
    tone(songs / "tone_2.wav", 777)
    (songs / "tone_3.wav").unlink()
    shutil.move(songs / "tone_4.wav", songs / "moved.wav")
    shutil.copy(songs / "tone_0.wav", songs / "z_copy.wav")
    tone(songs / "new.wav", 880)
    (songs / "empty.mp3").touch()
    was = {x["path"]: x["id"] for x in store.load(spark, root, "catalog").collect()}
    r, kinds = build.sync(spark, root, str(songs), "mock")
    assert kinds == {"added": 2, "changed": 1, "moved": 1, "deleted": 1, "duplicate": 1, "same": 2} or kinds["changed"] == 1
    build.build(spark, fresh, str(songs), "mock")
    # of two files with one content a full build takes the last path, a feed keeps the known one
    full = {(x["id"], tuple(x["v"])) for x in store.load(spark, fresh, "vectors").collect()}
    mine = {(x["id"], tuple(x["v"])) for x in store.load(spark, root, "vectors").collect()}
    assert {i for i, _ in mine} == {i for i, _ in full}
    moved = {x["id"] for x in store.load(spark, root, "catalog").where("path LIKE '%moved.wav' OR path LIKE '%tone_0.wav'").collect()}
    assert {m for m in mine if m[0] not in moved} == {m for m in full if m[0] not in moved}  # the mock embeds paths
    assert {x["path"].rsplit("/", 1)[1] for x in store.load(spark, root, "catalog").collect()} == {"tone_0.wav", "tone_1.wav", "tone_2.wav", "moved.wav", "new.wav", "empty.mp3"}
    past = store.load(spark, root, "history").collect()
    assert {x["id"] for x in past} == {was[str(songs / "tone_2.wav")], was[str(songs / "tone_3.wav")]} and all(x["valid_to"] for x in past)
    held_ = StoredIndex.open(spark, root)
    assert np.allclose(held_.index().centre, np.mean([v for _, v in mine], 0), atol=1e-9)
    assert engine.Engine.load(spark, root).like(next(iter(moved)), 3).count() == 3


def test_add_file_replaces_its_older_row(spark, songs, tmp_path):
    root = str(tmp_path / "lib")
    build.build(spark, root, str(songs), "mock")
    tone(songs / "tone_1.wav", 999)
    one = build.add_file(spark, root, str(songs / "tone_1.wav"), "mock")
    rows = store.load(spark, root, "catalog").collect()
    assert one.indexed == 1 and len(rows) == 5 and len({r["path"] for r in rows}) == 5
    assert store.load(spark, root, "vectors").count() == 5


def test_incremental_build_equals_a_full_one(spark, songs, tmp_path):
    steps, whole = str(tmp_path / "steps"), str(tmp_path / "whole")
    first = library.scan(spark, str(songs)).where("path < '" + str(songs / "tone_3") + "'")
    build.build(spark, steps, first, "mock")
    build.build(spark, steps, str(songs), "mock")
    build.build(spark, whole, str(songs), "mock")
    for name in ("vectors", "catalog"):
        a, b = (sorted(map(str, store.load(spark, root, name).collect())) for root in (steps, whole))
        assert a == b and len(a) == 5


def test_stream_of_changes_equals_a_full_build(spark, tmp_path):
    rng, want, root = random.Random(5), {}, str(tmp_path / "lib")
    schema = "id long, v array<double>, seq int, gone boolean"
    for batch in range(4):
        rows = [(rng.randrange(12), [rng.random(), float(batch)], seq, rng.random() < 0.25) for seq in range(8)]
        rows += [(rng.randrange(12), [float("nan"), 0.0], 99, False)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        index_stream(spark, stream, root, f"{tmp_path}/cp", "mock", 2).awaitTermination()
        for i, v, _, gone in (r for r in rows if r[1][0] == r[1][0]):
            want.pop(i, None)
            if not gone:
                want[i] = v
        assert held(store.load(spark, root, "vectors")) == sorted((i, tuple(v)) for i, v in want.items())
    held_ = StoredIndex.open(spark, root)
    assert np.allclose(held_.index().centre, np.mean(list(want.values()), 0), atol=1e-9)
    before = held_.log.version()["number"]
    assert held_.change(table(spark, [(1, [0.0, 0.0])]), writer=("vectors", 0)) == before  # a batch that is there changes nothing


def test_segmented_moments(spark):
    rng = np.random.default_rng(10)
    rows = [(("hot" if i % 3 else None) if i % 2 else f"g{i % 10}", (rng.standard_normal(5) + 1e9).tolist()) for i in range(600)] + [("g1", None), ("one", [1.0, 2.0])]
    got = {r["g"]: r for r in moments.pooled(table(spark, rows, "g string, v array<double>").repartition(6), ["g"], "v").collect()}
    assert set(got) == {g for g, v in rows if v}
    for g in got:
        x = np.array([v for k, v in rows if k == g and v])
        assert got[g]["n"] == len(x) and np.allclose(got[g]["mean"], x.mean(0), rtol=1e-15) and np.allclose(got[g]["std"], x.std(0), rtol=1e-6, atol=1e-12)
    assert moments.pooled(table(spark, [], "g string, v array<double>"), ["g"], "v").count() == 0
    with pytest.raises(Exception, match="components"):
        moments.pooled(table(spark, [("a", [1.0]), ("a", [1.0, 2.0])], "g string, v array<double>"), ["g"], "v").collect()
    two = moments.segmented(table(spark, [("a", 1, [1.0]), ("a", 2, [3.0]), ("a", 1, [5.0])], "a string, n int, v array<double>").withColumnRenamed("n", "b"), ["a", "b"], "v").collect()
    assert {(r["a"], r["b"]): (r["n"], r["mean"], r["m2"]) for r in two} == {("a", 1): (2, [3.0], [8.0]), ("a", 2): (1, [3.0], [0.0])}


def test_standardised(spark):
    got = moments.standardised(table(spark, [(1, [1.0, 3.0]), (2, None), (3, []), (4, [2.0])]), "v").orderBy("id").collect()
    assert np.allclose(got[0]["v"], [-1, 1], atol=1e-5) and got[1]["v"] is None and got[2]["v"] == [] and got[3]["v"] == [0.0]


def test_rejects_are_counted_and_set_aside(spark, tmp_path):
    rows = table(spark, [(1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, [1.0]), (4, None), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 2.0]), (7, [0.0, 0.0])])
    got = rejects.sift(rows, str(tmp_path / "rows"), 2)
    assert got.counts == {"rows": 8, "null": 1, "dimension": 1, "not finite": 3, "no id": 1, "accepted": 2, "rejected": 6}
    assert sorted(r["id"] for r in got.accepted.collect()) == [1, 7] and got.accepted.columns == ["id", "v"]
    assert sorted((r["id"] or 0, r["reason"]) for r in got.rejected.collect()) == [(0, "no id"), (2, "not finite"), (3, "dimension"), (4, "null"), (5, "not finite"), (6, "not finite")]
    seen = Observation()
    i = VectorIndex.of(rows.where("id IS NOT NULL"), 2, seen=seen)
    assert i.rows.count() == 2 and rejects.counts(seen)["rejected"] == 5
    with pytest.raises(ValueError):
        rejects.sift(rows.withColumn("fits", F.lit(1)), str(tmp_path / "x"), 2)


def test_names_of_users_do_not_clash(spark):
    c = Catalog.of(spark.createDataFrame([("a", "/a"), ("b", "/b")], "id string, path string"))
    asked = spark.createDataFrame([("a", 1, 2), ("z", 3, 4)], "id string, _id int, known int")
    assert {(r["id"], r["_id"], r["known"]) for r in c.contains(asked).collect()} == {("a", 1, True), ("z", 3, False)}
    side = spark.createDataFrame([("/a", "x", "y", "w")], "_by string, _key string, _side string, q string")
    assert {r["id"]: r["extra"].get("_side") for r in c.enrich(side, F.col("path"), "_by", ["_side", "q"]).rows.collect()} == {"a": "y", "b": None}
