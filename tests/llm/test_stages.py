"""The stages of the pipeline on odd tables, wide vectors, and what training may read."""

import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from tessella.llm import block_knn, path_dedup, shingle_join, sketches, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _toxicity int, _spans string, _first long, id string, start int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "x", 1, "k", 2) for i, t in rows], SCHEMA).repartition(3)


def words(rng, n, tag):
    return [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


def test_unlike_texts_of_one_id_keep_what_occurs_once(spark):
    rng = random.Random(2)
    a, b, c, d = (words(rng, n, t) for n, t in ((60, "a"), (70, "b"), (40, "c"), (50, "d")))
    passage = words(rng, 30, "p")
    rows = [(1, a + c), (2, a + passage), (2, b), (2, passage + d), (3, [*b[:35], *c]), (3, [*d, "e"]), (4, None), (None, a), (4, [])]
    docs = table(spark, [(i, t if t is None else " ".join(t)) for i, t in rows])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert name and len(docs.columns) == 10
    kept = collections.Counter(w for r in docs.collect() if r["doc_id"] is not None for w in WORD.findall(r["text"] or ""))
    every = {w for i, t in rows if i is not None for w in t or []}
    assert set(kept) == every  # no word is lost altogether
    once = [w for w, n in collections.Counter(w for i, t in rows if i is not None for w in t or []).items() if n == 1]
    assert all(kept[w] == 1 for w in once)


def removed_by_hand(rows):
    """Words that stay of each (id, text): documents in the order of id and of the hash that the operator orders by."""
    seen, out = set(), {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        out[i, t] = [x for x, g in zip(w, gone) if not g]
    return out


def test_spans_belong_to_rows(spark):
    rng = random.Random(7)
    part = [words(rng, 25, f"q{i}") for i in range(6)]
    rows = [(rng.randrange(5), " ".join(w for _ in range(rng.randrange(1, 5)) for w in rng.choice(part))) for _ in range(24)]
    df = table(spark, rows)
    order = df.selectExpr("doc_id", "text", "xxhash64(text) AS h").distinct().orderBy("doc_id", "h").collect()
    want = removed_by_hand([(r["doc_id"], r["text"]) for r in order])
    got = collections.Counter((r["doc_id"], r["text"]) for r in path_dedup.clean(df).collect())
    assert got == collections.Counter((i, " ".join(want[i, t])) for i, t in rows)
    digests = path_dedup.digests(df).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in digests) == sorted((i, len(WORD.findall(t)) - len(want[i, t])) for i, t in rows)


@pytest.mark.parametrize("at", range(4))
def test_stages_on_odd_tables(spark, at):
    _, stage = corpus_pipeline.STAGES[at]
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (None, None), (None, "x y"), (3, ""), (4, " \t\n"), (5, "w " * 30_000), (6, "é" * 70_000)]
    out = stage(spark, table(spark, rows), DIR)
    found = out.collect()
    if at < 3:
        assert out.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
        assert {r["_toxicity"] for r in found} == {7} and {r["_spans"] for r in found} == {"x"}
        assert {r["doc_id"] for r in found} == {1, 2, None, 3, 4, 5, 6}
        assert len(found) == (8 if at == 1 else 9)
    else:
        assert {r["doc_id"] for r in found} == {1, 2, None, 3, 4, 5, 6} and len(out.columns) >= 7
    assert stage(spark, table(spark, []), DIR).count() == 0


def test_nearest_of_wide_vectors(spark):
    rng = np.random.default_rng(3)
    assert block_knn.EXACT * 127**2 <= 1 << 24
    for seed in range(12):
        rng = np.random.default_rng(seed)
        x = np.sign(rng.standard_normal((60, 4096))) * (1 + rng.random((60, 4096)) * 1e-3)  # all codes are near 127
        q, c, s = block_knn.block_best(np.arange(12), x[:12], np.arange(60), x, 3)
        full = x[:12] @ x.T
        full[np.arange(12), np.arange(12)] = -np.inf
        for i in range(12):
            assert set(c[q == i]) == set(np.argsort(-full[i])[:3])
    a, b = (rng.integers(-127, 128, (5, 5000)).astype(np.float32) for _ in range(2))
    assert (block_knn.code_products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_training_reads_no_more_than_its_sample(spark, monkeypatch):
    rows = [(i, f"text {i} of a kind") for i in range(300)]
    docs = table(spark, rows + [(i, f"another {j} of {i}") for i in range(300) for j in range(4)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    seen = []
    boost = toxicity.boost
    monkeypatch.setattr(toxicity, "boost", lambda x, y, *a, **b: seen.append(len(y)) or boost(x, y, *a, **b))
    model = toxicity.train(docs, labels, sample=80)
    assert seen and seen[0] <= 80
    again = toxicity.train(docs.repartition(7), labels, sample=80)
    assert np.array_equal(model.lexicon[0], again.lexicon[0]) and np.array_equal(model.trees[1], again.trees[1])


def test_tokens_are_split_by_their_own_rows(spark):
    single = spark.range(1000).selectExpr("id AS tok", "id AS gid", "4000 AS parts")
    many = spark.range(1000).selectExpr("-1L AS tok", "id AS gid", "4000 AS parts")
    rows = shingle_join.real_parts(single.unionByName(many))
    assert {(r["tok"] < 0, r["parts"], r["count"]) for r in rows.groupBy("tok", "parts").count().collect()} == {(True, 4, 1000), (False, 1, 1)}
    got = shingle_join.by_token(rows, {"m": F.count("*"), "least": F.min("gid")})
    assert got.count() == 2000 and got.where("tok < 0 AND (m <> 1000 OR least <> 0) OR tok >= 0 AND m <> 1").isEmpty()


def test_full_cells_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice((4, 9, 30))))) for i in range(120)]
    rows += [(200 + i, rows[3][1] + f" {i}") for i in range(30)]
    df = table(spark, rows)
    want = sorted(map(tuple, shingle_join.alike(df).collect()))
    monkeypatch.setattr(shingle_join, "HOT", 2)
    monkeypatch.setattr(sketches, "count_of", lambda codes: np.where(np.asarray(codes) >= 0, 1e6, 0))
    assert sorted(map(tuple, shingle_join.alike(df).collect())) == want
