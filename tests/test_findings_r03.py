"""Tests of the findings of round 3."""

import numpy as np

from tessella.llm import shingle_join
from tessella.operators import blocks, kernel


def test_block_search_for_more_queries_than_a_task_holds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    at = rng.normal(size=(400, 8))
    at[100:140] = at[7]  # copies tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(at)], "id long, v array<double>")
    ask = df.where("id % 2 = 0").selectExpr("id query_id", "v")
    packed = blocks.pack(df, 8, size=16, pivots=24).cache()
    centre = at.mean(0).tolist()
    few = {(r["query_id"], r["rank"]): (r["id"], r["raw_score"]) for r in blocks.top(packed, ask, 6, centre, 8, without=[3, 15]).rows.collect()}
    monkeypatch.setattr(kernel, "SENT", 8 * 8 * 50)
    monkeypatch.setattr(blocks, "TILE", 8 * 8 * 60)
    found = blocks.top(packed, ask, 6, centre, 8, without=[3, 15])
    many = {(r["query_id"], r["rank"]): (r["id"], r["raw_score"]) for r in found.rows.collect()}
    u = kernel.unit(at, centre)
    for q in range(0, 400, 2):
        own = sorted((-(u[q] * u[i]).sum(), i) for i in range(400) if i not in (q, 3, 15))[:6]
        assert [many[q, k][0] for k in range(1, 7)] == [i for _, i in own]
    assert many == few and 0 <= found.share() < 1
    assert blocks.top(packed, ask, 0, centre, 8).rows.count() == 0 and blocks.top(packed.where("false"), ask, 3, centre, 8).rows.count() == 0


def test_pairs_are_measured_once(spark, monkeypatch):
    """verified reads its pairs three times; a plan of their joins and parity maps in each of them fills the driver."""
    plans, verified = [], shingle_join.verified

    def watched(docs, pairs, *rest):
        plans.append(pairs._jdf.queryExecution().optimizedPlan().toString())
        return verified(docs, pairs, *rest)

    monkeypatch.setattr(shingle_join, "verified", watched)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: 58 - i % 3], f"x{i}"])) for i in range(12)] + [(99, "other words of one text alone")]
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict.fromkeys(range(12), 0), 99: 99}
    assert len(plans) == 2 and not any("MapInArrow" in p or "Join" in p for p in plans)
