"""op9: pairs inside one group of the index."""

from tessella.llm import shingle_join


def test_members_of_one_group_meet(spark):
    common = "c0 c1 c2 c3 c4 c5 c6 c7 c8"
    starts = ("u v", "a b", "x b")
    rows = [(i, f"{s} {common} r1 r2") for i, s in enumerate(starts)]  # 1 and 2 link, 0 with neither
    rows += [(100 * k + i, f"{s} {common}") for i, s in enumerate(starts, 1) for k in range(1, 6)]  # only shingles with r1 are rare
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(3)] == [0, 1, 1]
    assert all(got[100 * k + i] == 100 + i for i in (1, 2, 3) for k in range(1, 6))
