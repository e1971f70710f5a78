"""op10: repeated rows."""

import pytest

from tessella.llm import path_dedup


@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_rows_lose_nothing(spark, parts):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, a), (1, a), (2, b), (3, f"start {a}"), (3, f"start {a}"), (4, f"{b} {b}"), (4, f"{b} {b}"), (5, f"{b[:100]} x {b}")]
    df = spark.createDataFrame(rows * (1 if parts == 1 else 2), "doc_id long, text string").repartition(parts)
    got = {tuple(r)[:3] for r in path_dedup.digests(df).collect()}
    assert got == {(1, 60, 0), (2, 60, 0), (3, 61, 60), (4, 120, 120), (5, 89, 87)}
