"""Rows that may not enter an index: counted and set aside in the pass that takes the others.

Counts are metrics of the query that reads the rows (no job of their own); they are there once it has run.
`sift` writes rows of both kinds in one pass: what fits, and what does not with its reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import vectors as V

REASONS = ("null", "dimension", "not finite", "no id")


def reason(key: str, vector: str, dim: int) -> Column:
    """Why a row may not enter an index of this width, or null."""
    return F.when(F.col(key).isNull(), "no id").otherwise(V.problem(F.col(vector), dim))


def watched(df: DataFrame, why: Column, seen: Observation) -> DataFrame:
    """df, whose next run tells `seen` how many rows there were, and how many for each reason."""
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(why == r, F.lit(False))).alias(r) for r in REASONS])


def counts(seen: Observation) -> dict[str, int]:
    """rows, accepted, rejected and the number of each reason, after the query has run."""
    got = dict(seen.get)
    bad = sum(got[r] for r in REASONS)
    return got | {"accepted": got["rows"] - bad, "rejected": bad}


@dataclass
class Sifted:
    accepted: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def sift(df: DataFrame, path: str, dim: int, key: str = "id", vector: str = "v", out: str = "reason") -> Sifted:
    """Writes df below path in one pass, parted by whether its vectors fit, and reads both parts: rejected rows have
    their reason in column `out` (a name that df does not have). Later runs may add to the folder of rejected rows."""
    if out in df.columns or "fits" in df.columns:
        raise ValueError(f"a column is named {out} or fits already")
    why = reason(key, vector, dim)
    seen = Observation()
    watched(df.withColumn(out, why), F.col(out), seen).withColumn("fits", F.col(out).isNull()).write.partitionBy("fits").parquet(path)
    spark = df.sparkSession
    rows = spark.read.schema(df.withColumn(out, F.lit("")).withColumn("fits", F.lit(True)).schema).parquet(path)
    return Sifted(rows.where("fits").drop("fits", out), rows.where("NOT fits").drop("fits"), counts(seen))
