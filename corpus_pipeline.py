"""Documents to training sequences: drop toxic texts, keep one of each group of
near copies, remove passages that occur earlier, pack what is left.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() writes every result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import best_fit, path_dedup, shared, shingle_join, toxicity
from tessella.llm.queries import read, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; labels of documents teach the score."""
    model, out = toxicity.train(docs, read(spark, sf_dir, "labels")), "_toxicity"
    while out in docs.columns:
        out += "_"
    return toxicity.score(docs, model, out=out).where(F.col(out) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies; unlike texts of one id stay."""
    return shingle_join.keep_unlike(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that also start earlier."""
    cut = path_dedup.clean(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return best_fit.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("shingle_join", drop_near_copies), ("path_dedup", drop_repeats), ("best_fit", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
