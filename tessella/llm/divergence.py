"""Divergence of sources: how far the term frequencies of the sources of a language lie apart.

Terms are runs of letters A-Z (lower-cased) and characters outside ASCII. A language keeps the
terms in at least `least` of its documents; every source of it, and the language as a whole, gives
each kept term a smoothed share in parts of a billion, in whole numbers:
p = 1 + floor(10^9 (count + 5) / (N + 5 V)).

1. Tasks count terms by (lang, source) over batches of whole texts, so what is shuffled is a row a
   batch and term; each document counts once for how many documents a term is in.
2. One aggregation by (lang, term) gathers a term's counts by source (a cell a source at most) and
   drops rare terms. Each kept term is pivoted into an array indexed by the sources of its language.
3. JVM higher-order functions turn the array into shares and emit, source by source, the
   differences to the sources behind it; map-side aggregation sums them by pair of sources.
The terms a source uses most beyond its language are ranked by windows that keep the first `top`
of each task before they meet.

What is told of a language (its sources and their sums) is a row a language, joined to its terms
under `parts` keys, so a language with most terms is not one task; its size is that of the list
of its sources. Products are decimals of 38 digits, so nothing overflows or rounds.

Null text, lang and source are ''. Every row is a document, repeated ids too. Other columns are
not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .words import pieces, release, split

LEAST, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
BATCH = 4 << 20

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), d (documents) by batch of docs (lang, source, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", BATCH):
            words = split(b.column("text"), lower=True, space=~_LETTERS)
            terms = words.array().dictionary_encode()
            code, n = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
            if not n:
                continue
            sizes = np.diff(words.docs)
            in_lang, in_source = (b.column(x).dictionary_encode().indices.to_numpy().astype(np.int64) for x in ("lang", "source"))
            _, example, own = np.unique(in_lang * len(sizes) + in_source, return_index=True, return_inverse=True)
            once = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + code)
            cell, c = np.unique(np.repeat(own, sizes) * n + code, return_counts=True)
            _, d = np.unique(own[once // n] * n + once % n, return_counts=True)  # the same cells in the same order
            rows = pa.array(example[cell // n])
            yield pa.RecordBatch.from_arrays([b.column("lang").take(rows), b.column("source").take(rows), terms.dictionary.take(pa.array(cell % n)).cast(pa.binary()), pa.array(c), pa.array(d)], ["lang", "source", "term", "c", "d"])
        release()

    found = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term binary, c long, d long")
    return found.withColumn("term", F.col("term").cast("string"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count among total occurrences of the kept terms."""
    wide = lambda c: c.cast("decimal(25,0)")
    whole = F.call_function("div", wide(count + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + SMOOTH * terms))
    return F.lit(1).cast("long") + whole


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the distances of each source to the others of its language (part pair), and
    the `top` terms whose share there is above the language's (part term)."""
    with shared.temporary(docs.sparkSession) as keep:
        return keep(shared.table(_audit(docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]), least, top), "divergence"))


def _audit(docs: DataFrame, least: int, top: int) -> DataFrame:
    parts = shared.partitions(docs.sparkSession)
    cells = counted(docs).groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    terms = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "c")).alias("cells"), F.sum("c").alias("c"), F.sum("d").alias("d"))
    terms = shared.table(terms.where(F.col("d") >= least).drop("d"), "terms")
    sums = terms.select("lang", F.explode("cells").alias("cell")).groupBy("lang", F.col("cell.source").alias("source")).agg(F.sum("cell.c").alias("n"))
    groups = docs.select("lang", "source").distinct().withColumn("n", F.lit(0).cast("long")).unionByName(sums).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"))
    about = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("of"), F.sum("n").alias("all"))
    about = shared.table(about.join(kept, "lang", "left").select("lang", "of", "all", F.coalesce("v", F.lit(0)).cast("long").alias("v")), "languages")

    # each term as an array over the sources of its language
    salted = about.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    wide = terms.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).join(salted, ["lang", "salt"])
    by = F.map_from_entries("cells")
    counts = F.transform("of", lambda s: F.struct(s["source"].alias("source"), s["n"].alias("n"), F.coalesce(F.try_element_at(by, s["source"]), F.lit(0)).cast("long").alias("c")))
    wide = wide.select("lang", "term", "v", share(F.col("c"), F.col("all"), F.col("v")).alias("q"), counts.alias("cell"))
    wide = wide.select("lang", "term", "q", "cell", F.transform("cell", lambda s: share(s["c"], s["n"], F.col("v"))).alias("p"))
    wide = shared.table(wide.select("lang", "term", "q", F.transform("cell", lambda s: s["c"]).alias("c"), "p"), "wide")

    one = wide.select("lang", "p", F.posexplode("p").alias("i", "x"))
    apart = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda y: F.abs(F.col("x") - y))
    gaps = one.select("lang", "i", F.posexplode(apart).alias("k", "f")).groupBy("lang", "i", (F.col("i") + F.col("k") + 1).alias("j")).agg(F.sum("f").alias("f"))
    # every two sources of a language, also where no term is kept
    ends = about.select("lang", "of", F.posexplode("of").alias("i", "a")).select("lang", "i", F.col("a.source").alias("a"), F.posexplode(F.slice("of", F.col("i") + 2, F.size("of"))).alias("k", "b"))
    ends = ends.select("lang", "i", (F.col("i") + F.col("k") + 1).alias("j"), "a", F.col("b.source").alias("b"))
    met = ends.join(gaps, ["lang", "i", "j"], "left").select("lang", "a", "b", F.coalesce("f", F.lit(0)).cast("long").alias("value"))
    pair = met.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    pair = pair.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    above = wide.select("lang", "term", "q", F.posexplode(F.arrays_zip("c", "p")).alias("i", "s")).where("s.c > 0 AND s.p > q")
    names = about.select("lang", F.posexplode("of").alias("i", "a")).select("lang", "i", F.col("a.source").alias("source"))
    order = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item")
    term = above.select("lang", "i", F.col("term").alias("item"), (F.col("s.p") - F.col("q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    term = term.join(names, ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", rank).unionByName(term)
