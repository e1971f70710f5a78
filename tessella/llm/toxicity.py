"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labels are read from a bounded sample of labelled rows (SAMPLE, in the order of
a hash of their ids), in three parts that share no row: the first gives the
lexicon (words and word beginnings that toxic rows have far more often, at most
LEXICON terms), the second the trees, the third the calibration. So nothing is
judged on rows it was made from. Features are densities: lexicon terms, terms
near the second person, terms that show only once disguised letters are undone,
capitals, punctuation, obfuscated words. Scoring is one pass over whole texts.

Only the text counts. Null and empty texts have no words and are scored like any
other; equal texts score equally. A row without an id is scored and is not held
out. Ids with several labels take the majority, ties toxic. Without labels of
both kinds every score is the share of toxic ones (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import _LETTER, U64, Words, hashes, pieces, split, splitmix

SAMPLE, LEXICON, LEAST, FOLDS = 30_000, 4096, 5, 5
STARTS = (4, 5, 6, 7)  # bytes of a word's beginning that are terms of their own
NEAR = 5  # words between a term and the second person

# The second person in the corpus languages, and letters that stand for others.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen euch euer tu te toi ton ta tes vous votre vos usted ustedes vosotros tú ti tus os".split()
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

_PLAIN = _LETTER | (np.arange(256) >= 128)
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_MARK = ~_PLAIN & ~_DIGIT
_FOLD = np.arange(256, dtype=np.uint8)
for _a, _b in DISGUISE.items():
    _FOLD[ord(_a)] = ord(_b)
_ODD = np.isin(np.arange(256), np.frombuffer(b"0123456789@$*#%&_|", np.uint8))


def strip(words: Words, keep: np.ndarray) -> Words:
    """The words without the bytes that are not kept; some may become empty."""
    before = np.concatenate([[0], np.cumsum(keep)])
    return words._replace(data=words.data[keep], offsets=before[words.offsets])


def term_hashes(words: Words) -> np.ndarray:
    """One row a term kind: the whole word, then its beginnings; 0 where there is none."""
    sizes = np.diff(words.offsets)
    out = np.zeros((1 + len(STARTS), len(sizes)), U64)
    some = np.flatnonzero(sizes)
    if len(some):
        offsets = np.append(words.offsets[some], words.offsets[-1])
        out[0, some] = hashes(Words(words.data, offsets, words.docs))
        for k, n in enumerate(STARTS, 1):
            long = some[sizes[some] > n]
            if len(long):
                at = (words.offsets[long][:, None] + np.arange(n)).ravel()
                out[k, long] = splitmix(hashes(Words(words.data[at], np.arange(len(long) + 1) * n, words.docs)) + U64(k))
    return out


def per_doc(values: np.ndarray, docs: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[docs[1:]] - sums[docs[:-1]]


_YOU = np.unique(hashes(split(pa.array([" ".join(SECOND_PERSON)]))))


class Lexicon(NamedTuple):
    terms: np.ndarray
    weights: np.ndarray  # thousandths of the log odds

    def weigh(self, found: np.ndarray) -> np.ndarray:
        """The largest weight among each word's terms, 0 without any."""
        best = np.zeros(found.shape[1], np.int64)
        if not len(self.terms):
            return best
        door = np.zeros(1 << 16, bool)
        door[self.terms & U64(0xFFFF)] = True
        for row in found:
            i = np.flatnonzero(door[row & U64(0xFFFF)])
            at = np.minimum(np.searchsorted(self.terms, row[i]), len(self.terms) - 1)
            hit = self.terms[at] == row[i]
            best[i[hit]] = np.maximum(best[i[hit]], self.weights[at[hit]])
        return best


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    whole, low = split(texts), split(texts, lower=True)
    docs, n = low.docs, np.diff(low.docs)
    sizes = np.diff(whole.offsets)
    plain = strip(low, ~_MARK[low.data])
    found = term_hashes(plain)
    weight = lexicon.weigh(found)
    hit = weight > 0
    # a disguised word has a letter and a stand-in for one
    of_word = lambda mask: (lambda s: s[whole.offsets[1:]] - s[whole.offsets[:-1]])(np.concatenate([[0], np.cumsum(mask[whole.data])]))
    letters, odd = of_word(_PLAIN), of_word(_ODD)
    disguised = (letters > 0) & (odd > 0)
    masked = np.zeros(len(sizes), np.int64)
    if disguised.any():
        chosen = np.flatnonzero(disguised)
        at = np.repeat(disguised, sizes)
        folded = Words(_FOLD[low.data[at]], np.concatenate([[0], np.cumsum(sizes[chosen])]), docs)
        masked[chosen] = lexicon.weigh(term_hashes(strip(folded, ~_MARK[folded.data])))
    hidden = (masked > 0) & ~hit
    you = np.isin(found[0], _YOU)
    before = np.concatenate([[0], np.cumsum(you)])
    doc = np.repeat(np.arange(len(n)), n)
    i = np.flatnonzero(hit | hidden)
    near = np.zeros(len(sizes), bool)
    near[i] = before[np.minimum(i + NEAR + 1, docs[1:][doc[i]])] > before[np.maximum(i - NEAR, docs[:-1][doc[i]])]
    capital = of_word((np.arange(256) >= 65) & (np.arange(256) <= 90))
    top = np.zeros(len(n), np.int64)
    top[n > 0] = np.maximum.reduceat(np.maximum(weight, masked), docs[:-1][n > 0]) if (n > 0).any() else 0
    count = lambda x: per_doc(x, docs)
    of = lambda x: count(x) / np.maximum(n, 1)
    chars = np.maximum(count(sizes), 1)
    return np.stack([
        of(hit), of(weight), top, np.minimum(count(hit), 1000), of(weight > 3000), of(near), of(hidden), of(you),
        count(capital) / chars, of((capital == letters) & (letters > 1)), count(of_word(np.arange(256) == 33)) / chars,
        count(of_word(np.arange(256) == 63)) / chars, count(of_word(_MARK)) / chars, of(disguised), count(of_word(_DIGIT)) / chars,
        np.minimum(n, 10_000), count(sizes) / np.maximum(n, 1), count(of_word(np.arange(256) >= 128)) / chars,
    ], axis=1).astype(np.float64)


class Trees(NamedTuple):
    """Complete trees of one depth: the nodes of each level after those of the level before."""

    base: float
    feature: np.ndarray  # (trees, 2 ** depth - 1)
    bound: np.ndarray
    leaf: np.ndarray  # (trees, 2 ** depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, b, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(f):
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            out += leaf[node - len(f)] if len(node) else 0
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0, decay: float = 1.0) -> Trees:
    """Second-order boosting of the log loss on feature histograms."""
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    margin, inner = np.full(len(y), base), 2**depth - 1
    all_f, all_b, all_l = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, feature, bound = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first = 2**level - 1
            local, best = node - first, {}
            for f, c in enumerate(cuts):
                at = local * (bins + 1) + binned[:, f]
                gs, hs = (np.bincount(at, w, 2**level * (bins + 1)).reshape(2**level, -1).cumsum(1) for w in (g, h))
                gl, hl = gs[:, : len(c)], hs[:, : len(c)]
                gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + decay) + gr**2 / (hr + decay) - gs[:, -1:] ** 2 / (hs[:, -1:] + decay), 0)
                for k in range(2**level if len(c) else 0):
                    j = int(gain[k].argmax())
                    if gain[k, j] > best.get(k, (1e-6,))[0]:
                        best[k] = (gain[k, j], f, c[j])
            for k, (_, f, b) in best.items():
                feature[first + k], bound[first + k] = f, b
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > bound[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + decay)
        margin += leaf[at]
        all_f.append(feature), all_b.append(bound), all_l.append(leaf)
    return Trees(base, np.array(all_f), np.array(all_b), np.array(all_l))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the nondecreasing least-squares fit of y over margin, by pooling adjacent
    violators; one row of each kind is added at the ends, so that no score is certain."""
    order = np.argsort(margin, kind="stable")
    m = np.concatenate([[margin.min() - 1e-9], margin[order], [margin.max() + 1e-9]])
    blocks: list[list[float]] = []  # sum, count, first, last
    for a, b in zip(m, np.concatenate([[0.0], y[order], [1.0]]), strict=True):
        if blocks and blocks[-1][3] == a:
            blocks[-1][0] += b
            blocks[-1][1] += 1
        else:
            blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, z = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = z
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return xs, ys


class Model(NamedTuple):
    lexicon: Lexicon
    trees: Trees | None
    curve: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        margin = self.trees.margin(features(texts, self.lexicon))
        score = 1 / (1 + np.exp(-margin))
        return np.clip(np.interp(margin, *self.curve), 0, 1) if self.curve else score


def fold(key: Column) -> Column:
    """crc32 of the id as text mod FOLDS: 0 is held out of all learning."""
    return F.crc32(key.cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    k = F.col(key)
    known = labels.where(k.isNotNull() & F.col(label).isNotNull() & (fold(k) != 0)).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64(key), key).limit(sample).withColumn("_fold", fold(k))
    # at most `sample` rows: of an id that documents repeat, the text of least hash
    chosen = docs.select(k.alias("_key"), F.col(text).alias("_text")).join(F.broadcast(known.withColumnRenamed(key, "_key")), "_key")
    chosen = chosen.groupBy("_key", "_y", "_fold").agg(F.min(F.struct(F.xxhash64("_text"), "_text")).alias("_one")).select("_y", "_fold", F.col("_one._text").alias("_text"))
    count = {(r["_fold"], r["_y"]): r["count"] for r in known.groupBy("_fold", "_y").count().collect()}
    total = [sum(n for (_, y), n in count.items() if y == v) for v in (0, 1)]
    share = total[1] / max(1, sum(total))
    n0, n1 = (sum(count.get((f, v), 0) for f in (1, 2)) for v in (0, 1))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            words = split(b.column("_text"), lower=True)
            found = term_hashes(strip(words, ~_MARK[words.data]))
            doc = np.repeat(np.arange(b.num_rows), np.diff(words.docs))
            y = b.column("_y").to_numpy()
            each = np.unique(np.stack([found.ravel(), np.tile(doc, len(found)).astype(U64)], 1), axis=0) if found.size else np.zeros((0, 2), U64)
            each = each[each[:, 0] != 0]
            term, back = np.unique(each[:, 0], return_inverse=True)
            toxic = y[each[:, 1].astype(int)]
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.bincount(back, toxic, len(term)).astype(np.int64)), pa.array(np.bincount(back, 1 - toxic, len(term)).astype(np.int64))], ["term", "n1", "n0"])

    odds = F.log((F.col("n1") + 0.5) / (n1 + 1) / ((F.col("n0") + 0.5) / (n0 + 1)))
    found = chosen.where(F.col("_fold").isin(1, 2)).select("_text", "_y").mapInArrow(terms, "term long, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    found = found.where(F.col("n1") >= LEAST).withColumn("odds", odds).where(F.col("odds") > 1.5).orderBy(F.desc(F.col("odds") * F.col("n1")), "term").limit(LEXICON)
    rows = sorted((np.int64(r["term"]).view(U64), round(1000 * r["odds"])) for r in found.collect())
    lexicon = Lexicon(np.array([r[0] for r in rows], U64), np.array([r[1] for r in rows], np.int64))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            x = features(b.column("_text"), lexicon)
            yield pa.RecordBatch.from_arrays([b.column("_y"), b.column("_fold"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["y", "fold", "x"])

    got = chosen.where(F.col("_fold").isin(3, 4)).select("_text", "_y", "_fold").mapInArrow(measured, "y int, fold long, x array<double>").toArrow()
    y, part = got.column("y").to_numpy(), got.column("fold").to_numpy()
    a, b = part == 3, part == 4
    if len(set(y[a].tolist())) < 2:
        return Model(lexicon, None, None, share)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort([y, *x.T])  # so that sums do not hang on the order of rows
    x, y, a, b = x[order], y[order], a[order], b[order]
    trees = boost(x[a], y[a].astype(float))
    curve = isotonic(trees.margin(x[b]), y[b].astype(float)) if len(set(y[b].tolist())) == 2 else None
    return Model(lexicon, trees, curve, share)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, the toxicity of each whole text; an `out` of docs is replaced."""
    keep = [c for c in docs.columns if c != out]
    shared_model = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON terms and the trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(shared_model.value.score(b.column(text)))], [*keep, out])

    return docs.select(*keep).mapInArrow(run, docs.select(*keep).withColumn(out, F.lit(0.0)).schema)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """key, held_out, score, predicted of every row."""
    scored = score(docs.select(key, text), train(docs, labels, key, text, label), text)
    return scored.select(key, F.coalesce(fold(F.col(key)) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
