"""The corpus operators against brute force on small tables with nulls, empty and long
texts, ties, repeated rows, empty tables and clashing extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import best_fit, block_knn, elias_fano, ngram_trie, path_dedup, preference, prefix_bpe, shingle_join, telephony, toxicity, url_filters
from tessella.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(3)
    words = ["the", "of", "Ähre", "x1", "you", "scum", "A.", "naïve", "日本", "e\u0301"] + [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 5, 19, 20, 21, 40, 80, 300)]
    near = [base[9] + " tail", "\n".join(base[9].split(" ")), base[10] + " " + base[9], base[10][:900]]
    odd = ["", None, " \t\n", "\u00a0a\u3000 b", "<|endoftext|> hi <|x|>", "ab" * 600, base[3].upper(), base[5], base[8] + " " + base[8]]
    return base + near + odd + [" ".join(rng.choice(words) for _ in range(5000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 31, t, "src", 1.5, "q") for i, t in enumerate(texts())] + [(None, "the of the of x1", "src", 1.5, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, score double, word string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_knn(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist(), "z") for i in range(120)] + [(200, None, "z"), (201, [0.0] * 6, "z"), (202, [None] * 6, "z"), (203, [float("nan")] * 6, "z"), (None, [1.0] * 6, "z"), (204, [1.0, 2.0], "z")]
    rows += [(60, rows[0][1], "z"), (300, rows[1][1], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = collections.defaultdict(list)
    for r in block_knn.nearest(df, df.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fit = [(i, v) for i, v, _ in rows if i is not None and v and len(v) == 6 and None not in v and all(map(math.isfinite, v)) and any(v)]
    for q in (0, 20, 40, 80, 100, 300):
        v = dict(reversed(fit))[q]
        want = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in fit if i != q))[:5]
        assert [i for i, _ in got[q]] == [i for _, i in want] and np.allclose([s for _, s in got[q]], [-s for s, _ in want])
    assert block_knn.nearest(df.where("false"), df.where("false"), 5).count() == 0


def test_knn_tiles_are_exact(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    monkeypatch.setattr(block_knn, "TILE", 7)
    monkeypatch.setattr(block_knn, "BLOCK_QUERIES", 50)
    q, c, s = block_knn.block_best(np.arange(30), x[:30], np.arange(300), x, 4)
    full = x[:30] @ x.T
    full[np.arange(30), np.arange(30)] = -np.inf
    for i in range(30):
        assert set(c[q == i]) == set(np.argsort(-full[i])[:4])


def test_telephony(spark, docs, none):
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in telephony.text_features(docs).collect())
    want = collections.Counter()
    for i, t in rows_of(docs):
        raw = (t or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[i, len(raw), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == want and telephony.text_features(none).count() == 0
    media = telephony.text_media(docs.select("doc_id", "text"))
    pcm = telephony.to_pcm(media.withColumn("pcm", media["doc_id"])).collect()
    assert all(telephony.read_wav(r["pcm"])[0] == telephony.PCM for r in pcm)
    bad = spark.createDataFrame([(None,), (bytearray(b"RIFF"),), (bytearray(),)], "media binary")
    assert [r["pcm"] for r in telephony.to_pcm(bad).collect()] == [None] * 3


def test_g711_and_adpcm_tables():
    m, a = telephony.MULAW_TABLE, telephony.ALAW_TABLE
    assert m[0] == -32124 and m[128] == 32124 and m[255] == 0 and a[0x55] == -8 and a[0xD5] == 8 and a[0x2A] == -32256
    blocks = np.random.default_rng(2).integers(0, 256, (9, 64)).astype(np.uint8)
    out = telephony.ima_decode(blocks)
    for b, row in zip(blocks, out):
        x, i = int(np.frombuffer(b[:2].tobytes(), "<i2")[0]), min(int(b[2]), 88)
        want = [x]
        for code in (c for byte in b[4:] for c in (byte & 15, byte >> 4)):
            step = int(telephony.STEPS[i])
            d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            x = max(-32768, min(32767, x - d if code & 8 else x + d))
            i = max(0, min(88, i + int(telephony.CHANGES[code])))
            want.append(x)
        assert row.tolist() == want


def test_preference(spark):
    rows = [(0, "chosen", 0, "user", "hi"), (0, "chosen", 1, "assistant", "a"), (0, "rejected", 0, "user", "hi"), (0, "rejected", 1, "assistant", "b"), (0, "rejected", 2, "user", None), (1, "chosen", 0, "user", "x"), (2, "chosen", None, None, "s"), (2, "rejected", None, None, "s"), (None, "chosen", 0, "user", "x")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "pair_id long, side string, turn long, role string, text string, prompt string")
    got = {r["pair_id"]: r for r in preference.format_pairs(df).collect()}
    assert set(got) == {0, 2}
    assert got[0]["prompt"] == "<|user|>\nhi<|end|>\n" and got[0]["chosen"] == "<|assistant|>\na<|end|>\n" and got[0]["chosen_mask"] == "-14 +9"
    assert got[0]["rejected_mask"] == "-14 +9 -17" and got[2]["n_common"] == 1 and got[2]["chosen"] == got[2]["rejected_mask"] == ""


def test_url_filters(spark):
    urls = ["http://a.example.com/en/7x", "http://EXAMPLE.com/en/1?q", "https://x.net/de/8#f", "https://example.net/de/8", "ftp://badcom/en/1", "https://a.org/es/", "https://a.org/es", "nothing", None, "", "http://com/en/", "http://a.example.com/en/7?x://y.net/de/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(df).collect()}
    rules = [r for r in got.values()]
    assert [got[i][2] for i in range(12)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", None, "org/es/", None, None, None, None, "com/en/", "example.com/en/7"]
    assert got[0][3] == "allow" and got[1] == ("example.com", "/en/1", "com/en/", "block") and got[7] == ("", "", None, "allow") and len(rules) == 12
    assert url_filters.judge(df, rules=()).count() == 12 and url_filters.judge(df.where("false")).count() == 0


def test_toxicity(spark, docs, none):
    rng = random.Random(4)
    made = [(i, " ".join(rng.choice(["tree", "house", "walk", "green", "you"]) for _ in range(20)) + (" you stupid scum" if i % 4 == 0 else "")) for i in range(800)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judge(d, labels).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    model = toxicity.train(d, labels)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.judge(none, labels).count() == 0
    assert {r["score"] for r in toxicity.judge(docs, labels.where("false")).collect()} == {0.0}


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = toxicity.boost(x, y).margin(x)
    assert ((m > 0) == y).mean() > 0.95
    xs, ys = toxicity.isotonic(m, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


def test_elias_fano():
    rng = np.random.default_rng(7)
    for n, u in ((0, 1), (1, 5), (500, 300), (3000, 1 << 40), (4000, 4001)):
        v = np.sort(rng.integers(0, u, n)).astype(np.uint64)
        e = elias_fano.EliasFano({f"a.{k}": x for k, x in elias_fano.encode(v, u).items()}, "a")
        assert (e.get(np.arange(n)) == v).all()
        u_v = np.unique(v)
        e = elias_fano.EliasFano({f"a.{k}": x for k, x in elias_fano.encode(u_v, u).items()}, "a")
        ask = np.concatenate([u_v, rng.integers(0, u, 200).astype(np.uint64)])
        got = e.find(ask, np.zeros(len(ask), np.int64), np.full(len(ask), len(u_v)))
        place = {int(x): i for i, x in enumerate(u_v)}
        assert got.tolist() == [place.get(int(x), -1) for x in ask]


@pytest.mark.parametrize("least", [2, 1])
def test_ngram_trie(docs, none, least):
    D = [(i, WORD.findall((t or "").translate(LOWER)) + [None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows_of(docs)]
    c1, c2, c3 = (collections.Counter() for _ in range(3))
    for _, w, held in D:
        if not held:
            s = [None, *w]
            c1.update(w), c2.update(zip(s, s[1:])), c3.update(zip(s, s[1:], s[2:]))
    n, v = sum(c1.values()), len(c1)
    k2, k3 = ({k: c for k, c in x.items() if c >= least} for x in (c2, c3))
    s2, s3 = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for kept, s, m in ((k2, s2, 1), (k3, s3, 2)):
        for k, c in kept.items():
            s[k[:m]][0] += 1
            s[k[:m]][1] += c
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)
    mix = lambda total, kept, s, low: max(kept - 0.5, 0) / total + (total - s[1] + 0.5 * s[0]) / total * low
    p2 = lambda a, w: mix(c1[a], k2.get((a, w), 0), s2[a,], p1(w)) if c1[a] else p1(w)
    p3 = lambda a, b, w: mix(k2[a, b], k3.get((a, b, w), 0), s3[a, b], p2(b, w)) if (a, b) in k2 else p2(b, w)
    assert abs(sum(p3(None, "the", w) for w in c1) + p3(None, "the", "unseen") - 1) < 1e-9
    want = sorted((len(w), sum(c1[x] > 0 for x in w), sum(math.log10(p1(x)) for x in w), math.log10(p2(None, w[0])) + sum(math.log10(p3(*t)) for t in zip([None, *w], w, w[1:]))) for _, w, _ in D)
    got = sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in (ngram_trie.judge(docs) if least == 1 else ngram_trie.judge(docs, least=least)).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 and abs(a[3] - b[3]) < 4e-4 * a[0]
    assert ngram_trie.judge(none).count() == 0


def test_best_fit(docs, none):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = best_fit.pack(docs, path).collect()
    pieces = collections.Counter()
    for i, x in rows_of(docs):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            pieces[i, p // 2048, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
    assert best_fit.pack(none, path).count() == 0


def test_prefix_bpe(docs, none):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, x in rows_of(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in prefix_bpe.digests(docs, path).collect()) == want
    assert prefix_bpe.digests(none, path).count() == 0 and prefix_bpe.encode(docs, path).count() == docs.count()


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_shingle_join(spark, none, monkeypatch):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 60))] for _ in range(12)]
    rows = [(None, "a b c d e"), (1000, None), (1001, ""), (1002, "a b"), (1003, "A B"), (1004, "a b c")]
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    rows += [(0, rows[6][1]), (0, rows[6][1]), (7, rows[20][1]), (500, rows[9][1])]  # ids again, an exact copy
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string").repartition(4)
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if i is not None and j is not None and s and 100 * len(s & u) >= 80 * len(s | u):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    want = collections.Counter((i, len(s), root(i)) for i, s in sets)
    assert collections.Counter(tuple(r) for r in shingle_join.alike(df).collect()) == want
    monkeypatch.setattr(shingle_join, "PAIRS", 2)  # from here on in several places
    assert collections.Counter(tuple(r) for r in shingle_join.alike(df).collect()) == want
    assert shingle_join.alike(none).count() == 0
    kept = shingle_join.keep_first(df)
    first = {root(i) for i, s in sets if i is not None and s}
    assert kept.columns == df.columns and kept.count() == len(first) + sum(i is None or not s for i, s in sets)
    assert {r["doc_id"] for r in kept.collect()} == first | {None, 1000, 1001}


def test_path_dedup(docs, none):
    rows = sorted((r for r in rows_of(docs) if r[0] is not None))
    seen, want = set(), {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in path_dedup.digests(docs).collect()}
    assert got.pop(None)[1] == 0 and got == want and any(x[1] for x in want.values())
    clean = path_dedup.clean(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count() and path_dedup.digests(none).count() == 0


def test_least_runs():
    g = np.random.default_rng(1).integers(0, 1 << 62, 200).astype(np.uint64)
    for width in (1, 2, 7, 15):
        assert path_dedup.least_runs(g, width).tolist() == [i + int(g[i : i + width].argmin()) for i in range(201 - width)]


def test_units_cover_texts():
    data, bounds = prefix_bpe.raw(pa.array(["a  b\n\nc. ", "", "x"]))
    cut = prefix_bpe.units(data, bounds)
    assert cut.offsets[-1] == len(data) and cut.offsets[cut.docs].tolist() == bounds.tolist()


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "shingle_join", "path_dedup", "best_fit"]


def test_elias_fano_runs():
    """Many values that share their high part, and parts without any."""
    for values, universe in ((np.arange(1000), 1000), (np.arange(700) + 5000, 1 << 30), (np.repeat(7, 400), 9), (np.concatenate([np.arange(300), np.arange(300) + 10**9]), 2 * 10**9)):
        v = values.astype(np.uint64)
        e = elias_fano.EliasFano({f"a.{k}": x for k, x in elias_fano.encode(v, universe).items()}, "a")
        assert (e.get(np.arange(len(v))) == v).all()
        distinct, first = np.unique(v, return_index=True)
        got = e.find(distinct, np.zeros(len(distinct), np.int64), np.full(len(distinct), len(v)))
        assert (got == first).all()


def brute_repeats(rows):
    seen, want = {}, {}
    for i, t in sorted(set(rows)):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if seen.setdefault(x, (i, k)) != (i, k):
                gone[k : k + 20] = [True] * 20
        want[i] = (len(w), sum(gone))
    return want


@pytest.mark.parametrize("parts", [1, 5])
def test_path_dedup_chains(spark, parts, monkeypatch):
    """Passages in every document, cut differently, nested, running on, and repeated rows."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(400)]
    rows = []
    for i in range(60):
        a = rng.randint(0, 300)
        own = [f"d{i}x{k}" for k in range(rng.randint(0, 30))]
        rows.append((i, " ".join(own + passage[a : a + rng.randint(20, 100)] + own[:7] + (passage if i % 7 == 0 else []))))
    rows += [(100, "na " * 90), (101, "na " * 50), (102, " ".join(["x y"] * 40))] + [(200, " ".join(passage))] * 3
    monkeypatch.setattr(path_dedup.Sent.__init__, "__defaults__", (2, 4))  # newer edges overwrite
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, _spans string, _spans_id long").repartition(parts)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in path_dedup.digests(df).collect()} == brute_repeats(rows)
    clean = path_dedup.clean(df)
    assert clean.columns == df.columns and clean.count() == len(rows) and {r["_spans"] for r in clean.collect()} == {"c"}


def test_least_runs_in_parts(monkeypatch):
    g = np.random.default_rng(3).integers(0, 1 << 62, 100).astype(np.uint64)
    monkeypatch.setattr(path_dedup, "PART", 9)
    assert path_dedup.least_runs(g, 15).tolist() == [i + int(g[i : i + 15].argmin()) for i in range(86)]


def test_knn_of_any_size(spark):
    """Components whose bounds are not finite, ties of very many, one id very often."""
    rows = [(0, [5e-324, 0.0]), (1, [1e200, 0.0]), (2, [3.0, 4.0]), (3, [1e-200, 1.0]), (4, [-2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in block_knn.nearest(df, df, 3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q, v in rows:
        want = sorted((-(v[0] * w[0] + v[1] * w[1]), i) for i, w in rows if i != q)[:3]
        assert got[q] == [i for _, i in want], q
    same = spark.createDataFrame([(i % 7, [1.0, 1.0]) for i in range(3000)], "vec_id long, embedding array<float>")
    out = block_knn.nearest(same, same.where("vec_id = 0"), 20).collect()
    assert len(out) == 20 and {r["vec_id"] for r in out} == {1}


def test_wavs_of_other_kinds():
    rng = np.random.default_rng(6)
    x = rng.integers(-9000, 9000, 400).astype("<i2")
    read = lambda m: np.frombuffer(telephony.read_wav(telephony.pcm(m))[1], "<i2")
    assert (read(telephony.wav(telephony.PCM, x.tobytes(), 16_000, 16, 2)) == x).all()
    two = telephony.wav(telephony.PCM, np.repeat(x, 2).tobytes(), 16_000, 16, 4)
    two = two[:22] + b"\x02\0" + two[24:]
    assert (read(two) == x).all()
    assert telephony.pcm(telephony.wav(telephony.PCM, x.tobytes(), 44_100, 16, 2)) is None
    assert telephony.pcm(telephony.wav(telephony.PCM, x.tobytes(), 8000, 24, 3)) is None and telephony.pcm(b"RIFF") is None
    blocks = rng.integers(0, 256, (3, 512)).astype(np.uint8)
    whole = telephony.ima_decode(blocks).ravel()
    assert (telephony.samples(telephony.wav(telephony.IMA, blocks.tobytes(), 8000, 4, 512)) == whole).all()
    short = telephony.samples(telephony.wav(telephony.IMA, blocks.tobytes()[: 512 + 100], 8000, 4, 512))
    assert len(short) == 1017 + 193 and (short == whole[: len(short)]).all()
    up = read(telephony.wav(telephony.PCM, x.tobytes(), 8000, 16, 2))
    at = lambda i: int(x[min(max(i, 0), len(x) - 1)])
    assert (up[::2] == x).all() and up[1::2].tolist() == [max(-32768, min(32767, (9 * (at(i) + at(i + 1)) - at(i - 1) - at(i + 2) + 8) >> 4)) for i in range(len(x))]


def test_telephony_media(spark):
    for r in telephony.text_features(spark.createDataFrame([(1, "héllo " * 30), (2, None)], "doc_id long, text string")).collect():
        raw = ("héllo " * 30 if r["doc_id"] == 1 else "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = telephony.wav(telephony.MULAW, payload)
        x = [int(telephony.MULAW_TABLE[b]) for b in payload]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        crc = zlib.crc32(telephony.read_wav(telephony.pcm(stored))[1])
        cross = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        ima = sum(abs(int(v)) for v in telephony.ima_decode(np.frombuffer(payload, np.uint8).reshape(-1, 64)).ravel()) // (len(payload) // 64 * 121)
        alaw = max(abs(int(telephony.ALAW_TABLE[b])) for b in payload)
        assert r["feature"] == f"mulaw peak={max(map(abs, x))} mean={sum(map(abs, x)) // len(x)} cross={cross} alaw peak={alaw} ima mean={ima} pcm16k crc={crc:08x}"


def test_preference_empty_and_long(spark):
    schema = "pair_id long, side string, turn long, role string, text string"
    assert preference.format_pairs(spark.createDataFrame([], schema)).count() == 0
    long = "x" * 3_000_000
    r = preference.format_pairs(spark.createDataFrame([(1, "chosen", 0, "user", long), (1, "rejected", 0, "user", long), (1, "rejected", 0, "user", long)], schema)).first()
    assert r["n_common"] == 1 and r["chosen"] == "" and len(r["rejected"]) > 3_000_000


def test_url_rules_in_number(spark):
    """Hundreds of rules against brute force, and urls in a column that the result replaces."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rules = tuple(url_filters.Rule(rng.choice(("block", "allow")), ".".join(rng.choices(words, k=rng.randint(1, 2))) + "/" + "/".join(rng.choices(words, k=rng.randint(0, 2)))) for _ in range(400)) + (url_filters.Rule("block", "a+b.c/x(1)"),)
    urls = [f"http://{'.'.join(rng.choices(words, k=3))}/{'/'.join(rng.choices(words, k=3))}?q" for _ in range(300)] + ["http://z.a+b.c/x(1)y", None, "x"]
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, host string, _best int, row int")
    got = {r["page_id"]: r for r in url_filters.judge(df, url="host", rules=rules).collect()}
    hits = 0
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        h, _, p = rest.split("?")[0].partition("/")
        p = "/" + p if rest else ""
        fit = [(len(r.text), r.verdict, r.text) for r in rules if (h == (rh := r.text.split("/", 1)[0]) or h.endswith("." + rh)) and p.startswith("/" + r.text.split("/", 1)[1])]
        best = max(fit, default=(0, "allow", None))
        hits += best[2] is not None
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"], got[i]["_best"]) == (h, p, best[2], best[1], 1)
    assert hits > 20


def test_long_pretokens():
    import time

    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "ab" * 5000, "é" * 3000]
    t, bpe = Tokenizer.from_file(path), prefix_bpe.model(path)[0]
    for x in texts:
        assert bpe.encode_long(x.encode()) == t.encode(x, add_special_tokens=False).ids
    start = time.time()
    bpe.encode_long(("".join(rng.choice("etaoinshr") for _ in range(200_000))).encode())
    assert time.time() - start < 10


def test_isotonic_is_the_least_squares_fit():
    """Against the max-min formula of the monotone fit."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        m, y = np.round(rng.standard_normal(12), 1), rng.integers(0, 2, 12).astype(float)
        xs, ys = toxicity.isotonic(m, y)
        px = np.concatenate([[m.min() - 1e-9], m, [m.max() + 1e-9]])
        py = np.concatenate([[0.0], y, [1.0]])
        u = np.unique(px)
        s, n = np.array([py[px == v].sum() for v in u]), np.array([(px == v).sum() for v in u])
        fit = [max(min(s[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(u))) for a in range(i + 1)) for i in range(len(u))]
        assert np.allclose(np.interp(u, xs, ys), fit)


def test_toxic_features_by_hand():
    lexicon_words = ["scum", "vile"]
    h = toxicity.hashes(toxicity.split(pa.array([" ".join(lexicon_words)])))
    order = np.argsort(h)
    lexicon = toxicity.Lexicon(h[order], np.array([4000, 2000])[order])
    texts = ["You SCUM! are vile", "sc0um 5cum x", "", "Quiet green trees?"]
    f = toxicity.features(pa.array(texts), lexicon)
    for text, row in zip(texts, f, strict=True):
        w = text.split()
        plain = ["".join(c for c in x.lower() if c.isalnum()) for x in w]
        fold = ["".join(toxicity.DISGUISE.get(c, c) for c in x.lower()) for x in w]
        n = max(1, len(w))
        hit = [p in lexicon_words for p in plain]
        odd = [any(c.isalpha() for c in x) and any(c in "0123456789@$*#%&_|" for c in x) for x in w]
        hidden = [o and not t and "".join(c for c in y if c.isalnum()) in lexicon_words for o, t, y in zip(odd, hit, fold, strict=True)]
        you = [p in toxicity.SECOND_PERSON for p in plain]
        chars = max(1, sum(map(len, w)))
        assert row[0] == sum(hit) / n and row[6] == sum(hidden) / n and row[7] == sum(you) / n
        assert row[8] == sum(c.isupper() for x in w for c in x) / chars and row[10] == text.count("!") / chars and row[13] == sum(odd) / n
        near = [(a or b) and any(you[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, (a, b) in enumerate(zip(hit, hidden, strict=True))]
        assert row[5] == sum(near) / n


def test_best_fit_opens_as_few_sequences_as_plain_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(30):
        top = rng.choice((10, 64, 300))
        lengths = [rng.randint(1, top) for _ in range(rng.randint(1, 400))]
        moves = best_fit.plan(collections.Counter(lengths), top)
        used = max(m[3] + -(-1 // 1) for m in moves.tolist())
        room = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in room if r >= n]
            if fit:
                room.remove(min(fit))
                room.append(min(fit) - n)
            else:
                room.append(top - n)
        count = collections.Counter(lengths)
        seen = set()
        for length, first, each, seq, _ in moves.tolist():
            last = min([m[1] for m in moves.tolist() if m[0] == length and m[1] > first], default=count[length])
            seen.update(range(seq, seq + -(-(last - first) // each)))
        assert len(seen) == len(room) and used <= len(room)


def test_shingle_join_splits_hot_buckets(spark, monkeypatch):
    """Hot tokens dealt under several keys, buckets split by a second shingle."""
    rng = random.Random(12)
    line = "a very common line of ten words that all carry".split()
    rows = []
    for i in range(60):
        w = line + [f"d{i // 3}w{k}" for k in range(rng.randint(1, 4))]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = dict((i, shingles(t)) for i, t in rows)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    for name in ("HOT", "SPLIT", "PAIRS"):
        monkeypatch.setattr(shingle_join, name, 2)
    assert {r["doc_id"]: r["component_id"] for r in shingle_join.alike(df).collect()} == {i: root(i) for i in sets}
