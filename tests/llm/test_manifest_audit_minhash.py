"""HyperMinHash near-dedup, Merkle manifest and divergence audit against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import divergence, hyper_minhash, merkle

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, h long, regs string, n long, grp string, rank int, term string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "q", 2, "g", 3, "t") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["the", "The", "of", "Ähre", "ähre", "x1y", "don't", "日本", "É", "a-b"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    out = []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 5, 30, 120))))
        out.append((i * 7, text, rng.choice(("en", "en", "en", "de", None, "")), rng.choice(("a", "a", "b", "c", "Z", None)), len(text)))
    base = out[5][1] + " " + " ".join(rng.choice(words) for _ in range(200))
    for i in range(12):  # a chain of near copies: neighbours are alike, the ends are not
        w = base.split(" ")
        w[: i * 9] = [f"new{j}" for j in range(i * 9)]
        out.append((2000 + i, " ".join(w), "en", "a", None))
    out += [(3000, base, "en", "b", 5), (3001, base.upper(), "xx", "only", 5), (3001, "unlike text of one id", "en", "a", 5), (3000, base, "en", "b", 5)]
    out += [(4000, None, "en", None, None), (4001, "", "en", "a", 0), (4002, " \t", "lone", "s", 2), (None, base, "en", "a", 5), (None, None, None, None, None), (4003, "one", "de", "a", (1 << 63) - 1), (4004, "ONE", "de", "c", 3)]
    out.append((5000, " ".join(rng.choice(words) for _ in range(30_000)), "en", "b", 9))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))


def linked(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    live = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    for a in live:
        for b in live:
            if a < b and (rows[a][0] == rows[b][0] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])):
                root[find(b)] = find(a)
    least = {}
    for i in live:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return collections.Counter((r[0], len(sets[i]), c := least[find(i)] if i in live else r[0], r[0] == c) for i, r in enumerate(rows))


def test_minhash(spark, rows):
    got = collections.Counter(tuple(r) for r in hyper_minhash.alike(table(spark, rows).repartition(3)).collect())
    assert got == linked(rows)


def test_minhash_of_large_families(spark):
    """Buckets above the bound: copies of one text with some words changed, alike to many or to few of the others."""
    rng = random.Random(12)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice((2, 6, 9))):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a", None))
    got = collections.Counter(tuple(r) for r in hyper_minhash.alike(table(spark, rows).repartition(3), split=20).collect())
    assert got == linked(rows)


def test_minhash_of_nothing(spark):
    assert hyper_minhash.alike(table(spark, [])).count() == 0
    assert [tuple(r) for r in hyper_minhash.alike(table(spark, [(1, None, None, None, None)])).collect()] == [(1, 0, 1, True)]


def test_registers_estimate_the_coefficient():
    rng = np.random.default_rng(4)
    for n in (1, 3, 20, 300, 5000, 100_000):
        for share in (0.0, 0.5, 0.8, 1.0):
            common = rng.integers(0, 1 << 64, round(n * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 64, (n - len(common) + 1) // 2, dtype=np.uint64)])) for _ in range(2))
            if not len(a) or not len(b):
                continue
            r = hyper_minhash.registers(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got = hyper_minhash.estimated(np.array([(r[0] == r[1]).mean()]), np.array([len(a)]), np.array([len(b)]))[0]
            assert abs(got - true) < 6 * max(0.02, (true * (1 - true) / hyper_minhash.REGISTERS) ** 0.5), (n, share)


def test_registers_hold_zeros_and_mantissa():
    top = hyper_minhash._REST - 1
    rest = np.array([0, (1 << top + 1) - 1, 1 << top, (1 << top) + (1 << top - 1), 1 << top - 3, 1], np.uint64)
    assert hyper_minhash.zeros_and_mantissa(rest).tolist() == [15 << 4, 15, 0, 8, 3 << 4, 15 << 4]


def test_lenders_are_the_first_in_order():
    rng = np.random.default_rng(6)
    for n in (1, 5, 32, 33, 200, 1000):
        filled = np.zeros(hyper_minhash.REGISTERS, bool)
        filled[rng.choice(hyper_minhash.REGISTERS, n, replace=False)] = True
        want = [next(int(b) for b in hyper_minhash._ORDER[i] if filled[b]) for i in np.flatnonzero(~filled)]
        assert hyper_minhash.lenders(filled).tolist() == want


def test_accidental_agreement():
    rng = np.random.default_rng(8)
    n = hyper_minhash.REGISTERS * 10
    same = 0
    for _ in range(40):
        both = rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64)
        r = hyper_minhash.registers(np.array([0, n, 2 * n]), np.concatenate([np.sort(both[:n]), np.sort(both[n:])]))
        same += int((r[0] == r[1]).sum())
    want = 40 * hyper_minhash.REGISTERS * hyper_minhash.accidental(np.array([n]), np.array([n]))[0]
    assert abs(same - want) < 5 * max(want, 1) ** 0.5


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Levels from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(levels, i):
    for nodes in levels[:-1]:
        yield (i % 2, nodes[i ^ 1] if i ^ 1 < len(nodes) else None)
        i //= 2


def manifest(rows):
    groups = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        groups[lang].append((i, leaf(i, source, lang, n, text), leaf(i, source, lang, None if n is None else n + 1, text)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    low = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        low[g] = tree([r[1] for r in groups[g]])
    high = tree([low[g][-1][0] for g in order])
    out = collections.Counter()
    for at, g in enumerate(order):
        for i, (key, own, changed) in enumerate(groups[g]):
            steps = [*way(low[g], i), *way(high, at)]
            acc = changed if key is not None and zlib.crc32(str(key).encode()) % 7 == 0 else own
            for right, sib in steps:
                acc = sha(acc) if sib is None else sha(sib, acc) if right else sha(acc, sib)
            root = high[-1][0]
            out[key, own, low[g][-1][0], root, sha(*(s for _, s in steps if s)), acc, acc == root] += 1
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 65, None])
def test_manifest(spark, rows, n):
    some = rows[:n] if n is not None else rows
    got = collections.Counter(tuple(r) for r in merkle.judged(table(spark, some).repartition(5)).collect())
    assert got == manifest(some)


def test_manifest_finds_tampering_alone(spark, rows):
    got = merkle.judged(table(spark, rows)).collect()
    tampered = {i for i, _, _, _, n in rows if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0}
    assert tampered and {r["doc_id"] for r in got if not r["verified"]} == tampered


def test_manifest_of_one_hot_group(spark):
    some = [(i % 3, "same", "en", "s", 4) for i in range(501)]
    got = collections.Counter(tuple(r) for r in merkle.judged(table(spark, some)).collect())
    assert got == manifest(some)


def audited(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source, _ in rows]
    out = collections.Counter()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= least}
        counts = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), collections.Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        of, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pair = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            term = [(q[t] - of[s][t], t.encode()) for t in kept if counts[s][t] and of[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                for rank, (f, item) in enumerate(found, 1):
                    out[lang, s, part, item.decode(), -f, rank] += 1
    return out


@pytest.mark.parametrize("least,top", [(30, 50), (1, 4), (10_000, 50)])
def test_divergence(spark, rows, least, top):
    got = collections.Counter(tuple(r) for r in divergence.audit(table(spark, rows).repartition(4), least=least, top=top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == audited(rows, least, top)


def test_divergence_of_nothing(spark):
    assert divergence.audit(table(spark, [])).count() == 0
    assert divergence.audit(table(spark, [(1, "12 3", "en", "a", 1)])).count() == 0


def test_shares_do_not_overflow(spark):
    df = spark.sql("SELECT 400000000000000L AS c, 900000000000000000L AS n, 1000000L AS v")
    assert df.select(divergence.share(df["c"], df["n"], df["v"])).first()[0] == 1 + 10**9 * (400000000000000 + 5) // (900000000000000000 + 5_000_000)
