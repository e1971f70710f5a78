"""op6: n-grams that occur once count as well."""

import collections
import math
import random
import zlib

from tessella.llm import queries


def test_all_ngrams_are_kept(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randint(0, 30)))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c1, c2, c3 = (collections.Counter() for _ in range(3))
    D = [(i, [*t.split(), None]) for i, t in rows]
    for i, w in D:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            s = [None, *w]
            c1.update(w), c2.update(zip(s, s[1:])), c3.update(zip(s, s[1:], s[2:]))
    n, v = sum(c1.values()), len(c1)
    f2, f3 = collections.Counter(k[:1] for k in c2), collections.Counter(k[:2] for k in c3)
    t2, t3 = collections.Counter(), collections.Counter()
    for k, c in c2.items():
        t2[k[:1]] += c
    for k, c in c3.items():
        t3[k[:2]] += c
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)
    mix = lambda total, own, kinds, mass, low: (max(own - 0.5, 0) + (total - mass + 0.5 * kinds) * low) / total
    p2 = lambda a, w: mix(c1[a], c2[a, w], f2[a,], t2[a,], p1(w)) if c1[a] else p1(w)
    p3 = lambda a, b, w: mix(c2[a, b], c3[a, b, w], f3[a, b], t3[a, b], p2(b, w)) if c2[a, b] else p2(b, w)
    assert 1 in c2.values() and 1 in c3.values()
    want = {i: math.log10(p2(None, w[0])) + sum(math.log10(p3(*t)) for t in zip([None, *w], w, w[1:])) for i, w in D}
    got = {r["doc_id"]: r for r in queries.op6_ngram_trie(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and any(r["held_out"] for r in got.values())
    assert all(abs(got[i]["score"] - want[i]) < 4e-4 * got[i]["n_tokens"] for i in want)
