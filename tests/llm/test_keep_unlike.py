"""Near copies among rows that share ids: unlike texts stay, whatever their ids."""

import collections
import random

from tessella.llm import shingle_join

from test_operators import shingles


def kept_by_hand(rows):
    """How many rows stay of each (id, text) component, and its smallest id."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for a in live:
        for b in live:
            if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for i in live:
        groups[root(i)].append(rows[i])
    return [sorted(g) for g in groups.values()], [r for i, r in enumerate(rows) if i not in set(live)]


def test_unlike_texts_of_one_id_stay(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(rng.randint(20, 50))] for _ in range(8)]
    rows = [(None, "a b c d e"), (None, None), (3, None), (3, ""), (3, "a b"), (4, "A B"), (5, "a b c")]
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 99)}"
        rows.append((i % 20, " ".join(w)))
    rows += [rows[10]] * 3 + [(7, "x " * 3000), (2, "x " * 3001)]
    names = "doc_id long, text string, _first long, _twice string, node string, id string, component_id long"
    df = spark.createDataFrame([(*r, 1, "q", "n", "i", 9) for r in rows], names).repartition(4)
    got = [(r["doc_id"], r["text"]) for r in shingle_join.keep_unlike(df).collect()]
    groups, rest = kept_by_hand(rows)
    left = collections.Counter(got)
    for r in rest:
        left[r] -= 1
        assert left[r] >= 0
    for g in groups:
        own = [r for r in left.elements() if r in g]
        assert len(own) == 1 and own[0][0] == g[0][0]
    assert sum(left.values()) == len(groups)
    assert shingle_join.keep_unlike(df).columns == df.columns
    assert shingle_join.keep_unlike(df.where("false")).count() == 0


def test_is_keep_first_where_ids_are_unique(spark):
    rng = random.Random(5)
    w = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w[: 40 - rng.randint(0, 2)])) for i in range(9)] + [(None, "a"), (50, ""), (51, "k l m n o p")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["text"]) for r in shingle_join.keep_unlike(df).collect())
    assert got == sorted((r["doc_id"] is not None, r["doc_id"], r["text"]) for r in shingle_join.keep_first(df).collect())
    assert [d for _, d, _ in got] == [None, 0, 50, 51]
