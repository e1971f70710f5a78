"""BPE by dynamic programming over prefixes.

For every prefix of a pretoken exactly one token can be the last of its BPE
encoding. The tokens that end there are the suffix chain of an automaton over
the vocabulary, longest first; the first of them that may follow the last token
of the remaining prefix is the one. Whether two tokens may stand side by side
depends on these two alone: undo their merges, latest first, and see that no
earlier merge would have joined across the border. Back-pointers from the whole
pretoken give the exact ids, in time linear in its length.

Pretokens of a batch are worked off together, place by place. Text is cut into
units (a run without ASCII white space with one space before it, or white space
of its own) that never share a pretoken; a worker keeps the ids of units it has
seen. Texts with special tokens or other white space are cut as a whole.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .piece_cache import PieceCache, ragged
from .words import _SPACE, Words, hashes, pieces, raw, stops

# The white space and the pattern of byte-level BPE.
WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
ODD_WHITE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LONG = 48  # longer pretokens are worked off one by one


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        text = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        size = 1 + max([*text, *self.special.values()])
        self.bytes = [text.get(i, b"") for i in range(size)]
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        # the order in which tokens are made: single bytes, then by merge
        self.made = np.zeros(size, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys, joined = [], []
        for n, (a, b) in enumerate(merges, 1):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if not self.made[k]:
                self.made[k], self.left[k], self.right[k] = n, i, j
            keys.append(i * size + j)
            joined.append(n)
        order = np.argsort(keys)
        self.n, self.pair_keys, self.pair_made = size, np.array(keys)[order], np.array(joined)[order]
        self._automaton(text)
        self.seen: dict[int, bool] = {}
        # the same as plain lists, for pretokens that are worked off one by one
        self.pairs = dict(zip(keys, joined, strict=True))
        self.lists = {k: getattr(self, k).tolist() for k in ("back", "out", "shorter", "sizes", "made", "left", "right")}

    def _automaton(self, text: dict[int, bytes]) -> None:
        """Transitions of the vocabulary's trie, each state's longest proper suffix state
        and longest token at its end; each token's next shorter one."""
        nodes: list[dict[int, int]] = [{}]
        token = [-1]
        for i, t in text.items():
            s = 0
            for b in t:
                if b not in nodes[s]:
                    nodes[s][b] = len(nodes)
                    nodes.append({})
                    token.append(-1)
                s = nodes[s][b]
            token[s] = i
        back, out, shorter = [0] * len(nodes), [-1] * len(nodes), np.full(self.n, -1, np.int64)
        todo = deque(nodes[0].values())
        for s in todo:
            out[s] = token[s]
        while todo:
            s = todo.popleft()
            for b, t in nodes[s].items():
                f = back[s]
                while f and b not in nodes[f]:
                    f = back[f]
                back[t] = nodes[f].get(b, 0)
                out[t] = token[t] if token[t] >= 0 else out[back[t]]
                todo.append(t)
        for s, i in enumerate(token):
            if i >= 0 and back[s]:
                shorter[i] = out[back[s]]
        self.nodes = nodes
        edges = sorted((s * 256 + b, t) for s, n in enumerate(nodes) for b, t in n.items())
        self.edge_keys, self.edge_to = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.back, self.out, self.shorter = np.array(back), np.array(out), shorter

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        state, todo = state.copy(), np.arange(len(state))
        while len(todo):
            key = state[todo] * 256 + byte[todo]
            i = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[i] == key
            dead = ~hit & (state[todo] == 0)
            state[todo[hit]] = self.edge_to[i[hit]]
            todo = todo[~hit & ~dead]
            state[todo] = self.back[state[todo]]
        return state

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the tokens a and b side by side."""
        keys, where = np.unique(a * self.n + b, return_inverse=True)
        a, b = keys // self.n, keys % self.n
        good, limit, live = np.ones(len(keys), bool), np.full(len(keys), 1 << 40), np.arange(len(keys))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n + y
            i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[i] == key) & (self.pair_made[i] < limit[live])
            good[live[clash]] = False
            mx, my = self.made[x], self.made[y]
            live, x, y, mx, my = (v[~clash & ((mx > 0) | (my > 0))] for v in (live, x, y, mx, my))
            # undo the later merge: one on the left at the same place in the text comes first
            undo = mx > my
            a[live[undo]], b[live[~undo]] = self.right[x[undo]], self.left[y[~undo]]
            limit[live] = np.where(undo, mx, my + 1)
        return good[where]

    def fits_one(self, a: int, b: int) -> bool:
        """As fits, of one pair."""
        made, left, right, limit = self.lists["made"], self.lists["left"], self.lists["right"], 1 << 40
        while True:
            if self.pairs.get(a * self.n + b, limit) < limit:
                return False
            x, y = made[a], made[b]
            if not x and not y:
                return True
            if x > y:
                a, limit = right[a], x
            else:
                b, limit = left[b], y + 1

    def encode_long(self, text: bytes) -> list[int]:
        """One pretoken, of any length."""
        nodes, back, out, shorter, sizes = self.nodes, *(self.lists[k] for k in ("back", "out", "shorter", "sizes"))
        last, state, seen, n = [-1], 0, self.seen, self.n
        for p, b in enumerate(text, 1):
            while state and b not in nodes[state]:
                state = back[state]
            state = nodes[state].get(b, 0)
            t = out[state]
            while (size := sizes[t]) != p:
                key = last[p - size] * n + t
                good = seen.get(key)
                if good is None:
                    good = seen[key] = self.fits_one(last[p - size], t)
                if good:
                    break
                t = shorter[t]
            last.append(t)
        if len(seen) > 1_000_000:
            seen.clear()
        ids, p = [], len(text)
        while p:
            ids.append(last[p])
            p -= sizes[last[p]]
        return ids[::-1]

    def encode(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each pretoken has, and all ids in order."""
        sizes = np.array([len(x) for x in pretokens], np.int64)
        counts, found = np.zeros(len(sizes), np.int64), [None] * len(sizes)
        for i in np.flatnonzero(sizes > LONG):
            found[i] = self.encode_long(pretokens[i])
            counts[i] = len(found[i])
        short = np.flatnonzero((sizes <= LONG) & (sizes > 0))
        order = short[np.argsort(-sizes[short], kind="stable")]
        n, width = sizes[order], int(sizes[short].max(initial=0))
        text = np.zeros((width, len(order)), np.int64)
        flat = np.frombuffer(b"".join(pretokens[i] for i in order), np.uint8)
        text[ragged(np.zeros(len(n), np.int64), n), np.repeat(np.arange(len(n)), n)] = flat
        last = np.full((width + 1, len(order)), -1, np.int64)
        state = np.zeros(len(order), np.int64)
        for p in range(1, width + 1):
            live = int(np.searchsorted(-n, -p, "right"))
            state = self.step(state[:live], text[p - 1, :live])
            todo, t = np.arange(live), self.out[state]
            while len(todo):
                before = p - self.sizes[t]
                good = before == 0
                rest = np.flatnonzero(~good)
                good[rest] = self.fits(last[before[rest], todo[rest]], t[rest])
                last[p, todo[good]] = t[good]
                todo, t = todo[~good], self.shorter[t[~good]]
        # back-pointers
        at, live, steps = n.copy(), np.arange(len(order)), []
        while len(live):
            t = last[at[live], live]
            steps.append((live, t))
            counts[order[live]] += 1
            at[live] -= self.sizes[t]
            live = live[at[live] > 0]
        ends = np.cumsum(counts)
        ids, place = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32), ends - 1
        for live, t in steps:
            ids[place[order[live]]] = t
            place[order[live]] -= 1
        for i in np.flatnonzero(sizes > LONG):
            ids[ends[i] - counts[i] : ends[i]] = found[i]
        return counts, ids

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, of units that may hold several pretokens."""
        cut = _pattern().findall
        parts = [[x.encode() for x in cut(u.decode())] for u in units]
        count = np.array([len(x) for x in parts], np.int64)
        sizes, ids = self.encode([x for p in parts for x in p])
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(count)
        return sums[ends] - sums[ends - count], ids

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts cut as a whole, with the strings of special tokens as these."""
        marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        parts, count = [], []
        for text in texts:
            found = [y for x in (marks.split(text) if self.special else [text]) for y in ([x] if x in self.special else _pattern().findall(x))]
            parts += found
            count.append(len(found))
        sizes, ids = self.encode([b"" if x in self.special else x.encode() for x in parts])
        where = np.array([x in self.special for x in parts], bool)
        out = np.zeros(int((sizes + where).sum()), np.int32)
        own = np.repeat(~where, sizes + where)
        out[own] = ids
        out[~own] = [self.special[x] for x in parts if x in self.special]
        ends = np.concatenate([[0], np.cumsum(sizes + where)])[np.concatenate([[0], np.cumsum(count)]).astype(int)]
        return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


@lru_cache
def model(path: str) -> tuple[PrefixBPE, PieceCache, tuple, tuple]:
    bpe = PrefixBPE(path)
    flat = lambda x: (np.frombuffer(b"".join(x), np.uint8), np.concatenate([[0], np.cumsum([len(y) for y in x])]))
    return bpe, PieceCache(bpe.encode_units), flat(bpe.bytes), flat([b"%d," % i for i in range(bpe.n)])


def units(data: np.ndarray, bounds: np.ndarray) -> Words:
    """The texts cut into units that never share a pretoken."""
    white = _SPACE[data]
    start = np.zeros(len(data) + 1, bool)
    at = bounds[:-1][np.diff(bounds) > 0]
    first = np.zeros(len(data), bool)
    first[at] = True
    start[1:-1] = white[1:] & ~white[:-1]
    begin = ~white
    begin[1:] &= white[:-1]
    begin &= ~first
    r = np.flatnonzero(begin)
    start[r - 1] = True  # the last white character before a run: its space, or on its own
    start[r] = data[r - 1] != 0x20
    start[at] = start[stops(data)] = True
    start[-1] = True
    offsets = np.flatnonzero(start)
    return Words(data, offsets, np.searchsorted(offsets, bounds))


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each text's ids, and all ids. Null texts have none."""
    import pyarrow.compute as pc

    bpe, cache, _, _ = model(path)
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, f"[{ODD_WHITE}]" + "".join("|" + regex.escape(x) for x in bpe.special)).to_numpy(zero_copy_only=False)
    data, bounds = raw(pc.if_else(pa.array(odd), "", texts))
    cut = units(data, bounds)
    n, ids = cache.ids(hashes(cut), data, cut.offsets) if len(cut.offsets) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    ends = np.concatenate([[0], np.cumsum(n)])[cut.docs]
    if not odd.any():
        return ends, ids
    whole = iter(bpe.encode_whole(texts.filter(pa.array(odd)).to_pylist()))
    parts = [next(whole) if o else ids[a:b] for o, a, b in zip(odd, ends[:-1], ends[1:], strict=True)]
    return np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.concatenate(parts)


def texts_of(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The strings that a table has for ids, joined, and the bounds of each."""
    data, offsets = table
    sizes = offsets[ids + 1] - offsets[ids]
    return data[ragged(offsets[ids], sizes)], np.concatenate([[0], np.cumsum(sizes)])


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with `out`, the ids of each whole text; null texts have none. An `out` of df is replaced."""
    keep = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            ends, ids = token_ids(b.column(text), path)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], [*keep, out])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return df.select(*keep).mapInArrow(run, StructType([*df.select(*keep).schema.fields, StructField(out, ArrayType(IntegerType()))]))


def decode(ids: np.ndarray, path: str) -> str:
    return texts_of(np.asarray(ids, np.int64), model(path)[2])[0].tobytes().decode("utf-8", "replace")


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: of each whole text's ids, and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in pieces(batches, text):
            ends, ids = token_ids(b.column(text), path)
            _, _, strings, numbers = model(path)
            listed, l_at = texts_of(ids, numbers)
            said, s_at = texts_of(ids, strings)
            l_at, s_at = l_at[ends].tolist(), s_at[ends].tolist()
            listed, said = memoryview(listed), memoryview(said)
            plain = [said[a:z].tobytes().decode("utf-8", "replace").encode() for a, z in zip(s_at, s_at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.diff(ends), pa.int64()), pa.array([sha(listed[a : max(a, z - 1)]) for a, z in zip(l_at, l_at[1:], strict=False)]), pa.array([sha(x) for x in plain])], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
