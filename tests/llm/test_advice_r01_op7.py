"""op7: letters that the vocabulary takes apart."""

import collections
import zlib

import numpy as np

from tessella.llm import best_fit
from tessella.llm.queries import vocabulary


def test_letters_taken_apart(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["\u09b8\u09ae\u09df one two", "\u0958\u0932\u092e", "a \ufb1d b", "plain words", "e\u0301te\u0301 \u0130x", "\u212b \u1e9e"]
    rows = [(i, x) for i, x in enumerate(texts)]
    want = collections.Counter()
    for i, x in rows:
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = best_fit.pack(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert collections.Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == want


def test_other_unicode_tables(monkeypatch):
    """Pieces that look like one pretoken but are not are encoded by themselves."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    monkeypatch.setattr(best_fit.unicodedata, "normalize", lambda form, x: x)
    best_fit.tokenizer.cache_clear()
    text = "one \u0958\u0932\u092e two"
    ends, ids = best_fit.token_ids(pa.array([text]), path)
    best_fit.tokenizer.cache_clear()
    assert ids.tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 0]
