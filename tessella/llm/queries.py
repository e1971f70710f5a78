"""The queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, block_knn, divergence, hyper_minhash, merkle, ngram_trie, path_dedup, prefix_bpe, preference, shingle_join, telephony, toxicity, url_filters


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return block_knn.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.text_features(read(spark, sf_dir, "documents"))


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.neighbours(read(spark, sf_dir, "conversations")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.judge(read(spark, sf_dir, "documents"), least=1)


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.digests(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.alike(read(spark, sf_dir, "documents"))


def op10_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_dedup.digests(read(spark, sf_dir, "documents"))


def op11_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper_minhash.alike(read(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.judged(read(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


_ALL = (
    op1_block_knn, op2_telephony, op3_preference, op4_url_filters, op5_toxicity, op6_ngram_trie, op7_best_fit,
    op8_prefix_bpe, op9_shingle_join, op10_path_dedup, op11_hyper_minhash, op12_merkle, op13_divergence,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

SQL: dict[str, str] = {}

SQL["op1_block_knn"] = """
WITH c AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), q AS (SELECT DISTINCT vec_id, v FROM c WHERE vec_id % 20 = 0), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM q JOIN c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

SQL["op3_preference"] = """
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS pos FROM t
), sizes AS (
  SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM p GROUP BY 1
  HAVING count(*) FILTER (side = 0) > 0 AND count(*) FILTER (side = 1) > 0
), differ AS (
  SELECT a.pair_id, min(a.pos) - 1 AS n FROM p a JOIN p b ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.side = 0 AND b.side = 1
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY 1
), cut AS (SELECT s.pair_id, coalesce(d.n, least(nc, nr)) AS n FROM sizes s LEFT JOIN differ d USING (pair_id)),
r AS (
  SELECT p.*, n, '<|' || role || '|>' || chr(10) AS h, text || '<|end|>' || chr(10) AS b FROM p JOIN cut USING (pair_id)
), m AS (
  SELECT *, CASE WHEN role = 'assistant' THEN '-' || length(h) || ' +' || length(b) ELSE '-' || (length(h) + length(b)) END AS k FROM r
)
SELECT pair_id, any_value(n)::INTEGER AS n_common,
  coalesce(string_agg(h || b, '' ORDER BY pos) FILTER (side = 0 AND pos <= n), '') AS prompt,
  coalesce(string_agg(h || b, '' ORDER BY pos) FILTER (side = 0 AND pos > n), '') AS chosen,
  coalesce(string_agg(k, ' ' ORDER BY pos) FILTER (side = 0 AND pos > n), '') AS chosen_mask,
  coalesce(string_agg(h || b, '' ORDER BY pos) FILTER (side = 1 AND pos > n), '') AS rejected,
  coalesce(string_agg(k, ' ' ORDER BY pos) FILTER (side = 1 AND pos > n), '') AS rejected_mask
FROM m GROUP BY pair_id
"""

SQL["op4_url_filters"] = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rule) AS (
  VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('block', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')
), r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM rules)
SELECT u.page_id, u.host, u.path, arg_max(r.rule, length(r.rule)) AS rule, coalesce(arg_max(r.verdict, length(r.rule)), 'allow') AS verdict
FROM (SELECT *, row_number() OVER () AS n FROM u) u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
GROUP BY u.n, u.page_id, u.host, u.path
"""

SQL["op11_hyper_minhash"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh
  FROM d
), t AS (SELECT r, len(sh) AS n, md5(array_to_string(list_sort(sh), chr(10))) AS h, sh FROM s),
classes AS (SELECT h, any_value(n) AS n, min(r) AS c, any_value(sh) AS sh FROM t WHERE n > 0 GROUP BY h),
e AS (SELECT c, n, unnest(sh) AS x FROM classes),
common AS (
  SELECT a.c AS x, b.c AS y, a.n AS nx, b.n AS ny, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.c < b.c AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY ALL
), of AS (SELECT s.doc_id, t.n, c.c FROM s JOIN t USING (r) LEFT JOIN classes c ON t.n > 0 AND t.h = c.h),
links AS (SELECT x, y FROM common WHERE 100 * k >= 80 * (nx + ny - k) UNION SELECT a.c, b.c FROM of a JOIN of b ON a.doc_id = b.doc_id AND a.c < b.c),
sides AS (SELECT x, y FROM links UNION SELECT y, x FROM links UNION SELECT c, c FROM classes),
reach(x, y) AS (SELECT x, y FROM sides UNION SELECT r.x, b.y FROM reach r JOIN sides b ON r.y = b.x),
low AS (SELECT r.x AS c, min(o.doc_id) AS component FROM reach r JOIN of o ON o.c = r.y GROUP BY r.x)
SELECT o.doc_id, o.n::BIGINT AS n_shingles, CASE WHEN o.doc_id IS NULL OR o.n = 0 THEN o.doc_id ELSE l.component END AS component_id,
  o.doc_id IS NOT DISTINCT FROM CASE WHEN o.doc_id IS NULL OR o.n = 0 THEN o.doc_id ELSE l.component END AS kept
FROM of o LEFT JOIN low l ON o.c = l.c
"""

_LEAF = "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "{n}", "text")) + "))"

SQL["op12_merkle"] = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), rows AS (
  SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="(n_chars::HUGEINT + 1)")} AS other,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS crc
  FROM documents, crc
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows
), low(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY i) FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM low WHERE len(nodes) > 1
), subroots AS (
  SELECT lang, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM low WHERE len(nodes) = 1
), high(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY i) FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM high WHERE len(nodes) > 1
), steps AS (
  SELECT l.lang, l.i, n.level AS step, (l.i >> n.level) % 2 AS side, n.nodes[(xor(l.i >> n.level, 1)) + 1] AS sib
  FROM leaves l JOIN low n ON l.lang IS NOT DISTINCT FROM n.lang AND len(n.nodes) > 1
  UNION ALL
  SELECT l.lang, l.i, s.height + n.level, (s.i >> n.level) % 2, n.nodes[(xor(s.i >> n.level, 1)) + 1]
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN high n ON len(n.nodes) > 1
), paths AS (
  SELECT lang, i, list((CASE WHEN sib IS NULL THEN '-' WHEN side = 1 THEN 'L' ELSE 'R' END) || coalesce(sib, '') ORDER BY step) AS path FROM steps GROUP BY lang, i
), made AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root, coalesce(p.path, []) AS path,
    CASE WHEN crc % 7 = 0 AND other IS NOT NULL THEN other ELSE leaf END AS changed
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths p ON p.i = l.i AND p.lang IS NOT DISTINCT FROM l.lang
), folded AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda e: substr(e, 2)), '')) AS proof_sha256,
    list_reduce(list_prepend(changed, path), lambda a, e: sha256(CASE e[1] WHEN 'L' THEN substr(e, 2) || a WHEN 'R' THEN a || substr(e, 2) ELSE a END)) AS folded_root
  FROM made
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

SQL["op13_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT l.lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.c + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
