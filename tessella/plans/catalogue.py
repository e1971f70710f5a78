"""All queries of the engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames
from ..functions import text as T
from ..functions import vectors as V
from ..operators import blocks, changes, engine, kernel, moments, rejects, store
from ..operators import tables as O
from ..operators.catalog import Catalog
from ..operators.delta import Log
from ..operators.files import scratch
from ..operators.index import VectorIndex, centroid, centroid_rows, ranked
from ..operators.stored import StoredIndex
from ..sources import library, remote
from ..streaming import continuous, keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"))


def index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return VectorIndex.of(raw(spark, sf_dir), DIM)


def six(c, name: str):
    return F.round(c, 6).alias(name)


E_ = "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
C_ = E_ + """, d AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT i, avg(x) AS m FROM d GROUP BY i),
c AS (SELECT list(m ORDER BY i) AS c FROM m),
z AS (SELECT id, label, list_transform(list_zip(v, c), lambda t: t[1] - t[2]) AS w FROM e, c),
u AS (SELECT id, label, list_transform(w, lambda x: x / greatest(sqrt(list_inner_product(w, w)), 1e-8)) AS u FROM z)"""
S_ = C_ + """, s AS (SELECT a.id AS query_id, b.id, list_inner_product(a.u, b.u) AS raw FROM u a JOIN u b ON a.id <> b.id AND {queries}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM s)"""
ONE_ = S_.format(queries="a.id = 0")
CLIP_ = "least(greatest(raw, 0.0), 1.0)"


# vectors
@query(E_ + " SELECT id, round(greatest(sqrt(list_inner_product(v, v)), 1e-8), 6) AS norm FROM e")
def vector_norms(spark, d):
    return raw(spark, d).select("id", six(F.greatest(V.norm(F.col("v")), F.lit(V.FLOOR)), "norm"))


@query("SELECT vec_id AS id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS valid FROM embeddings")
def vector_validation(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.problem(F.col("embedding"), DIM).isNull().alias("valid"))


@query(E_ + ", n AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS n FROM e) SELECT id, (generate_subscripts(n, 1) - 1)::INTEGER AS i, round(unnest(n), 6) AS x FROM n")
def l2_normalise(spark, d):
    return raw(spark, d).select("id", F.posexplode(V.unit_query(F.col("v"))).alias("i", "x")).select("id", "i", six(F.col("x"), "x"))


@query(E_ + " SELECT b.id, round(list_inner_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.id = 0")
def dot_scores(spark, d):
    rows = raw(spark, d)
    one = rows.where("id = 0").select(F.col("v").alias("q"))  # one row
    return rows.join(F.broadcast(one)).select("id", six(V.dot(F.col("q"), F.col("v")), "score"))


@query(E_ + """, s AS (SELECT a.id AS query_id, b.id, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS raw FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id)
SELECT query_id, id, round(raw, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) <= 10""")
def cosine_pairs(spark, d):
    rows = index(spark, d).rows
    return kernel.top(rows, rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v"), 10).select("query_id", "id", six(F.col("raw_score"), "cosine"))


@query(ONE_ + f" SELECT id, round({CLIP_}, 6) AS score FROM r")
def clip_score(spark, d):
    i = index(spark, d)
    return i.scored(i.get(0).first()["v"], [0]).select("id", six(V.shown(F.col("raw_score")), "score"))


@query(ONE_ + f" SELECT id, CASE WHEN {CLIP_} >= 0.7 THEN 'similar' WHEN {CLIP_} >= 0.5 THEN 'somewhat similar' ELSE 'low' END AS band, floor({CLIP_} * 100 + 0.5)::INTEGER AS percent FROM r WHERE rank <= 50")
def score_bands(spark, d):
    return index(spark, d).like(0, 50).select("id", V.band(F.col("score")).alias("band"), V.percent(F.col("score")).alias("percent"))


@query("SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS i, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings WHERE vec_id = 7")
def get_vector(spark, d):
    return index(spark, d).get(7).select("id", F.posexplode("v").alias("i", "x")).select("id", "i", six(F.col("x"), "x"))


@query("SELECT vec_id AS id, 0.0::DOUBLE AS score FROM embeddings")
def zero_query(spark, d):
    i = index(spark, d)  # a query at the centroid is zero once it is centred
    return i.scored(i.centre).select("id", (F.col("raw_score") + 0.0).alias("score"))


@query(C_ + " SELECT (i - 1)::INTEGER AS i, round(m, 6) AS m FROM m")
def centroid_components(spark, d):
    return centroid_rows(raw(spark, d)).select("i", six(F.col("m"), "m"))


@query(C_ + " SELECT round(sqrt(list_inner_product(c, c)), 6) AS norm FROM c")
def centroid_norm(spark, d):
    return centroid(raw(spark, d)).select(six(V.norm(F.col("c")), "norm"))


@query(C_ + " SELECT id, (generate_subscripts(u, 1) - 1)::INTEGER AS i, round(unnest(u), 6) AS x FROM u")
def center_vectors(spark, d):
    return index(spark, d).unit().select("id", F.posexplode("v").alias("i", "x")).select("id", "i", six(F.col("x"), "x"))


# search
def _shape(df: DataFrame) -> DataFrame:
    return df.select("id", "rank", six(F.col("raw_score"), "raw_score"), six(F.col("score"), "score"))


TOP_ = " SELECT id, rank::INTEGER AS rank, round(raw, 6) AS raw_score, round(" + CLIP_ + ", 6) AS score FROM r "


@query(E_ + ", s AS (SELECT b.id, list_inner_product(a.v, b.v) AS raw FROM e a, e b WHERE a.id = 3), r AS (SELECT *, row_number() OVER (ORDER BY raw DESC, id) AS rank FROM s)" + TOP_ + "WHERE rank <= 10")
def topk_basic(spark, d):
    rows = raw(spark, d)
    one = rows.where("id = 3").select(F.col("v").alias("q"))
    return _shape(ranked(rows.join(F.broadcast(one)).select("id", V.dot(F.col("q"), F.col("v")).alias("raw_score")), 10))


@query(E_ + ", s AS (SELECT b.id, list_inner_product(a.v, b.v) AS raw FROM e a, e b WHERE a.id = 3 AND b.id NOT IN (3, 5, 8, 999999)), r AS (SELECT *, row_number() OVER (ORDER BY raw DESC, id) AS rank FROM s)" + TOP_ + "WHERE rank <= 10")
def topk_exclude(spark, d):
    rows = raw(spark, d)
    one = rows.where("id = 3").select(F.col("v").alias("q"))
    return _shape(ranked(rows.where(~F.col("id").isin(3, 5, 8, 999999)).join(F.broadcast(one)).select("id", V.dot(F.col("q"), F.col("v")).alias("raw_score")), 10))


@query(ONE_ + TOP_ + "WHERE rank <= 100 AND raw >= 0.2")
def topk_min_score(spark, d):
    return _shape(index(spark, d).like(0, 100, 0.2))


@query(ONE_ + TOP_)
def topk_k_gt_n(spark, d):
    return _shape(index(spark, d).like(0, 1_000_000))


@query(ONE_ + f" SELECT r.rank::INTEGER AS rank, r.id, round(raw, 6) AS raw_score, round({CLIP_}, 6) AS score, d.lang, d.source, d.n_chars FROM r JOIN documents d ON d.doc_id = r.id WHERE rank <= 10")
def search_basic(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return _shape(index(spark, d).like(0, 10)).join(docs, "id").select("rank", "id", "raw_score", "score", "lang", "source", "n_chars")


@query(ONE_ + " SELECT r.rank::INTEGER AS rank, r.id, round(raw, 6) AS raw_score, l.quality FROM r JOIN labels l ON l.doc_id = r.id WHERE rank <= 20")
def search_rank_gap(spark, d):
    known = read(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return _shape(index(spark, d).like(0, 20)).join(known, "id").select("rank", "id", "raw_score", "quality")


@query(ONE_ + f""" SELECT '{{"rank":' || rank || ',"id":' || id || '}}' AS line, round({CLIP_}, 6) AS score FROM r WHERE rank <= 10""")
def search_json_output(spark, d):
    return index(spark, d).like(0, 10).select(F.to_json(F.struct("rank", "id")).alias("line"), six(F.col("score"), "score"))


@query("SELECT doc_id AS id, left(sha256(encode(text)[1:163840]), 24) IN (SELECT left(sha256(encode(text)[1:163840]), 24) FROM documents WHERE doc_id % 2 = 0) AS known FROM documents")
def self_exclusion(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), T.content_id(F.encode("text", "UTF-8")).alias("id"))
    stored = Catalog.of(docs.where("doc % 2 = 0").select("id", F.col("doc").cast("string").alias("path")))
    return stored.contains(docs).select(F.col("doc").alias("id"), "known")


@query(S_.format(queries="a.id = 42") + TOP_ + "WHERE rank <= 5")
def more_like_this(spark, d):
    return _shape(index(spark, d).like(42, 5))


@query(S_.format(queries="a.id % 5 = 0") + " SELECT query_id, id, rank::INTEGER AS rank, round(raw, 6) AS raw_score FROM r WHERE rank <= 10")
def search_batch(spark, d):
    i = index(spark, d)
    return i.search_batch(i.rows.where("id % 5 = 0").select(F.col("id").alias("query_id"), "v"), 10).select("query_id", "id", "rank", six(F.col("raw_score"), "raw_score"))


# sources and routing
@query("SELECT doc_id AS id, left(sha256(encode(text)[1:163840]), 24) AS content_id FROM documents")
def content_id(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.content_id(F.col("text").cast("binary")).alias("content_id"))


PATHS_ = r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS p FROM pages"


def paths(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "").alias("p"))


@query(f"SELECT page_id, lower(regexp_extract(regexp_extract(p, '[^/]*$'), '^\\.*[^.].*?(\\.[^.]*)$', 1)) AS ext FROM ({PATHS_})")
def file_extension(spark, d):
    return paths(spark, d).select("page_id", T.extension(F.col("p")).alias("ext"))


@query(f"SELECT page_id, p AS path FROM ({PATHS_}) WHERE regexp_extract(p, '(\\.[^./]*)$', 1) = '.html' AND len(string_split(p, '/')) <= 3")
def scan_filter(spark, d):
    return paths(spark, d).where(T.is_audio(F.col("p"), (".html",), 3)).select("page_id", F.col("p").alias("path"))


SOURCES_ = "SELECT 'p' || page_id AS id, url AS s FROM pages UNION ALL SELECT 'b' || item_id, text FROM benchmark UNION ALL SELECT 't' || page_id, 'https://open.spotify.com/track/' || substr(sha256(url), 1, 22) || '?si=1' FROM pages"


def sources(spark, d):
    p, b = read(spark, d, "pages"), read(spark, d, "benchmark")
    made = p.select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("url").alias("s")).unionByName(b.select(F.concat(F.lit("b"), "item_id").alias("id"), F.col("text").alias("s")))
    return made.unionByName(p.select(F.concat(F.lit("t"), "page_id").alias("id"), F.concat(F.lit("https://open.spotify.com/track/"), F.left(F.sha2("url", 256), F.lit(22)), F.lit("?si=1")).alias("s")))


@query(f"SELECT id, CASE WHEN contains(s, '://') THEN 'url' WHEN s IN (SELECT text FROM benchmark WHERE item_id % 2 = 0) THEN 'local' ELSE 'text' END AS kind FROM ({SOURCES_})")
def route_source(spark, d):
    there = read(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("text").alias("s")).distinct().withColumn("there", F.lit(True))
    return sources(spark, d).join(there, "s", "left").select("id", T.source_kind(F.col("s"), F.col("there")).alias("kind"))


@query(f"SELECT id, CASE WHEN starts_with(s, 'file://') OR NOT contains(s, '://') THEN 'local' WHEN regexp_matches(s, '^https?://open\\.spotify\\.com/track/[A-Za-z0-9]+') THEN 'spotify' WHEN regexp_matches(s, '^https?://') THEN 'ytdlp' END AS resolver FROM ({SOURCES_})")
def route_resolver(spark, d):
    return sources(spark, d).select("id", T.resolver(F.col("s")).alias("resolver"))


@query(f"SELECT id, nullif(regexp_extract(s, '^https?://open\\.spotify\\.com/track/([A-Za-z0-9]+)', 1), '') AS track FROM ({SOURCES_})")
def extract_track_id(spark, d):
    return sources(spark, d).select("id", T.track_id(F.col("s")).alias("track"))


# builds and catalogs
PLAN_ = "WITH f AS (SELECT doc_id AS id, n_chars AS mtime FROM documents), s AS (SELECT doc_id AS id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id % 3 <> 0), p AS (SELECT f.id, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.id = f.id AND s.mtime = f.mtime) THEN 'skipped' ELSE 'index' END AS status FROM f)"


def build_plan(spark, d):
    found = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("mtime"))
    stored = found.where("id % 3 <> 0").select("id", (F.col("mtime") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("mtime"))
    return O.incremental(found, stored)


@query(PLAN_ + " SELECT id, status FROM p")
def incremental_plan(spark, d):
    return build_plan(spark, d).select("id", "status")


@query(PLAN_ + " SELECT count(*) FILTER (status = 'index') AS indexed, count(*) FILTER (status = 'skipped') AS skipped FROM p")
def build_counters(spark, d):
    return O.counters(build_plan(spark, d)).drop("failed")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_keep_last(spark, d):
    return O.keep_last(read(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dedupe_keep_first(spark, d):
    return O.keep_first(read(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""WITH n AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * CASE WHEN vec_id % 10 = 0 THEN 2 ELSE 1 END) AS v FROM embeddings
UNION ALL SELECT vec_id + 1000000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 10 = 5) SELECT id, (generate_subscripts(v, 1) - 1)::INTEGER AS i, round(unnest(v), 6) AS x FROM n""")
def index_union(spark, d):
    i = index(spark, d)
    new = i.rows.where("id % 10 = 0").select("id", F.transform("v", lambda x: 2 * x).alias("v")).unionByName(i.rows.where("id % 10 = 5").select((F.col("id") + 1000000000).alias("id"), "v"))
    return i.upsert(new).rows.select("id", F.posexplode("v").alias("i", "x")).select("id", "i", six(F.col("x"), "x"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 1)")
def index_remove(spark, d):
    gone = read(spark, d, "embeddings").where("label = 1").select(F.col("vec_id").alias("id"))
    return index(spark, d).remove(gone, strict=False).rows.select("id")


@query("SELECT count(*) AS total, max(len(embedding))::INTEGER AS dim FROM embeddings")
def index_stats(spark, d):
    return index(spark, d).stats()


# pooling and features
@query(C_ + " SELECT label, (i - 1)::INTEGER AS i, round(avg(x), 6) AS x FROM d JOIN e USING (id) GROUP BY label, i")
def mean_pool(spark, d):
    return O.mean_pool(read(spark, d, "embeddings"), "label", "embedding").select("label", "i", six(F.col("x"), "x"))


@query(C_ + " SELECT label, count(*) AS n, (i - 1)::INTEGER AS i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM d JOIN e USING (id) GROUP BY label, i")
def pooled_moments(spark, d):
    p = moments.pooled(read(spark, d, "embeddings"), ["label"], "embedding")
    return p.select("label", "n", F.posexplode(F.arrays_zip("mean", "std")).alias("i", "s")).select("label", "n", "i", six(F.col("s.mean"), "mean"), six(F.col("s.std"), "std"))


@query("SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS std FROM lineitem GROUP BY 1")
def feature_mean_std(spark, d):
    return O.feature_stats(read(spark, d, "lineitem"), "l_returnflag", "l_quantity").select("l_returnflag", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(E_ + ", d AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), s AS (SELECT id, avg(x) AS m, stddev_pop(x) AS s FROM d GROUP BY id) SELECT id, (i - 1)::INTEGER AS i, round((x - m) / (s + 1e-6), 5) AS x FROM d JOIN s USING (id)")
def patch_standardise(spark, d):
    return moments.standardised(raw(spark, d), "v").select("id", F.posexplode("v").alias("i", "x")).select("id", "i", F.round("x", 5).alias("x"))


@query("SELECT doc_id AS id, unnest(range(n_chars // 96))::INTEGER AS patch, 96 * patch AS first FROM documents WHERE n_chars >= 96")
def patch_tiling(spark, d):
    tiles = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(frames.tiles(F.col("n_chars"))).alias("patch", "first"))
    return tiles.select("id", "patch", "first")


@query("SELECT doc_id AS id, round(n_chars * 0.1, 6)::DOUBLE AS start, least(n_chars - n_chars * 0.1, 180)::DOUBLE AS seconds FROM documents")
def clip_offset(spark, d):
    n = F.col("n_chars")
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), six(frames.clip_start(n), "start"), six(frames.clip_length(n), "seconds"))


# parsing and enrichment
@query("SELECT p_partkey AS id, p_size AS duration FROM part WHERE p_partkey % 11 <> 0 AND p_size >= 10")
def tsv_parse(spark, d):
    p = read(spark, d, "part")
    line = F.when(F.col("p_partkey") % 11 == 0, "TRACK_ID\tARTIST\tALBUM\tPATH\tDURATION\tTAGS").otherwise(F.concat_ws("\t", F.concat(F.lit("track_00"), "p_partkey"), F.lit("a"), F.lit("b"), F.lit("c.mp3"), F.col("p_size").cast("string"), F.lit("genre---x")))
    return library.dataset_tsv(p.select(line.alias("value"))).select(F.col("track_id").cast("long").alias("id"), F.col("duration").cast("int").alias("duration"))


@query("SELECT p_partkey AS id, coalesce(nullif(ltrim(replace('track_000' || (p_partkey % 100), 'track_', ''), '0'), ''), '0') AS number FROM part")
def numeric_id(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), T.numeric_id(F.concat(F.lit("track_000"), (F.col("p_partkey") % 100).cast("string"))).alias("number"))


@query("SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(p_type), ' '), lambda t: t <> ''))), ',') AS tags FROM part WHERE len(list_intersect(string_split(lower(p_type), ' '), ['brass', 'small'])) > 0")
def tag_subset(spark, d):
    return read(spark, d, "part").where(T.tags_wanted(F.col("p_type"), ["brass", "small"])).select(F.col("p_partkey").alias("id"), F.array_join(T.tag_names(F.col("p_type")), ",").alias("tags"))


@query("SELECT p_partkey AS id, p_size >= 10 AS keeps_ten, p_size > 10 AS drops_ten FROM part WHERE p_size >= 10")
def duration_filter(spark, d):
    return read(spark, d, "part").where("p_size >= 10").select(F.col("p_partkey").alias("id"), (F.col("p_size") >= 10).alias("keeps_ten"), (F.col("p_size") > 10).alias("drops_ten"))


@query("SELECT event_id FROM events WHERE event_type <> 'click' ORDER BY ts, event_id LIMIT 25")
def limit_in_order(spark, d):
    return O.in_order(read(spark, d, "events").where("event_type <> 'click'"), 25, "ts", "event_id").select("event_id")


@query("SELECT doc_id AS id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'Unknown') AS title FROM documents")
def falsy_coalesce(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), T.first_present(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.col("source"), F.lit("Unknown")).alias("title"))


@query("SELECT conv_id AS id, nullif(string_agg(role, ', ' ORDER BY turn), '') AS names FROM conversations GROUP BY conv_id")
def artist_join(spark, d):
    return O.artists(read(spark, d, "conversations").withColumnRenamed("conv_id", "id"), "id", "role", "turn")


SIDE_ = "SELECT d.doc_id AS id, coalesce(nullif(CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE d.lang END, ''), 'q' || l.quality) AS title, coalesce(l.toxic, d.n_chars)::BIGINT AS length FROM documents d LEFT JOIN labels l USING (doc_id)"


@query(SIDE_)
def sidecar_enrich(spark, d):
    tracks = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("title"), F.col("n_chars").alias("length"))
    side = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), "quality").alias("title"), F.col("toxic").cast("long").alias("length"))
    return O.enrich(tracks, side, "id", ["title"], ["length"])


@query("SELECT d.doc_id AS id, d.lang, coalesce(l.quality, -1)::INTEGER AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def catalog_enrich(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), "lang", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE lang END AS lang, source FROM documents")
def map_enrich(spark, d):
    had = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    put = F.map_concat(F.map_filter(had, lambda k, v: ~((k == "lang") & (F.col("doc_id") % 2 == 0))), F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.lit("new"))).otherwise(F.map_filter(had, lambda k, v: F.lit(False))))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), put.alias("m")).select("id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"))


@query("SELECT doc_id AS id, '{\"id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' AS line, lang AS back FROM documents")
def json_props(spark, d):
    line = F.to_json(F.struct(F.col("doc_id").alias("id"), "lang"))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), line.alias("line"), F.get_json_object(line, "$.lang").alias("back"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def html_escape(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(T.html_escape(F.col("html")), 256).alias("escaped"))


@query(f"SELECT page_id, starts_with(q, '/') OR list_contains(string_split(q, '/'), '..') AS unsafe FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/' || p WHEN 1 THEN 'a/../' || p ELSE p END AS q FROM ({PATHS_}))")
def unsafe_paths(spark, d):
    q = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/"), "p")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("a/../"), "p")).otherwise(F.col("p"))
    return paths(spark, d).select("page_id", T.unsafe_path(q).alias("unsafe"))


@query("SELECT p_brand AS brand, arg_max(p_partkey, (p_size, -p_partkey)) AS id FROM part GROUP BY 1")
def argmax_by_size(spark, d):
    return O.largest(read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), "p_size"), "brand", "id", F.col("p_size"), -F.col("id"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_downloads(spark, d):
    return O.pending(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"))


@query("SELECT conv_id AS id, arg_min(role, turn) AS first FROM conversations GROUP BY conv_id")
def metadata_first_value(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    told = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.transform(turns, lambda t: t["role"]).alias("roles"))
    return told.select("id", T.first_element(F.col("roles")).alias("first"))


@query("SELECT 'index-' || p_partkey AS name, p_size * 1048576.0::DOUBLE / 1048576 AS size_mb FROM part")
def registry_list(spark, d):
    return read(spark, d, "part").select(F.concat(F.lit("index-"), "p_partkey").alias("name"), T.megabytes(F.col("p_size") * F.lit(1048576.0)).alias("size_mb"))


# validated changes, catalogs, remote catalogs
@query(E_ + ", n AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'NaN'::DOUBLE ELSE 2 * v[1] END AS x FROM e WHERE id % 5 = 0) SELECT e.id, round(coalesce((SELECT n.x FROM n WHERE n.id = e.id AND NOT isnan(n.x)), e.v[1]), 6) AS x FROM e")
def upsert_invalid(spark, d):
    i = index(spark, d)
    bad = F.when(F.col("id") % 10 == 0, float("nan")).otherwise(2.0)
    return i.upsert(i.rows.where("id % 5 = 0").select("id", F.transform("v", lambda x: x * bad).alias("v")), strict=False).rows.select("id", six(F.get("v", F.lit(0)), "x"))


@query("SELECT d.doc_id AS id, coalesce(s.t, d.lang) AS title, coalesce(s.l, d.n_chars)::BIGINT AS length FROM documents d LEFT JOIN (SELECT item_id AS k, 'late' AS t, item_id + 1 AS l FROM benchmark) s ON s.k = d.doc_id")
def enrich_repeated(spark, d):
    tracks = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id").isin([]), "").otherwise(F.col("lang")).alias("title"), F.col("n_chars").alias("length"))
    b = read(spark, d, "benchmark")
    side = b.select(F.col("item_id").alias("id"), F.lit("early").alias("title"), F.col("item_id").alias("length"), F.lit(0).alias("seq")).unionByName(b.select(F.col("item_id").alias("id"), F.lit("late").alias("title"), (F.col("item_id") + 1).alias("length"), F.lit(1).alias("seq")))
    return O.enrich(tracks, side, "id", [], ["title", "length"], "seq")


def catalog(spark, d) -> Catalog:
    docs = read(spark, d, "documents")
    return Catalog.of(docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat(F.lit("lib\\"), "lang", F.lit("\\"), "doc_id", F.lit(".mp3")).alias("path"), F.col("source").alias("title"), F.col("n_chars").cast("double").alias("mtime")))


@query("SELECT 'd' || doc_id AS id, 'lib/' || lang || '/' || doc_id || '.mp3' AS path, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE source END AS title, n_chars::DOUBLE AS mtime FROM documents WHERE doc_id % 9 <> 0")
def catalog_upsert(spark, d):
    c = catalog(spark, d)
    number = F.substring("id", 2, 20).cast("long")
    new = c.rows.where(number % 4 == 0).withColumn("title", F.lit("new"))
    return c.add(new).remove(c.ids().where(number % 9 == 0)).rows.select("id", "path", "title", "mtime")


@query("SELECT page_id, page_id IN (SELECT doc_id FROM documents) AS known FROM pages")
def catalog_contains(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.concat(F.lit("d"), "page_id").alias("id"))
    return catalog(spark, d).contains(pages).select("page_id", "known")


@query("SELECT 'd' || d.doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality::VARCHAR END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def catalog_extra(spark, d):
    side = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality")
    c = catalog(spark, d).enrich(side, library.T.stem(F.col("path")), "doc_id", ["quality"])
    return c.rows.select("id", F.col("extra")["quality"].alias("quality"))


@query("SELECT 'd' || doc_id AS id, '{\"id\":\"d' || doc_id || '\",\"path\":\"lib/' || lang || '/' || doc_id || '.mp3\",\"title\":\"' || source || '\",\"artist\":null,\"album\":null,\"duration_seconds\":null}' AS line FROM documents")
def catalog_json(spark, d):
    rows = catalog(spark, d).rows
    return rows.select("id", F.regexp_replace(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), ',"mtime".*$', "}").alias("line"))


@query("WITH p AS (SELECT 'lib/' || doc_id || '.mp3' AS path FROM documents WHERE doc_id % 7 = 0) SELECT array_to_string(list(path ORDER BY path)[1:10], ',') AS first, greatest(count(*) - 10, 0) AS more FROM p")
def build_failures(spark, d):
    plan = read(spark, d, "documents").select(F.concat(F.lit("lib/"), "doc_id", F.lit(".mp3")).alias("path"), F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("index").alias("status"))
    return O.failures(plan).select(F.array_join("first", ",").alias("first"), "more")


JSON_ = "SELECT doc_id AS seq, doc_id % 50 AS tid, lang, source, n_chars, doc_id % 6 = 0 AS bare FROM documents"


@query(f"SELECT tid::VARCHAR AS track_id, arg_min(lang, seq) AS title, arg_min(lang || ', ' || source, seq) AS artist, arg_min('A' || source, seq) AS album, arg_min('u' || seq, seq) AS album_art_url, arg_min(n_chars, seq) / 1000.0::DOUBLE AS seconds FROM ({JSON_}) WHERE NOT bare AND tid <> 0 GROUP BY tid")
def remote_search_tracks(spark, d):
    docs, tid = read(spark, d, "documents"), (F.col("doc_id") % 50).cast("string")
    name = lambda c: F.struct(c.alias("name"))
    album = F.struct(F.concat(F.lit("A"), "source").alias("name"), F.array(F.struct(F.concat(F.lit("u"), "doc_id").alias("url"))).alias("images"))
    line = F.to_json(F.struct(F.when(tid != "0", tid).alias("id"), F.col("lang").alias("name"), F.when(F.col("doc_id") % 6 != 0, "p").alias("preview_url"), F.col("n_chars").alias("duration_ms"), F.array(name(F.col("lang")), name(F.lit("")), name(F.col("source"))).alias("artists"), album.alias("album")))
    rows = remote.spotify_tracks(docs.select(F.col("doc_id").alias("seq"), line.alias("value")))
    return rows.select("track_id", "title", "artist", "album", "album_art_url", T.seconds(F.col("duration_ms")).alias("seconds"))


@query(f"SELECT tid::VARCHAR AS track_id, arg_min(CASE WHEN seq % 2 = 0 THEN 'own' ELSE 'listed' END, seq) AS album, arg_min(CASE WHEN seq % 2 = 0 THEN 'big' ELSE 'm' || seq END, seq) AS album_art_url, arg_min(n_chars::VARCHAR, seq) AS duration_sec FROM ({JSON_}) WHERE NOT bare GROUP BY tid")
def remote_album_tracks(spark, d):
    docs = read(spark, d, "documents")
    own = F.struct(F.lit("own").alias("title"), F.lit("").alias("cover_medium"), F.lit("big").alias("cover_big"))
    line = F.to_json(F.struct((F.col("doc_id") % 50).alias("id"), F.when(F.col("doc_id") % 6 != 0, "p").alias("preview"), F.col("n_chars").alias("duration"), F.when(F.col("doc_id") % 2 == 0, own).alias("album")))
    parent = F.to_json(F.struct(F.lit("listed").alias("title"), F.concat(F.lit("m"), "doc_id").alias("cover_medium")))
    rows = remote.deezer_tracks(docs.select(F.col("doc_id").alias("seq"), line.alias("value"), parent.alias("album")), album="album")
    return rows.select("track_id", "album", "album_art_url", "duration_sec")


@query("SELECT doc_id AS id FROM documents WHERE n_chars > 200 AND doc_id % 5 <> 0")
def downloadable_tracks(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, "u").otherwise("").alias("url"), F.col("n_chars").alias("duration"))
    return remote.downloadable(rows, "url", "duration", 200).select("id")


@query("SELECT doc_id AS id, doc_id % 3 <> 0 AS same FROM documents")
def checksum_equality(spark, d):
    content = F.encode("text", "UTF-8")
    expected = F.when(F.col("doc_id") % 3 == 0, F.lit("0")).otherwise(F.upper(F.sha2(content, 256)))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), remote.checksum_matches(content, expected).alias("same"))


@query("SELECT p_partkey AS id, format('{:,}', p_partkey * 1000 + p_size) AS shown FROM part")
def thousands_format(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), T.thousands(F.col("p_partkey") * 1000 + F.col("p_size")).alias("shown"))


@query("SELECT 'index-' || p_brand AS name, arg_min(p_partkey, p_partkey) AS at, arg_min(p_size, p_partkey) * 1048576.0::DOUBLE / 1048576 AS size_mb FROM part GROUP BY p_brand")
def registry_lookup(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("at"), F.concat(F.lit("index-"), "p_brand").alias("name"), (F.col("p_size") * F.lit(1048576)).alias("size_bytes"))
    return O.keep_first(library.registry_rows(rows), "name", "at").select("name", "at", "size_mb")


@query(ONE_ + f" SELECT r.rank::INTEGER AS rank, round({CLIP_}, 6) AS score, round(raw, 6) AS raw_score, 'd' || r.id AS track_id, d.source AS title, d.doc_id % 2 = 0 AS has_audio FROM r JOIN documents d ON d.doc_id = r.id WHERE rank <= 10")
def api_result_rows(spark, d):
    i, c = index(spark, d), catalog(spark, d)
    ids = i.rows.select("id", F.concat(F.lit("d"), "id").alias("track"))
    e = engine.Engine(i, c, ids, "mock")
    files = c.rows.where(F.substring("id", 2, 20).cast("long") % 2 == 0).select("path")
    return engine.api_rows(e.like("d0", 10), files).select("rank", "score", "raw_score", "track_id", "title", "has_audio")


@query(ONE_ + f""" SELECT r.rank::INTEGER AS rank, '{{"rank":' || rank || ',"title":"' || d.source || '","artist":null,"path":"lib/' || d.lang || '/' || d.doc_id || '.mp3"}}' AS line FROM r JOIN documents d ON d.doc_id = r.id WHERE rank <= 10""")
def cli_json_rows(spark, d):
    i, c = index(spark, d), catalog(spark, d)
    e = engine.Engine(i, c, i.rows.select("id", F.concat(F.lit("d"), "id").alias("track")), "mock")
    return engine.json_rows(e.like("d0", 10)).select("rank", F.regexp_replace("line", '"score":[^,]*,"raw_score":[^,]*,', "").alias("line"))


# stored indexes, streams, change feeds
def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern: a stream's path is no single file


def spread(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("v").alias("i", "x")).select("id", "i", six(F.col("x"), "x"))


@query(E_ + """, a AS (SELECT id, list_transform(v, lambda x: x * CASE WHEN id % 10 = 0 THEN 2 ELSE 1 END) AS v FROM e WHERE id % 7 <> 3
UNION ALL SELECT id + 1000000000, v FROM e WHERE id % 10 = 5 UNION ALL SELECT id, list_transform(v, lambda x: 3 * x) FROM e WHERE id % 21 = 3)
SELECT id, (generate_subscripts(v, 1) - 1)::INTEGER AS i, round(unnest(v), 6) AS x FROM a""")
def index_delta_merge(spark, d):
    rows, log = index(spark, d).rows, Log(spark, scratch(spark, "delta"))
    log.replace({"vectors": (rows, "id")})
    log.change({"vectors": rows.where("id % 10 = 0").select("id", F.transform("v", lambda x: 2 * x).alias("v"))})
    log.change({"vectors": rows.where("id % 10 = 5").select((F.col("id") + 1000000000).alias("id"), "v")}, {"vectors": rows.where("id % 7 = 3").select("id")})
    log.change({"vectors": rows.where("id % 21 = 3").select("id", F.transform("v", lambda x: 3 * x).alias("v"))})
    return spread(log.read("vectors"))


@query(E_ + """, a AS (SELECT id, list_transform(v, lambda x: x * CASE WHEN id % 10 = 0 THEN 2 ELSE 1 END) AS v FROM e WHERE id % 7 <> 3),
d AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a) SELECT (i - 1)::INTEGER AS i, round(avg(x), 6) AS m, (SELECT count(*) FROM a) AS n FROM d GROUP BY i""")
def stored_centroid(spark, d):
    start = index(spark, d)
    held = StoredIndex.create(start, scratch(spark, "stored"), "mock")
    gone = start.rows.where("id % 7 = 3").select("id")
    held.change(start.rows.where("id % 10 = 0 AND id % 7 <> 3").select("id", F.transform("v", lambda x: 2 * x).alias("v")), gone)
    known = held.index().known
    return spark.createDataFrame([(i, x, known.n) for i, x in enumerate(known.mean())], "i int, m double, n long").select("i", six(F.col("m"), "m"), "n")


@query(S_.format(queries="a.id % 5 = 0") + " SELECT query_id, id, rank::INTEGER AS rank, round(raw, 6) AS raw_score FROM r WHERE rank <= 10")
def search_blocks(spark, d):
    i = index(spark, d)
    found = blocks.top(blocks.pack(i.rows, DIM), i.rows.where("id % 5 = 0").select(F.col("id").alias("query_id"), "v"), 10, i.centre, DIM)
    return found.rows.select("query_id", "id", "rank", six(F.col("raw_score"), "raw_score"))


@query("SELECT id, why AS reason FROM (SELECT vec_id AS id, CASE vec_id % 9 WHEN 1 THEN 'null' WHEN 2 THEN 'dimension' WHEN 3 THEN 'not finite' WHEN 4 THEN 'not finite' END AS why FROM embeddings) WHERE why IS NOT NULL")
def rejected_vectors(spark, d):
    v, n = F.col("v"), F.col("id") % 9
    bad = F.when(n == 1, F.lit(None)).when(n == 2, F.slice(v, 1, DIM - 1)).when(n == 3, F.transform(v, lambda x: x * float("nan"))).when(n == 4, F.transform(v, lambda x: F.lit(float("inf")))).otherwise(v)
    return rejects.sift(raw(spark, d).withColumn("v", bad), scratch(spark, "rejects"), DIM).rejected.select("id", "reason")


FEED_ = """WITH f AS (SELECT '/p' || doc_id AS path, CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'c' || (doc_id + 1) WHEN doc_id % 11 = 0 THEN 'new' || doc_id WHEN doc_id % 13 = 0 THEN 'all' ELSE 'c' || doc_id END AS id, n_chars AS stamp FROM documents WHERE doc_id % 17 <> 0),
k AS (SELECT 'c' || doc_id AS id, '/p' || doc_id AS path FROM documents WHERE doc_id % 3 <> 0),
w AS (SELECT f.*, k.path AS home, max(f.path) OVER (PARTITION BY f.id) AS last, coalesce(bool_or(f.path = k.path) OVER (PARTITION BY f.id), false) AS stays FROM f LEFT JOIN k ON f.id = k.id WHERE f.id IS NOT NULL),
r AS (SELECT *, CASE WHEN path = home THEN 'same' WHEN stays OR path <> last THEN 'duplicate' WHEN home IS NOT NULL THEN 'moved' ELSE 'added' END AS role FROM w),
lost AS (SELECT * FROM k WHERE id NOT IN (SELECT id FROM f WHERE id IS NOT NULL) AND path NOT IN (SELECT path FROM f WHERE id IS NULL))
SELECT role AS status, path, id, stamp, CASE WHEN role = 'moved' THEN home END AS old_path, NULL AS old_id FROM r WHERE role <> 'added'
UNION ALL SELECT CASE WHEN lost.id IS NULL THEN 'added' WHEN r.id IS NULL THEN 'deleted' ELSE 'changed' END, r.path, r.id, r.stamp, CASE WHEN r.id IS NULL THEN lost.path END, lost.id
FROM (SELECT * FROM r WHERE role = 'added') r FULL JOIN lost ON r.path = lost.path"""


@query(FEED_)
def library_changes(spark, d):
    n, docs = F.col("doc_id"), read(spark, d, "documents")
    own = F.when(n % 8 == 0, F.lit(None)).when(n % 5 == 0, F.concat(F.lit("c"), n + 1)).when(n % 11 == 0, F.concat(F.lit("new"), n)).when(n % 13 == 0, "all").otherwise(F.concat(F.lit("c"), n))
    path = F.concat(F.lit("/p"), n).alias("path")
    found = docs.where(n % 17 != 0).select(path, own.alias("id"), F.col("n_chars").alias("mtime"))
    return changes.feed(found, docs.where(n % 3 != 0).select(F.concat(F.lit("c"), n).alias("id"), path)).select("status", "path", "id", "stamp", "old_path", "old_id")


@query(E_ + " SELECT id, (generate_subscripts(v, 1) - 1)::INTEGER AS i, round(unnest(v), 6) AS x FROM e WHERE id % 6 <> 5")
def stream_index(spark, d):
    rows = stream(spark, d, "embeddings")
    made = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(0).alias("seq"), (F.col("vec_id") % 6 == 5).alias("gone"))
    root = scratch(spark, "stream")
    continuous.index_stream(spark, made, root, f"{root}-checkpoint", "mock", DIM).awaitTermination()
    return spread(store.load(spark, root, "vectors", "mock"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_keep_last(spark, d):
    root, rows = scratch(spark, "last"), stream(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    last = keyed.keep_last(rows, "user_id", "ts", "event_id", "1 day", "36500 days")
    last.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/batch={n}")).outputMode("update").option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    given = spark.read.schema(rows.schema).parquet(f"{root}/batch=*")
    return O.keep_last(given, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")
