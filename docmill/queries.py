"""Queries of the engine's own operators over the test tables, with their SQL.

Every query runs over whole tables. A query without SQL folds texts, parses
HTML, walks links or samples; those are tested against brute force and fixtures.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.functions import vectors as V
from docmill.functions.html import extract_page
from docmill.operators import ann, bm25, chunking, dedup, hybrid, lifecycle, quantizer, search
from docmill.plans.lineage import scratch
from docmill.plans.tables import dealt, spread, table
from docmill.schema import AnnParams, Bm25Params, CrawlChunks, CrawlConfig, CrawlMode, FixedSize, HeadingBased, HybridOptions, SearchOptions, Semantic, UrlPatterns
from docmill.sources import pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The fixed "now" of queries about age, and the text of queries about keywords.
NOW = datetime(2025, 6, 1, tzinfo=timezone.utc)
WORDS = "snapshot registry callback snapshot"
SOURCE = "velmora"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("@one@", "")
        return f

    return add


def flat_entries(spark: SparkSession, d: str) -> DataFrame:
    """entries with the fields of their documents side by side."""
    doc, meta = F.col("document"), F.col("document.metadata")
    fields = [doc[c].alias(c) for c in ("content", "url", "title", "section")] + [meta[c].alias(c) for c in ("content_type", "language", "last_updated", "tags")]
    return table(spark, d, "entries").select("id", "indexed_at", "vector", *fields)


def _query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _entry_vector(spark: SparkSession, d: str) -> list[float]:
    return list(flat_entries(spark, d).filter(F.col("id") == "e000000000").select("vector").first()[0])


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_EQ = "(SELECT first(vector)::DOUBLE[] FROM entries WHERE id = 'e000000000')"
_FIT = "vector IS NOT NULL AND len(list_filter(vector, lambda x: isnan(x))) = 0"
_ECOS = f"CASE WHEN len(vector) <> 64 OR list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) = 0 THEN 0 ELSE list_cosine_similarity(CASE WHEN len(vector) = 64 THEN vector::DOUBLE[] ELSE {_EQ} END, {_EQ}) END"
_WS = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


# scans and projections


@query("scan_entries", "SELECT id, document.url AS url, document.title AS title, document.section AS section, document.metadata.content_type AS content_type, document.metadata.language AS language, len(document.metadata.tags) AS tags, len(vector) AS dimension FROM entries")
def scan_entries(spark: SparkSession, d: str) -> DataFrame:
    e = flat_entries(spark, d)
    return e.select("id", "url", "title", "section", "content_type", "language", F.when(F.col("tags").isNotNull(), F.size("tags")).alias("tags"), V.dimension(F.col("vector")).alias("dimension"))


@query("count_entries", "SELECT count(*) AS documents, count(DISTINCT id) AS ids FROM entries")
def count_entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("id").alias("ids"))


@query("point_lookup", "SELECT id, document.url AS url FROM entries WHERE id = 'e000000005' LIMIT 1")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return search.point_lookup(flat_entries(spark, d), "e000000005", order_col="indexed_at").select("id", "url")


@query("preview", "SELECT id, left(document.content, 200) AS preview FROM entries")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return flat_entries(spark, d).select("id", X.preview(F.col("content")).alias("preview"))


@query("source_filter", f"SELECT id FROM entries WHERE contains(document.url, '{SOURCE}') AND document.metadata.content_type = 'Documentation'")
def source_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.filtered(flat_entries(spark, d), SearchOptions(source_filter=SOURCE, content_type="Documentation")).select("id")


@query("empty_chunk_filter", f"SELECT chunk_id FROM chunks WHERE {_trim('content')} <> ''")
def empty_chunk_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter(~X.is_blank(F.col("content"))).select("chunk_id")


# vectors


@query("vector_topk", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 5) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = search.exact_topk(table(spark, d, "embeddings"), _query_vector(spark, d), id_col="vec_id", vector_col="embedding")
    return hits.select("vec_id", F.round("score", 5).alias("score"))


@query("vector_topk_min_score", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 5) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {_Q}) >= 0.3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 100")
def vector_topk_min_score(spark: SparkSession, d: str) -> DataFrame:
    hits = search.exact_topk(table(spark, d, "embeddings"), _query_vector(spark, d), SearchOptions(limit=100, min_score=0.3), "vec_id", "embedding")
    return hits.select("vec_id", F.round("score", 5).alias("score"))


@query("vector_topk_filtered", f"SELECT id, round(s, 5) AS score FROM (SELECT id, {_ECOS} AS s FROM entries WHERE {_FIT} AND contains(document.url, '{SOURCE}') AND document.metadata.content_type = 'Documentation') ORDER BY s DESC, id LIMIT 20")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    options = SearchOptions(limit=20, source_filter=SOURCE, content_type=search.named_content_type("documentation"))
    return search.exact_topk(flat_entries(spark, d), _entry_vector(spark, d), options).select("id", F.round("score", 5).alias("score"))


@query("vector_scores", f"SELECT id, round({_ECOS}, 5) AS score FROM entries WHERE {_FIT}")
def vector_scores(spark: SparkSession, d: str) -> DataFrame:
    return search.scored(flat_entries(spark, d), _entry_vector(spark, d), "id", "vector").select("id", F.round("score", 5).alias("score"))


@query("vector_topk_batch", "SELECT query_id, vec_id, round(s, 5) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10")
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.batch_topk(e, q, 10, "vec_id", "embedding").select("query_id", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


@query("l2_topk", f"SELECT vec_id, round(1 / (1 + s), 5) AS score FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], {_Q}) ** 2 AS s FROM embeddings) ORDER BY s, vec_id LIMIT 10")
def l2_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = search.exact_topk(table(spark, d, "embeddings"), _query_vector(spark, d), id_col="vec_id", vector_col="embedding", metric="l2")
    return hits.select("vec_id", F.round("score", 5).alias("score"))


@query("vector_distances", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}), 5) AS cosine_distance, round(list_distance(embedding::DOUBLE[], {_Q}) ** 2, 4) AS squared_l2 FROM embeddings")
def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    e, q = F.col("embedding"), V.literal(_query_vector(spark, d))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.cosine_distance(e, q), 5).alias("cosine_distance"), F.round(V.squared_l2(e, q), 4).alias("squared_l2"))


@query("vector_normalize", "SELECT vec_id, round(embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first, round(embedding[64] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS last, 1.0::DOUBLE AS norm FROM embeddings")
def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = V.normalize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(n[0], 5).alias("first"), F.round(n[63], 5).alias("last"), F.round(V.norm(n), 5).alias("norm"))


@query("vector_dimensions", "SELECT len(vector) AS dimension, count(*) AS entries FROM entries GROUP BY 1")
def vector_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries").groupBy(V.dimension(F.col("vector")).alias("dimension")).agg(F.count(F.lit(1)).alias("entries"))


@query("result_projection", f"SELECT id, score, left(c, 100) AS content, content_type FROM (SELECT id, round({_ECOS}, 5) AS score, {_ECOS} AS s, document.content AS c, document.metadata.content_type AS content_type FROM entries WHERE {_FIT} AND contains(document.url, '{SOURCE}') QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at) = 1) ORDER BY s DESC, id LIMIT 5")
def result_projection(spark: SparkSession, d: str) -> DataFrame:
    e = dedup.first_of_each(flat_entries(spark, d), F.col("id"), ["id", "indexed_at"])
    hits = search.exact_topk(e, _entry_vector(spark, d), SearchOptions(limit=5, source_filter=SOURCE))
    rows = search.result_rows(search.with_documents(hits, e))
    return rows.select("id", F.round("score", 5).alias("score"), F.substring("content", 1, 100).alias("content"), F.get_json_object("metadata", "$.content_type").alias("content_type"))


_CUR = "(SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) = 1)"


@query("search_docs_entries", f"SELECT id, score, left(c, 100) AS content FROM (SELECT id, round({_ECOS}, 5) AS score, {_ECOS} AS s, document.content AS c FROM {_CUR} WHERE {_FIT} ORDER BY s DESC, id LIMIT 10)")
def search_docs_entries(spark: SparkSession, d: str) -> DataFrame:
    """The search tool's rows over entries as they were delivered, some of them twice."""
    e = dedup.current(flat_entries(spark, d))
    rows = search.with_documents(search.exact_topk(e, _entry_vector(spark, d), SearchOptions(limit=10)), e)
    return rows.select("id", F.round("score", 5).alias("score"), F.substring("content", 1, 100).alias("content"))


# keywords

_EDGE = r"(?:[^\p{L}\p{M}\p{N}]|\p{Inherited})+"
_TOK = f"list_filter(list_transform(regexp_split_to_array(lower(text), '{_WS}+'), lambda t: regexp_replace(t, '^{_EDGE}|{_EDGE}$', '', 'g')), lambda t: t <> '')"
_BM = f"""WITH docs AS (SELECT doc_id AS id, coalesce({_TOK}, []) AS tokens FROM documents), lens AS (SELECT id, len(tokens) AS dl FROM docs),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM docs) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens), q AS (SELECT unnest(['snapshot','registry','callback','snapshot']) AS term),
scores AS (SELECT id, sum(ln(@one@(n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM q JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (id), corpus GROUP BY id HAVING s > 0)
"""


def _docs_index(spark: SparkSession, d: str) -> bm25.Bm25Index:
    return bm25.build_index(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query("bm25_kept", _BM + "SELECT id, round(s, 5) AS score FROM scores ORDER BY s DESC, id LIMIT 20")
def bm25_kept(spark: SparkSession, d: str) -> DataFrame:
    """The same by an index that is stored and read again: postings by term."""
    index = bm25.keep(spread(table(spark, d, "documents").select("doc_id", "text")), f"{scratch(spark)}/bm25", "doc_id", "text")
    return bm25.keyword_topk(index, WORDS, 20).select("id", F.round("score", 5).alias("score"))


@query("tokenize_counts", f"SELECT doc_id, len(coalesce({_TOK}, [])) AS tokens, len(list_distinct(coalesce({_TOK}, []))) AS terms FROM documents")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce(X.tokenize(F.col("text")), F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("terms"))


@query("term_frequencies", _BM + "SELECT id, term, tf FROM post")
def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _docs_index(spark, d).postings


@query("document_frequencies", _BM + "SELECT term, df FROM dfs")
def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _docs_index(spark, d).terms


@query("document_lengths", _BM + "SELECT id, dl FROM lens")
def document_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _docs_index(spark, d).lengths


@query("bm25_stats", _BM + "SELECT n AS doc_count, (SELECT count(*) FROM dfs) AS term_count, round(avgdl, 5) AS avg_doc_length FROM corpus")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.index_stats(_docs_index(spark, d)).withColumn("avg_doc_length", F.round("avg_doc_length", 5))


@query("bm25_scores", _BM + "SELECT id, round(s, 5) AS score FROM scores")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return bm25.keyword_scores(_docs_index(spark, d), WORDS).select("id", F.round("score", 5).alias("score"))


@query("bm25_topk", _BM + "SELECT id, round(s, 5) AS score FROM scores ORDER BY s DESC, id LIMIT 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.keyword_topk(_docs_index(spark, d), WORDS, 20).select("id", F.round("score", 5).alias("score"))


@query("bm25_topk_plus_one", _BM.replace("@one@", "1 + ") + "SELECT id, round(s, 5) AS score FROM scores ORDER BY s DESC, id LIMIT 20")
def bm25_topk_plus_one(spark: SparkSession, d: str) -> DataFrame:
    return bm25.keyword_topk(_docs_index(spark, d), WORDS, 20, Bm25Params(idf_plus_one=True)).select("id", F.round("score", 5).alias("score"))


# hybrid: documents and embeddings by number


def _both(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "url", "content_type")
    return docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")


_HY = _BM.replace("FROM documents)", "FROM documents JOIN embeddings ON doc_id = vec_id)") + f""", v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS v FROM embeddings JOIN documents ON doc_id = vec_id ORDER BY v DESC, id LIMIT 30),
w AS (SELECT id, least(s / (1 + s), 1) AS w FROM scores ORDER BY s DESC, id LIMIT 30),
f AS (SELECT id, coalesce(v, 0) AS v, coalesce(w, 0) AS w, 0.7 * coalesce(v, 0) + 0.3 * coalesce(w, 0) AS c FROM v FULL JOIN w USING (id))
"""
_HOUT = "SELECT id, round(v, 5) AS vector_score, round(w, 5) AS keyword_score, round(c, 5) AS combined_score FROM "


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", *(F.round(c, 5).alias(c) for c in ("vector_score", "keyword_score", "combined_score")))


def _hybrid(spark: SparkSession, d: str, options: HybridOptions) -> DataFrame:
    return _rounded(hybrid.hybrid_topk(_both(spark, d), _query_vector(spark, d), WORDS, options))


@query("hybrid_topk", _HY + _HOUT + "f ORDER BY c DESC, id LIMIT 10")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, HybridOptions())


@query("hybrid_compat", _HY + _HOUT + "(SELECT *, row_number() OVER (ORDER BY c DESC, id) AS r, greatest(count(*) OVER () - 20, 0) AS first FROM f) WHERE r > first AND r <= first + 10")
def hybrid_compat(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, HybridOptions(compat_heap=True))


@query("hybrid_disabled", _HY + "SELECT id, round(v, 5) AS vector_score, 0.0::DOUBLE AS keyword_score, round(v, 5) AS combined_score FROM v ORDER BY v DESC, id LIMIT 10")
def hybrid_disabled(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, HybridOptions(enabled=False))


@query("service_search", _HY + _HOUT + "(SELECT * FROM f WHERE id IN (SELECT id FROM v WHERE v >= 0.1) OR c >= 0.1) ORDER BY c DESC, id LIMIT 10")
def service_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, HybridOptions(base=SearchOptions(min_score=0.1)))


_HE = (
    _HY.replace("SELECT doc_id AS id, coalesce(", "SELECT id, coalesce(").replace("FROM documents JOIN embeddings ON doc_id = vec_id)", "FROM (SELECT id, document.content AS text FROM cur))")
    .replace(f"SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS v FROM embeddings JOIN documents ON doc_id = vec_id ORDER BY", f"SELECT id, {_ECOS} AS v FROM cur WHERE {_FIT} ORDER BY")
    .replace("WITH docs", f"WITH cur AS {_CUR}, docs", 1)
)


@query("service_search_entries", _HE + _HOUT + "(SELECT * FROM f WHERE id IN (SELECT id FROM v WHERE v >= 0.1) OR c >= 0.1) ORDER BY c DESC, id LIMIT 10")
def service_search_entries(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search over entries as they were delivered."""
    e = dedup.current(flat_entries(spark, d))
    return _rounded(hybrid.hybrid_topk(e, _entry_vector(spark, d), WORDS, HybridOptions(base=SearchOptions(min_score=0.1))))


# catalogue and lifecycle

_LOCAL = "CASE WHEN coalesce(document.url, '') = '' THEN 'local' ELSE document.url END"
_OLD = "coalesce(document.metadata.last_updated, indexed_at) > TIMESTAMP '2025-06-01' - INTERVAL 180 DAY"


@query("list_sources", f"SELECT {_LOCAL} AS source, count(*) AS documents FROM entries GROUP BY 1")
def list_sources(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.list_sources(flat_entries(spark, d))


@query("list_total", f"SELECT count(*) AS total_documents, count(DISTINCT {_LOCAL}) AS sources FROM entries")
def list_total(spark: SparkSession, d: str) -> DataFrame:
    return list_sources(spark, d).agg(F.sum("documents").alias("total_documents"), F.count(F.lit(1)).alias("sources"))


@query("documents_by_source", f"SELECT {_LOCAL} AS source, id FROM entries")
def documents_by_source(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.documents_by_source(flat_entries(spark, d))


@query("expire_keep", f"SELECT id FROM entries WHERE {_OLD}")
def expire_keep(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.expire(flat_entries(spark, d), NOW, 180).select("id")


@query("expire_dry_run", f"SELECT count(*) FILTER (NOT coalesce({_OLD}, false)) AS would_remove, count(*) FILTER (coalesce({_OLD}, false)) AS would_remain FROM entries")
def expire_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.dry_run(flat_entries(spark, d), ~lifecycle.is_fresh(NOW, 180))


@query("delete_source", "SELECT id FROM entries WHERE coalesce(document.url, '') <> ''")
def delete_source(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.delete_source(flat_entries(spark, d), "local").select("id")


@query("delete_dry_run", "SELECT count(*) FILTER (coalesce(document.url, '') = '') AS would_remove, count(*) FILTER (coalesce(document.url, '') <> '') AS would_remain FROM entries")
def delete_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.dry_run(flat_entries(spark, d), lifecycle.is_source("local"))


@query("delete_id", "SELECT id FROM entries WHERE id <> 'e000000003'")
def delete_id(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.delete_id(flat_entries(spark, d), "e000000003").select("id")


# quantisation

_BOUNDS = "SELECT i - 1 AS dim, min(x)::DOUBLE AS low, CASE WHEN max(x)::DOUBLE - min(x) < 1e-6 THEN max(x)::DOUBLE + 1e-5 ELSE max(x)::DOUBLE END AS high FROM (SELECT unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i"


@query("quantizer_fit", f"SELECT dim, round(low, 6) AS low, round(high, 6) AS high FROM ({_BOUNDS})")
def quantizer_fit(spark: SparkSession, d: str) -> DataFrame:
    return quantizer.bounds(table(spark, d, "embeddings"), "embedding").select("dim", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_CODES = f"SELECT vec_id, dim, x, low, high, least(255, greatest(0, round((x::DOUBLE - low) / (high - low) * 255)))::INTEGER AS code FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS dim FROM embeddings) JOIN ({_BOUNDS}) USING (dim)"


@query("quantize_codes", f"SELECT vec_id, dim, code FROM ({_CODES})")
def quantize_codes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = quantizer.Quantizer().fit(e, "embedding")
    return e.select("vec_id", F.posexplode(q.encode(F.col("embedding"))).alias("dim", "code")).select("vec_id", F.col("dim").cast("long").alias("dim"), "code")


@query("dequantize_error", f"SELECT vec_id, round(max(abs(code / 255.0::DOUBLE * (high - low) + low - x::DOUBLE)), 6) AS error FROM ({_CODES}) GROUP BY 1")
def dequantize_error(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = quantizer.Quantizer().fit(e, "embedding")
    back = q.decode(q.encode(F.col("embedding")))
    worst = F.array_max(F.zip_with(back, "embedding", lambda a, b: F.abs(a - b.cast("double"))))
    return e.select("vec_id", F.round(worst, 6).alias("error"))


@query("raw_codec", "SELECT vec_id, 4 * len(embedding) AS bytes, round(list_sum(embedding::DOUBLE[]), 5) AS total, round(embedding[7]::DOUBLE, 6) AS seventh FROM embeddings")
def raw_codec(spark: SparkSession, d: str) -> DataFrame:
    raw = V.to_bytes(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.octet_length(raw).alias("bytes"), V.from_bytes(raw).alias("v")).select("vec_id", "bytes", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"), F.round(F.col("v")[6].cast("double"), 6).alias("seventh"))


@query("quantized_topk", f"""WITH r AS (SELECT vec_id, list(code / 255.0::DOUBLE * (high - low) + low ORDER BY dim) AS v FROM ({_CODES}) GROUP BY 1), k AS (SELECT vec_id FROM r ORDER BY list_cosine_similarity(v, {_Q}) DESC, vec_id LIMIT 40)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 5) AS score FROM embeddings WHERE vec_id IN (FROM k) ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10""")
def quantized_topk(spark: SparkSession, d: str) -> DataFrame:
    """Search on decoded codes, an extension: the best 40 by codes, ranked anew on the vectors."""
    e, q = table(spark, d, "embeddings"), _query_vector(spark, d)
    codec = quantizer.Quantizer().fit(e, "embedding")
    rough = search.exact_topk(e.select("vec_id", codec.decode(codec.encode(F.col("embedding"))).alias("v")), q, SearchOptions(limit=40), "vec_id", "v")
    best = search.exact_topk(e.join(F.broadcast(rough.select("vec_id")), "vec_id", "left_semi"), q, id_col="vec_id", vector_col="embedding")
    return best.select("vec_id", F.round("score", 5).alias("score"))


# texts

_PUNCT = r"[!-/:-@\[-`{-~]"
_T = _trim("content")
_LET = r"length(regexp_replace(t, '[^\p{L}]', '', 'g'))"
_LN = "string_split(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), chr(10) || '$', ''), chr(10))"
_QUAL = f"(strlen(t) >= 100 AND {_LET} >= strlen(t) // 3 AND NOT (" + " OR ".join(f"contains(lower(t), '{m}')" for m in X.NAVIGATION) + rf") AND length(t) - length(regexp_replace(t, '{_PUNCT}', '', 'g')) <= {_LET} AND NOT (len({_LN}) > 1 AND len(list_distinct({_LN})) < len({_LN}) // 2))"


@query("quality_filter", f"SELECT chunk_id, {_QUAL} AS quality FROM (SELECT chunk_id, {_T} AS t FROM chunks)")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks").select("chunk_id", "content")).select("chunk_id", X.is_quality(F.col("content")).alias("quality"))


@query(
    "text_flags",
    "SELECT chunk_id, strlen(content) // 4 AS tokens, "
    + "(" + " OR ".join(f"contains(content, '{m}')" if m != "\t" else "contains(content, chr(9))" for m in X.CODE_MARKS) + ") AS code, "
    + f"(contains(t, '```') OR contains(t, '    ') OR contains(t, chr(9))) AS plain_code, nullif(" + _trim("regexp_extract(content, '(?m)^#{1,3}\\s+(.+)$', 1)") + ", '') AS heading, "
    + "(suffix(content, ':') OR suffix(content, 'following') OR suffix(content, 'example') OR suffix(content, 'see') OR contains(content, 'continued') OR contains(content, 'next section')) AS needs_next "
    + f"FROM (SELECT chunk_id, content, {_T} AS t FROM chunks)",
)
def text_flags(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return table(spark, d, "chunks").select("chunk_id", X.estimate_tokens(c).alias("tokens"), X.contains_code(c).alias("code"), X.has_code(c).alias("plain_code"), X.first_heading(c).alias("heading"), X.needs_next(c).alias("needs_next"))


@query(
    "heading_levels",
    f"SELECT level, count(*) AS lines FROM (SELECT CASE WHEN regexp_matches(l, '^#{{1,6}} ') THEN length(regexp_extract(l, '^(#{{1,6}}) ', 1)) WHEN regexp_matches(l, '^[=-]{{3,}}$') THEN CASE WHEN contains(l, '=') THEN 1 ELSE 2 END ELSE 0 END AS level FROM (SELECT {_trim('l')} AS l FROM (SELECT unnest(string_split(markdown, chr(10))) AS l FROM extracted))) GROUP BY 1",
)
def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "extracted").select(F.explode(F.split("markdown", "\n", -1)).alias("l"))
    return lines.groupBy(X.heading_level(X.trim(F.col("l"))).alias("level")).agg(F.count(F.lit(1)).alias("lines"))


@query("dedup_exact", f"SELECT min(chunk_id) AS chunk_id, count(*) AS copies FROM chunks WHERE content IS NOT NULL GROUP BY {_T}")
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").filter("content IS NOT NULL").groupBy(X.content_hash(F.col("content")).alias("h"))
    return rows.agg(F.min("chunk_id").alias("chunk_id"), F.count(F.lit(1)).alias("copies")).drop("h")


_NORM = f"regexp_replace(lower({_T}), '{_WS}+', ' ', 'g')"


@query("dedup_normalised", f"SELECT chunk_id, source FROM chunks WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_NORM} ORDER BY chunk_id) = 1")
def dedup_normalised(spark: SparkSession, d: str) -> DataFrame:
    c = spread(table(spark, d, "chunks").select("chunk_id", "source", "content"))
    return dedup.first_of_each(c, X.normalized_hash(F.col("content")), ["chunk_id"]).select("chunk_id", "source")


@query("dedup_seeded", f"SELECT chunk_id FROM chunks WHERE content IS NOT NULL AND {_NORM} NOT IN (SELECT {_NORM} FROM chunks WHERE content IS NOT NULL AND strategy = 'Crawl') QUALIFY row_number() OVER (PARTITION BY {_NORM} ORDER BY chunk_id) = 1")
def dedup_seeded(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "strategy", "content")
    key = X.normalized_hash(F.col("content"))
    seen = c.filter("strategy = 'Crawl' AND content IS NOT NULL").select(key.alias("hash")).distinct()
    return dedup.unseen(c, key, seen, ["chunk_id"]).select("chunk_id")


def _case_sql(groups: tuple, column: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({column}), '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in groups) + " END"


@query("detect_url_language", f"SELECT page_id, {_case_sql(X.URL_LANGUAGES, 'url')} AS language FROM crawl_results")
def detect_url_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_results").select("page_id", X.url_language(F.col("url")).alias("language"))


@query("detect_framework", "SELECT page_id, CASE " + " ".join(f"WHEN contains(lower(coalesce(url, '')), '{u}')" + (f" OR contains(lower(coalesce(markdown, '')), '{t}')" if t else "") + f" THEN '{n}'" for n, u, t in X.FRAMEWORKS) + " END AS framework FROM extracted")
def detect_framework(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted").select("page_id", X.framework(F.col("url"), F.col("markdown")).alias("framework"))


@query("code_blocks", "SELECT page_id, b.language AS tagged, CASE " + " ".join("WHEN " + " OR ".join("(" + " AND ".join(f"contains(lower(b.code), '{p}')" for p in g) + ")" for g in groups) + f" THEN '{name}'" for name, groups in X.CODE_LANGUAGES) + " END AS detected, length(b.code) AS size FROM (SELECT page_id, unnest(code_blocks) AS b FROM extracted)")
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "extracted").select("page_id", F.explode("code_blocks").alias("b"))
    return b.select("page_id", F.col("b.language").alias("tagged"), X.code_language(F.col("b.code")).alias("detected"), F.length("b.code").alias("size"))


@query(
    "clean_markdown",
    rf"""WITH l AS (SELECT page_id, list_transform(string_split(regexp_replace(replace(regexp_replace(markdown, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)), lambda x: struct_pack(raw := x, t := {_trim('x')})) AS lines FROM extracted WHERE markdown IS NOT NULL),
k AS (SELECT page_id, list_filter(lines, lambda x: (strlen(x.t) >= 3 AND NOT (({" OR ".join(f"contains(lower(x.t), '{m}')" for m in X.NAVIGATION_LINES)}) AND strlen(x.t) < 50)
AND (length(regexp_replace(x.t, '[^\p{{L}}]', '', 'g')) > length(x.t) - length(regexp_replace(x.t, '{_PUNCT}', '', 'g')) OR contains(x.t, 'def ') OR contains(x.t, 'function') OR contains(x.t, 'class ')))
OR x.t = '' OR regexp_matches(x.raw, '^(```|~~~)[A-Za-z0-9+#-]*$') OR regexp_matches(x.t, '^(```|~~~)[A-Za-z0-9+#-]*$')) AS lines FROM l),
j AS (SELECT page_id, {_trim("regexp_replace(regexp_replace(array_to_string(list_transform(lines, lambda x: x.raw), chr(10)), '``` {1,2}' || chr(10), '```' || chr(10), 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS text FROM k)
SELECT page_id, md5(text) AS digest FROM j""",
)
def clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "extracted").select("page_id", "markdown")).filter("markdown IS NOT NULL")
    return rows.select("page_id", F.md5(X.clean_markdown(F.col("markdown"))).alias("digest"))


# chunks


@query("split_headers", r"SELECT id, sum(len(regexp_extract_all(document.content, '(?m)^#{1,3}\s+.+$'))) AS headings FROM entries WHERE document.content IS NOT NULL GROUP BY id HAVING sum(len(regexp_extract_all(document.content, '(?m)^#{1,3}\s+.+$'))) > 0")
def split_headers(spark: SparkSession, d: str) -> DataFrame:
    parts = flat_entries(spark, d).select("id", F.explode(X.split_headers(F.col("content"))).alias("part"))
    headed = parts.filter(F.col("part").rlike(r"^#{1,3}\s+.+"))
    return headed.groupBy("id").agg(F.count(F.lit(1)).alias("headings"))


@query("split_paragraphs", f"SELECT id, unnest(range(0, len(p))) AS n, unnest(list_transform(p, lambda x: md5(x))) AS digest FROM (SELECT id, list_filter(string_split(document.content, chr(10) || chr(10)), lambda x: {_trim('x')} <> '') AS p FROM entries)")
def split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    parts = flat_entries(spark, d).select("id", F.posexplode(X.split_paragraphs(F.col("content"))).alias("n", "part"))
    return parts.select("id", F.col("n").cast("long").alias("n"), F.md5("part").alias("digest"))


@query("chunk_tags", "SELECT chunk_id, [CASE WHEN has_code THEN 'has-code' ELSE 'no-code' END, 'chunk-' || row_number() OVER w || '-of-' || count(*) OVER (PARTITION BY entry_id)] AS tags, source || '_chunk_' || (row_number() OVER w - 1) AS name FROM chunks WINDOW w AS (PARTITION BY entry_id ORDER BY position, chunk_id)")
def chunk_tags(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("entry_id")
    n = F.row_number().over(by.orderBy("position", "chunk_id")) - 1
    return table(spark, d, "chunks").select("chunk_id", X.chunk_tags(F.col("has_code"), n, F.count(F.lit(1)).over(by)).alias("tags"), X.chunk_id(F.col("source"), n).alias("name"))


_LINES = "string_split(regexp_replace(replace({c}, chr(13) || chr(10), chr(10)), chr(10) || '$', ''), chr(10))"
_BEF = _LINES.format(c="before")
_AFT = _LINES.format(c="after")


@query(
    "overlap_lag_lead",
    f"""WITH s AS (SELECT chunk_id, content, lag(content) OVER w AS before, lead(content) OVER w AS after FROM chunks WHERE content IS NOT NULL WINDOW w AS (PARTITION BY entry_id ORDER BY chunk_id)),
p AS (SELECT chunk_id, content, {_trim(f"array_to_string(list_slice({_BEF}, greatest(len({_BEF}) - 19, 1), len({_BEF})), chr(10))")} AS tail, {_trim(f"array_to_string(list_slice({_AFT}, 1, 3), chr(10))")} AS head FROM s)
SELECT chunk_id, md5(CASE WHEN strlen(tail) > 20 AND regexp_replace(tail, '{_PUNCT}|{_WS}', '', 'g') <> '' THEN '...' || tail || chr(10) || chr(10) ELSE '' END || content || CASE WHEN strlen(head) > 20 AND (suffix(content, ':') OR suffix(content, 'following') OR suffix(content, 'example') OR suffix(content, 'see') OR contains(content, 'continued') OR contains(content, 'next section')) THEN chr(10) || chr(10) || head || '...' ELSE '' END) AS digest FROM p""",
)
def overlap_lag_lead(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").filter("content IS NOT NULL").select("chunk_id", "entry_id", "content")
    return chunking.with_overlap(c, "entry_id", "chunk_id").select("chunk_id", F.md5("content").alias("digest"))


def _chunked(strategy) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = dedup.first_of_each(flat_entries(spark, d).select("id", "indexed_at", "content"), F.col("id"), ["id", "indexed_at"]).repartition("id")
        return chunking.chunk(e, strategy)

    return run


query("chunk_fixed")(_chunked(FixedSize()))
query("chunk_paragraphs")(_chunked(Semantic(1300, 120)))
query("chunk_headings")(_chunked(HeadingBased(1800, 200)))
query("chunk_crawl")(_chunked(CrawlChunks()))


# pages


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of the extracted texts: a title, meta tags, a menu, the text line by line, code, links to other pages."""
    e = spread(table(spark, d, "extracted")).filter("url IS NOT NULL AND markdown IS NOT NULL")

    def esc(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    text = F.concat(F.lit("<p>"), F.array_join(F.split(esc(F.col("markdown")), "\n\n"), "</p><p>"), F.lit("</p>"))
    code = F.array_join(F.transform(F.coalesce("code_blocks", F.array().cast("array<struct<code:string,language:string,context:string,usage_example:boolean,api_reference:boolean>>")), lambda b: F.concat(F.lit('<pre><code class="language-'), F.coalesce(b["language"], F.lit("text")), F.lit('">'), esc(b["code"]), F.lit("</code></pre>"))), "")
    head = F.concat(F.lit("<head><title>"), esc(F.coalesce("title", F.lit(""))), F.lit('</title><meta name="author" content="'), F.coalesce(F.col("metadata.author"), F.lit("")), F.lit('"></head>'))
    nav = F.concat(F.lit('<nav><a href="/docs/next/p-'), (F.col("page_id") + 1).cast("string"), F.lit('">next</a></nav>'))
    return e.select("page_id", "url", "title", F.concat(F.lit("<html>"), head, F.lit("<body>"), nav, F.lit("<main>"), text, code, F.lit("</main><footer>end</footer></body></html>")).alias("html"))


@query("extract_titles", f"SELECT page_id, CASE WHEN {_trim('title')} = '' OR title IS NULL THEN 'Untitled Document' ELSE {_trim('title')} END AS title FROM extracted WHERE url IS NOT NULL AND markdown IS NOT NULL")
def extract_titles(spark: SparkSession, d: str) -> DataFrame:
    return html_pages(spark, d).select("page_id", extract_page(F.col("html"), F.col("url"))["title"].alias("title"))


@query("extract_pages")
def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    p = html_pages(spark, d).select("page_id", extract_page(F.col("html"), F.col("url")).alias("p"))
    return p.select("page_id", F.col("p.title").alias("title"), F.length("p.markdown").alias("size"), F.size("p.code_blocks").alias("blocks"), F.col("p.metadata.author").alias("author"), F.size("p.links").alias("links"))


_P = UrlPatterns()


@query("url_admission", "SELECT doc_id, coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) <> '' AND NOT (" + " OR ".join(f"contains(url, '{p}')" for p in _P.exclude) + ") AND (" + " OR ".join(f"contains(url, '{p}')" for p in _P.include) + "), false) AS admitted, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host FROM documents")
def url_admission(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "documents").select("doc_id", pages.admitted(u).alias("admitted"), pages.host(u).alias("host"))


@query("crawl_bfs", f"""WITH RECURSIVE p AS (SELECT page_id AS n, {_trim("coalesce(title, '')")} AS title FROM extracted),
c AS (SELECT n, 0 AS depth FROM p WHERE n = 0 UNION ALL SELECT p.n, depth + 1 FROM c JOIN p ON p.n = 2 * c.n + 1 OR p.n = 2 * c.n + 2)
SELECT 'https://site.example/docs/p-' || n AS url, depth, CASE WHEN title = '' THEN 'Untitled Document' ELSE title END AS title FROM c JOIN p USING (n)""")
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first over pages that link to the one and the two next on one host."""
    n = F.col("page_id")

    def link(to):
        return F.concat(F.lit('<a href="/docs/p-'), to.cast("string"), F.lit('">x</a>'))

    source = table(spark, d, "extracted").select(F.concat(F.lit("https://site.example/docs/p-"), n.cast("string")).alias("url"), F.concat(F.lit("<main><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1>"), link(n * 2 + 1), link(n * 2 + 2), F.lit("</main>")).alias("html"))
    last, n_pages = table(spark, d, "extracted").agg(F.max("page_id"), F.count(F.lit(1))).first()
    depth = ((last or 0) + 1).bit_length()  # page n is floor(log2(n + 1)) links from the first
    found, _ = pages.crawl(source, CrawlConfig("https://site.example/docs/p-0", CrawlMode.FULL, max_depth=depth, max_pages=max(1, n_pages), allowed_domains=frozenset({"site.example"})))
    return found.select("url", "depth", F.col("page.title").alias("title"))


@query("index_documents")
def index_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages to entries: extract, chunk, tag, embed."""
    p = dealt(html_pages(spark, d), "url").dropDuplicates(["url"]).select("url", extract_page(F.col("html"), F.col("url")).alias("page"))
    e = pages.documents_of(p, now=NOW)
    return e.select("id", F.col("document.url").alias("url"), F.col("document.metadata.tags").alias("tags"), F.size("vector").alias("dimension"))


# approximate search


def _index(spark: SparkSession, d: str) -> ann.AnnIndex:
    return ann.build(table(spark, d, "embeddings"), AnnParams(rows_per_cell=100, probes=4), "vec_id", "embedding")


#: Share of the cells that a query of ann_topk, and a row of ann_graph, looks into: the vectors of this table lie in no clusters, so a fixed
#: number of cells would find ever less of it as it grows.
PROBE_SHARE = 0.8


def _probes(index: ann.AnnIndex) -> int:
    return max(index.params.probes, math.ceil(PROBE_SHARE * len(index.centres)))


@query("ann_topk")
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    q = table(spark, d, "embeddings").filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = index.topk_batch(q, 10, _probes(index))
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


@query("ann_entries_stats", f"SELECT count(*) AS node_count, 64 AS dimension FROM {_CUR} WHERE {_FIT} AND len(vector) = 64")
def ann_entries_stats(spark: SparkSession, d: str) -> DataFrame:
    """Size of an index over entries as they were delivered: an id is one node."""
    v = F.col("vector")
    e = dedup.current(flat_entries(spark, d)).filter((F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    return ann.build(e, AnnParams(rows_per_cell=100)).stats().select("node_count", "dimension")


@query("ann_stats")
def ann_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).stats()


@query("ann_graph")
def ann_graph(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return index.neighbour_graph(probes=_probes(index))


@query("ann_degrees")
def ann_degrees(spark: SparkSession, d: str) -> DataFrame:
    return ann.degree_stats(ann_graph(spark, d))
