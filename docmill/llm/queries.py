"""The pN_ queries of the training-text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.plans.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from docmill.llm.encode import encode

    return encode(_documents(spark, d))


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    from docmill.llm.encode import token_spans

    return token_spans(_documents(spark, d))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    from docmill.llm.encode import decode, encode

    return encode(_documents(spark, d)).select("doc_id", decode(F.col("ids")).alias("text"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """entries with the fields of ``document`` that the operators read; later delivery in ``indexed_at``."""
    return table(spark, d, "entries").select("id", "indexed_at", "vector", F.col("document.content").alias("content"), F.col("document.url").alias("url"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks").select("chunk_id", "strategy", "content", "heading_context"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from docmill.llm.split import split_oversized

    return split_oversized(_chunks(spark, d), table(spark, d, "chunk_limits"), "greedy")


def p1_balanced(spark: SparkSession, d: str) -> DataFrame:
    from docmill.llm.split import split_oversized

    return split_oversized(_chunks(spark, d), table(spark, d, "chunk_limits"), "balanced", context_col="heading_context", with_text=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts (by the smallest id of exact copies), and each copy with that id."""
    found = _near(spark, d)
    copies = found.members.filter("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    return found.pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).unionByName(copies)


def _near(spark: SparkSession, d: str):
    from docmill.llm.neardup import near_duplicates

    return near_duplicates(spread(_entries(spark, d).select("id", "content")), "id", "content", threshold=0.6, shingle=3, min_words=30)


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each entry: its class of exact copies and the number of other classes it is similar to."""
    found = _near(spark, d)
    links = found.pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return found.members.join(links, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _lines(spark: SparkSession, d: str):
    from docmill.llm.lines import SourceLines, host_of

    e = spread(_entries(spark, d).drop("vector"))
    return SourceLines(e, "id", "content", host_of(F.col("url")), "indexed_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).places()


def p4_sequences(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).sequences()


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).cleaned().select("id", F.md5("text").alias("digest"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from docmill.llm.leakage import contained

    return contained(_documents(spark, d), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


def _host(col: str):
    from docmill.llm.lines import host_of

    return host_of(F.col(col))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "extracted").select("page_id", "url", "markdown"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from docmill.llm.boilerplate import frame_lines

    return frame_lines(_pages(spark, d), host=_host("url"))


def p3_body(spark: SparkSession, d: str) -> DataFrame:
    from docmill.llm.boilerplate import main_body

    return main_body(_pages(spark, d), host=_host("url"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from docmill.llm.quality import text_kinds

    return text_kinds(_documents(spark, d)).filter("kind <> 'prose'")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    from docmill.llm.quality import text_statistics

    return text_statistics(_documents(spark, d))


def p8_sketches(spark: SparkSession, d: str) -> DataFrame:
    from docmill.llm.quality import sketches, text_statistics

    return sketches(text_statistics(_documents(spark, d)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from docmill.llm.neighbours import nearest_neighbours

    near = nearest_neighbours(_entries(spark, d))
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


QUERIES: dict[str, Query] = {
    "p5_found": p5_found,
    "p3_found": p3_found,
    "p3_body": p3_body,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
    "p8_sketches": p8_sketches,
    "p1_found": p1_found,
    "p1_balanced": p1_balanced,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p4_found": p4_found,
    "p4_sequences": p4_sequences,
    "p4_cleaned": p4_cleaned,
    "p7_found": p7_found,
    "p6_ids": p6_ids,
    "p6_spans": p6_spans,
    "p6_decoded": p6_decoded,
}

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_WS = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_P4 = f"""WITH e AS (SELECT id, document.content AS c, regexp_replace(lower(regexp_extract(document.url, '://([^/:?#]*)', 1)), '^www\\.', '') AS host FROM entries QUALIFY row_number() OVER (PARTITION BY id) = 1),
h AS (SELECT host, count(*) AS docs FROM e WHERE host <> '' GROUP BY 1),
l AS (SELECT id, host, i AS line_no, lines[i] AS line, trim(regexp_replace(regexp_replace(lower(lines[i]), '[0-9]+', '0', 'g'), '{_WS}+', ' ', 'g')) AS key FROM (SELECT id, host, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT id, host, string_split(c, chr(10)) AS lines FROM e WHERE host <> ''))),
k AS (SELECT * FROM l WHERE len(regexp_extract_all(key, '[\\p{{L}}\\p{{N}}]+')) >= 3),
f AS (SELECT host, key, count(DISTINCT id) AS n FROM k GROUP BY 1, 2),
p AS (SELECT id, line_no FROM k JOIN f USING (host, key) JOIN h USING (host) WHERE n >= 4 AND n >= 0.05 * docs)
"""

#: Lines with their places, fences by a walk over their marks, boundaries by kind, and the cuts one after the other.
_P1 = f"""WITH RECURSIVE t AS (SELECT chunk_id, content, max_chars AS m, greatest(coalesce(overlap_chars, 0), 0) AS o, length(content) AS n FROM chunks JOIN chunk_limits USING (strategy) WHERE length(content) > max_chars),
lines AS (SELECT chunk_id, i, l, sum(length(l) + 1) OVER (PARTITION BY chunk_id ORDER BY i) - length(l) - 1 AS place, regexp_replace(l, '^{_WS}+', '') AS bare FROM (SELECT chunk_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS l FROM (SELECT chunk_id, string_split(content, chr(10)) AS s FROM t))),
fences AS (SELECT chunk_id, i, left(bare, 3) AS mark, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS k FROM lines WHERE left(bare, 3) IN ('```', '~~~')),
walk AS (SELECT chunk_id, i, k, mark AS open, true AS opens FROM fences WHERE k = 1
 UNION ALL SELECT f.chunk_id, f.i, f.k, CASE WHEN w.open IS NULL THEN f.mark WHEN w.open = f.mark THEN NULL ELSE w.open END, w.open IS NULL FROM walk w JOIN fences f ON f.chunk_id = w.chunk_id AND f.k = w.k + 1),
state AS (SELECT l.*, w.open AS after_it, coalesce(w.i = l.i AND w.opens, false) AS opens, coalesce(w.i = l.i, false) AS marked FROM lines l ASOF LEFT JOIN walk w ON l.chunk_id = w.chunk_id AND l.i >= w.i),
inside AS (SELECT chunk_id, i, l, place, bare, opens, (after_it IS NOT NULL OR marked) AS within_fence, (bare = '' ) AS blank, lag(bare = '') OVER (PARTITION BY chunk_id ORDER BY i) AS below_blank FROM state),
b AS (SELECT chunk_id, place AS p, 1 AS kind FROM inside WHERE (NOT within_fence OR opens) AND regexp_matches(l, '^#{{1,6}} ')
 UNION ALL SELECT chunk_id, place, 2 FROM inside WHERE (NOT within_fence OR opens) AND NOT blank AND below_blank
 UNION ALL SELECT chunk_id, place, 3 FROM inside WHERE NOT within_fence OR opens
 UNION ALL SELECT chunk_id, place + unnest(list_filter(range(1, length(l) + 1), lambda j: l[j] IN ('。', '！', '？') OR (j > 1 AND l[j] = ' ' AND l[j - 1] IN ('.', '!', '?')))), 4 FROM inside WHERE NOT within_fence
 UNION ALL SELECT chunk_id, place, 5 FROM inside WHERE within_fence AND NOT opens
 UNION ALL SELECT chunk_id, place + unnest(list_filter(range(1, length(l) + 1), lambda j: l[j] IN (' ', chr(9)))), 6 FROM lines
 UNION ALL SELECT chunk_id, place, 6 FROM lines WHERE i > 1),
g AS (SELECT t.chunk_id, m, o, n, c.pos FROM t JOIN (SELECT chunk_id, list({{'p': p, 'k': kind}} ORDER BY p) AS pos FROM b GROUP BY 1) c USING (chunk_id)),
cuts AS (SELECT chunk_id, 0::BIGINT AS s, NULL::BIGINT AS e, 0 AS step FROM g
 UNION ALL SELECT chunk_id, CASE WHEN step = 0 THEN 0 ELSE e - o END, e2, step + 1 FROM (
  SELECT c.chunk_id, c.step, c.e, g.o, CASE WHEN g.n - ss <= g.m THEN g.n ELSE coalesce((SELECT min_by(x.p, x.k * 1000000000::BIGINT - x.p) FROM (SELECT unnest(g.pos) AS x) WHERE x.p > ss + g.m // 2 AND x.p <= ss + g.m), ss + g.m) END AS e2
  FROM (SELECT *, CASE WHEN step = 0 THEN 0 ELSE e - (SELECT o FROM g WHERE g.chunk_id = cuts.chunk_id) END AS ss FROM cuts) c JOIN g USING (chunk_id) WHERE c.e IS NULL OR c.e < g.n))
SELECT chunk_id, s AS start_char, e AS end_char FROM cuts WHERE step > 0"""

ORACLES: dict[str, str] = {
    "p1_found": _P1,
    "p4_cleaned": _P4 + "SELECT id, md5(CASE WHEN c IS NULL THEN NULL ELSE coalesce((SELECT string_agg(line, chr(10) ORDER BY line_no) FROM l WHERE l.id = e.id AND NOT EXISTS (SELECT 1 FROM p WHERE p.id = l.id AND p.line_no = l.line_no)), '') END) AS digest FROM e WHERE host <> ''",
    "p5_found": """WITH e AS (SELECT id, vector::DOUBLE[] AS v FROM entries WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: isnan(x) OR x IS NULL)) = 0 AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0 QUALIFY row_number() OVER (PARTITION BY id) = 1),
k AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) <= 10)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM k""",
    "p2_found": f"""WITH e AS (SELECT id, {_WORDS.format("document.content")} AS w FROM entries WHERE document.content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id) = 1),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM e WHERE len(w) >= 30)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM s a JOIN s b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM c JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE shared >= 0.6 * (a.n + b.n - shared)""",
    "p4_found": _P4 + "FROM p",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_found": f"""WITH b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS run FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
r AS (SELECT DISTINCT doc_id, m, array_to_string(w[i:i + m - 1], ' ') AS run FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM q) WHERE len(w) >= m))
SELECT DISTINCT doc_id, item_id FROM r JOIN q USING (m, run)""",
}
