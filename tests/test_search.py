from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import ann, bm25, hybrid, search
from docmill.operators.dedup import current
from docmill.queries import QUERIES
from docmill.schema import AnnParams, Bm25Params, HybridOptions, SearchOptions


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("a", [1.0, 0.0], "https://x/a", "Documentation", "red apple tree"), ("b", [0.9, 0.1], "https://x/b", "Tutorial", "green apple"), ("c", [0.0, 1.0], "https://y/c", "Documentation", "blue sky"), ("d", [0.0, 0.0], None, None, None), ("e", None, "https://y/e", "Other", ""), ("f", [1.0], "https://y/f", "Other", "apple"), ("g", [float("nan"), 1.0], "https://y/g", "Other", "apple pie"), ("a2", [1.0, 0.0], "https://y/a2", "Other", "tie")]
    return spark.createDataFrame(rows, "id string, vector array<float>, url string, content_type string, content string").withColumn("score", F.lit("clash"))


def ids(df):
    return [r.id for r in df.collect()]


def test_topk(entries):
    assert ids(search.exact_topk(entries, [1.0, 0.0], SearchOptions(limit=3))) == ["a", "a2", "b"]
    assert ids(search.exact_topk(entries, [1.0, 0.0], SearchOptions(limit=0))) == []
    assert ids(search.exact_topk(entries, [1.0, 0.0], SearchOptions(min_score=0.5))) == ["a", "a2", "b"]
    assert ids(search.exact_topk(entries, [1.0, 0.0], SearchOptions(source_filter="//y", content_type="Documentation"))) == ["c"]
    assert ids(search.exact_topk(entries, [1.0, 0.0], SearchOptions(source_filter="[.*]"))) == []
    assert set(ids(search.exact_topk(entries, [1.0, 0.0], SearchOptions(limit=99)))) == {"a", "a2", "b", "c", "d", "f"}
    assert search.exact_topk(entries.limit(0), [1.0, 0.0]).count() == 0


def test_filters_reach_the_scan(entries, tmp_path):
    entries.drop("score").write.parquet(str(tmp_path / "e"))
    df = entries.sparkSession.read.parquet(str(tmp_path / "e"))
    plan = search.exact_topk(df, [1.0, 0.0], SearchOptions(source_filter="y", content_type="Other"))._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(url,y)" in plan and "EqualTo(content_type,Other)" in plan and "TakeOrderedAndProject" in plan
    assert "content:string" not in plan


def test_batch(entries, monkeypatch):
    q = entries.sparkSession.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 1.0]), ("q3", None)], "query_id string, vector array<float>")
    want = {("q1", "a", 1), ("q1", "a2", 2), ("q2", "c", 1), ("q2", "b", 2)}
    assert {(r.query_id, r.id, r["rank"]) for r in search.batch_topk(entries, q, 2).collect()} == want
    monkeypatch.setattr(search, "QUERY_BYTES", 10)
    assert {(r.query_id, r.id, r["rank"]) for r in search.batch_topk(entries, q, 2).collect()} == want
    assert search.batch_topk(entries, q.limit(0), 2).count() == 0
    own = entries.select(F.col("id").alias("query_id"), "vector").filter("query_id IN ('a', 'c')")
    assert {(r.query_id, r.id) for r in search.batch_topk(entries, own, 1, skip_self=True).collect()} == {("a", "a2"), ("c", "b")}


def test_results(entries):
    docs = entries.drop("score").withColumns({"language": F.lit("en"), "last_updated": F.lit(None).cast("timestamp"), "tags": F.array(F.lit("t"))})
    hits = search.exact_topk(docs, [1.0, 0.0], SearchOptions(limit=1))
    row = search.result_rows(search.with_documents(hits, docs)).first()
    assert row.id == "a" and row.content == "red apple tree" and '"content_type":"Documentation"' in row.metadata
    assert search.named_content_type("API") == "Reference" and search.named_content_type("nonsense") is None
    assert ids(search.point_lookup(docs, "c")) == ["c"]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "apple apple tree"), (2, "apple pie"), (3, "sky"), (4, None), (5, ""), (5, "apple"), (None, "apple")], "id long, content string")
    index = bm25.build_index(docs, distinct=True)
    stats = bm25.index_stats(index).first()
    assert (stats.doc_count, stats.term_count) == (5, 4) and stats.avg_doc_length == pytest.approx(6 / 5)
    got = {r.id: r.score for r in bm25.keyword_scores(index, "pie pie sky").collect()}
    idf = np.log((5 - 1 + 0.5) / 1.5)
    assert got[2] == pytest.approx(2 * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 1.2)))
    assert set(got) == {2, 3}
    assert bm25.keyword_scores(index, "apple").count() == 2  # idf is positive: 2 of 5
    assert bm25.keyword_scores(index, "").count() == 0
    common = spark.createDataFrame([(i, "apple") for i in range(5)], "id long, content string")
    assert bm25.keyword_topk(bm25.build_index(common), "apple", 3).count() == 0  # never above 0
    assert bm25.keyword_topk(bm25.build_index(common), "apple", 3, Bm25Params(idf_plus_one=True)).count() == 3
    empty = bm25.build_index(docs.limit(0))
    assert bm25.keyword_scores(empty, "apple").count() == 0 and bm25.index_stats(empty).first().doc_count == 0


def test_hybrid(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), f"word{i % 7} text", f"https://h/{i % 2}", "Other") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, content string, url string, content_type string")
    query = rng.normal(size=4).tolist()
    base = SearchOptions(limit=4)
    all_hits = hybrid.hybrid_topk(df, query, "word3", HybridOptions(base=SearchOptions(limit=20))).collect()
    got = hybrid.hybrid_topk(df, query, "word3", HybridOptions(base=base)).collect()
    assert all(abs(r.combined_score - 0.7 * r.vector_score - 0.3 * r.keyword_score) < 1e-9 for r in got)
    assert [r.combined_score for r in got] == sorted((r.combined_score for r in got), reverse=True)
    assert got[0].combined_score <= max(r.combined_score for r in all_hits) + 1e-9
    compat = hybrid.hybrid_topk(df, query, "word3", HybridOptions(base=base, compat_heap=True)).collect()
    assert len(compat) == 4 and not {r.id for r in compat} & {r.id for r in got}
    off = hybrid.hybrid_topk(df, query, "word3", HybridOptions(base=base, enabled=False)).collect()
    assert all(r.keyword_score == 0 and r.combined_score == r.vector_score for r in off)
    only = hybrid.hybrid_topk(df, query, "word3", HybridOptions(base=SearchOptions(limit=4, source_filter="h/1"))).collect()
    assert {r.id % 2 for r in only} == {1}


def grid(spark):
    return spark.createDataFrame([(f"g{i}{j}", [float(i), float(j), 0.0]) for i in range(10) for j in range(10)], "id string, vector array<float>")


def test_index(spark, tmp_path):
    g = grid(spark)
    index = ann.build(g, AnnParams(rows_per_cell=20, probes=2, cosine=False))
    assert index.stats().first().node_count == 100 and index.dimension == 3
    assert index.topk([5.0, 5.0, 0.0], SearchOptions(limit=5)).first().id == "g55"
    more = index.add(spark.createDataFrame([("new", [5.1, 5.0, 0.0])], "id string, vector array<float>"))
    assert more.stats().first().node_count == 101
    with pytest.raises(ValueError):
        index.add(g.limit(1))
    with pytest.raises(ValueError):
        index.topk([1.0])
    with pytest.raises(Exception, match="3 values"):
        index.assigned(spark.createDataFrame([("x", [1.0])], "id string, vector array<float>")).collect()
    ann.save(index, str(tmp_path / "i"))
    again = ann.load(spark, str(tmp_path / "i"), index.params)
    assert again.topk([5.0, 5.0, 0.0], SearchOptions(limit=1)).first().id == "g55"
    plan = again.topk([5.0, 5.0, 0.0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    empty = ann.build(g.limit(0))
    assert empty.stats().first().node_count == 0


def test_index_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 2000)] + 0.3 * rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    index = ann.build(df, AnnParams(rows_per_cell=100, probes=6))
    index.table.cache()
    hits = 0
    for q in range(0, 2000, 200):
        exact = {r.id for r in search.exact_topk(df, x[q].tolist(), SearchOptions(limit=10)).collect()}
        hits += len(exact & {r.id for r in index.topk(x[q].tolist(), SearchOptions(limit=10)).collect()})
    assert hits / 100 >= 0.9


def test_graph(spark):
    links = ann.build(grid(spark), AnnParams(rows_per_cell=30, cosine=False)).neighbour_graph(4)
    assert links.groupBy("src").count().agg(F.max("count")).first()[0] <= 8
    stats = ann.degree_stats(links).first()
    assert stats.nodes == 100 and stats.max_degree <= 8


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_ann_topk(spark, size):
    folder = Path("/root/testdata") / size
    if not folder.exists():
        pytest.skip("no test tables here")
    exact = {(r.query_id, r.vec_id) for r in QUERIES["vector_topk_batch"](spark, str(folder)).collect()}
    got = {(r.query_id, r.vec_id) for r in QUERIES["ann_topk"](spark, str(folder)).collect()}
    assert len(got) == len(exact) and {q for q, _ in got} == {q for q, _ in exact}
    assert len(got & exact) / len(exact) >= 0.9, len(got & exact) / len(exact)
    print(size, len(got & exact), "of", len(exact))


def test_batches_look_into_the_same_cells(spark):
    x = np.random.default_rng(5).normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    index = ann.build(df, AnnParams(rows_per_cell=50, probes=3))
    index.table.cache()
    asked = df.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    got = {}
    for r in index.topk_batch(asked, 5).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    for r in asked.collect():
        assert got[r.query_id] == {h.id for h in index.topk(r.vector, SearchOptions(limit=5)).collect()}


def test_links_of_a_large_cell(spark):
    x = np.random.default_rng(6).normal(size=(900, 8))
    x[:300] = x[0] + 0.01 * x[:300]  # a third of all rows near one centre
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    index = ann.build(df, AnnParams(rows_per_cell=200, probes=4))
    got = {(r.src, r.dst) for r in index.neighbour_graph(8, block_rows=50).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1)[:, :8]
    assert not any(s == t for s, t in got)
    for lo, hi in ((0, 300), (300, 900)):
        assert np.mean([(i, j) in got for i in range(lo, hi) for j in best[i]]) >= 0.95


def test_bm25_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple apple tree"), (2, "apple pie"), (3, "sky pie pie"), (4, None), (5, "")], "id long, content string")
    index, kept = bm25.build_index(docs), bm25.keep(docs, f"{tmp_path}/k")
    for query in ("apple pie", "pie pie sky", "none such", "", "apple sky tree"):
        want = {r.id: pytest.approx(r.score) for r in bm25.keyword_scores(index, query).collect()}
        assert {r.id: r.score for r in bm25.keyword_scores(kept, query).collect()} == want
    assert bm25.index_stats(kept).first() == bm25.index_stats(index).first()
    assert sorted(map(tuple, kept.postings.collect())) == sorted(map(tuple, index.postings.collect())) == [(1, "apple", 2), (1, "tree", 1), (2, "apple", 1), (2, "pie", 1), (3, "pie", 2), (3, "sky", 1)]
    empty = bm25.keep(docs.limit(0), f"{tmp_path}/e")
    assert bm25.keyword_scores(empty, "apple").count() == 0


def test_repeated_ids_are_one_document(spark):
    rows = [("a", 1, [1.0, 0.0], "old"), ("a", 2, [1.0, 0.1], "new"), ("b", 1, [0.9, 0.3], "b"), ("c", 1, [0.0, 1.0], "c"), (None, 3, [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "id string, indexed_at long, vector array<float>, content string")
    now = current(df)
    assert sorted((r.id, r.content) for r in now.collect()) == [("a", "new"), ("b", "b"), ("c", "c")]
    hits = search.with_documents(search.exact_topk(now, [1.0, 0.0], SearchOptions(limit=2)), df)
    assert sorted((r.id, r.content) for r in hits.collect()) == [("a", "new"), ("b", "b")]
    assert current(df.limit(0)).count() == 0
    index = ann.build(now, AnnParams(rows_per_cell=2))
    assert index.stats().first().node_count == 3 and index.table.columns == [*df.columns, "cell"]
