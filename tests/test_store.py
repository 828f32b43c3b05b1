from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from docmill.api import DocService, DocTools, InvalidParams
from docmill.operators import lifecycle
from docmill.schema import ENTRY, Quantization, SearchOptions
from docmill.sources.embedder import HashingEmbedder
from docmill.sources.project import project_info
from docmill.sources.store import POINTER, Store

DAY = datetime(2025, 1, 10)


def entry(i, url="https://x/a", updated=None, indexed=DAY, kind="Documentation", content=None):
    return (i, indexed, [1.0, float(len(i))], (i, content or f"text of {i}", url, None, None, (kind, "en", updated, ["t"])))


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_store(spark, store):
    assert store.metadata() is None and store.entries().count() == 0 and store.count() == 0
    assert store.append(entries(spark, entry("a"), entry("b"))) == 2
    assert store.append(entries(spark, entry("a"))) == 1  # no check of ids
    assert store.count() == 3 and store.documents().filter("id = 'a'").count() == 2
    assert store.rewrite(lambda e: e.filter("id <> 'a'")) == 2
    assert [r.id for r in store.entries().collect()] == ["b"] and store.count() == 1
    assert store.vacuum() == 2 and store.entries().count() == 1
    assert store.clear() == 1 and store.count() == 0 and store.entries().count() == 0


def test_version(spark, store, tmp_path):
    store.create()
    store._files.write(POINTER.format(9), json.dumps({"version": 9}))
    with pytest.raises(ValueError, match="version"):
        store.count()
    with pytest.raises(ValueError):
        DocTools(spark, store.path)


def test_json(spark, store, tmp_path):
    at = datetime(2024, 5, 6, 7, 8, 9, 123456)
    store.append(entries(spark, entry("a", updated=at), entry("b", url="")))
    path = str(tmp_path / "out.json")
    store.export_json(path)
    data = json.loads(open(path).read())
    assert data["metadata"]["document_count"] == 2 and data["entries"][0]["vector"]["values"] == [1.0, 1.0]
    other = Store(spark, str(tmp_path / "other"))
    assert other.import_json(path) == 2
    key = ["id", "indexed_at", "vector", "document"]
    assert sorted(map(tuple, other.entries().select(*key).collect()), key=str) == sorted(map(tuple, store.entries().select(*key).collect()), key=str)
    assert other.import_json(str(tmp_path / "missing.json")) == 0
    data["metadata"]["version"] = 2
    (tmp_path / "bad.json").write_text(json.dumps(data))
    with pytest.raises(ValueError):
        other.import_json(str(tmp_path / "bad.json"))


def test_lifecycle(spark):
    df = spark.createDataFrame([("a", "u", DAY, None), ("b", "", DAY, datetime(2024, 1, 1)), ("c", None, datetime(2024, 1, 1), DAY), ("d", "u", None, None)], "id string, url string, indexed_at timestamp, last_updated timestamp")
    now = datetime(2025, 1, 20, tzinfo=timezone.utc)
    assert sorted(r.id for r in lifecycle.expire(df, now, 90).collect()) == ["a", "c"]
    assert lifecycle.dry_run(df, ~lifecycle.is_fresh(now, 90)).first().would_remove == 2
    assert lifecycle.expire(df, now, 10**6).count() == 3
    assert {r.source: r.documents for r in lifecycle.list_sources(df).collect()} == {"u": 2, "local": 2}
    assert sorted(r.id for r in lifecycle.delete_source(df, "local").collect()) == ["a", "d"]
    assert lifecycle.delete_id(df, "a").count() == 3


SENTENCE = "This is a sentence about {} with enough letters to be kept as a chunk of text, and more words follow it here. "


def pages(spark):
    rows = [(f"https://s.example/docs/{n}", f"<title>{n}</title><main><h1>{n}</h1><p>{SENTENCE.format(n) * 2}</p></main>") for n in ("alpha", "beta")]
    return spark.createDataFrame(rows, "url string, html string")


def test_tools(spark, tmp_path):
    tools = DocTools(spark, str(tmp_path / "s"), pages=pages(spark))
    out = tools.crawl_docs("https://s.example/docs/alpha")
    assert out["status"] == "success" and out["documents_created"] == 1
    tools.crawl_docs("https://s.example/docs/beta")
    assert tools.crawl_docs("https://s.example/docs/none")["status"] == "failed"
    hits = tools.search_docs("beta sentence", limit=1)
    assert hits[0]["id"] == "https://s.example/docs/beta_chunk_0" and set(hits[0]) == {"id", "content", "score", "metadata"}
    with pytest.warns(UserWarning):
        assert len(tools.search_docs("beta", content_type="nonsense")) == 2
    assert tools.search_docs("beta", content_type="code") == []
    assert tools.list_docs()["total_documents"] == 2 and tools.reload_docs()["documents_loaded"] == 2
    assert tools.manage_docs("delete", "https://s.example/docs/beta", dry_run=True)["would_remove"] == 1
    assert tools.manage_docs("delete", "https://s.example/docs/beta") == {"operation": "delete", "target": "https://s.example/docs/beta", "removed": 1, "remaining": 1}
    assert tools.manage_docs("refresh", "https://s.example/docs/alpha")["net_change"] == 0
    assert tools.manage_docs("refresh", "https://s.example/docs/none")["status"] == "failed" and tools.store.count() == 1
    later = datetime(2100, 1, 1, tzinfo=timezone.utc)
    assert tools.manage_docs("expire", dry_run=True, now=later)["would_remove"] == 1
    assert tools.manage_docs("expire", now=later)["remaining"] == 0
    for bad in (lambda: tools.manage_docs("nonsense"), lambda: tools.manage_docs("delete"), lambda: tools.crawl_docs("u", mode="x"), lambda: tools.crawl_docs("u", focus="x")):
        with pytest.raises(InvalidParams):
            bad()


def test_requests(spark, tmp_path):
    from docmill.__main__ import answer, parser

    tools = DocTools(spark, str(tmp_path / "s"))
    assert answer(tools, '{"tool": "list_docs"}')["result"]["total_documents"] == 0
    assert answer(tools, '{"tool": "none"}')["error"]["code"] == -32601
    assert answer(tools, '{"tool": "manage_docs", "arguments": {"operation": "x"}}')["error"]["code"] == -32602
    assert answer(tools, "not json")["error"]["code"] == -32602
    assert parser().parse_args(["crawl", "u", "--max-pages", "3"]).max_pages == 3


def test_service(spark, tmp_path):
    s = DocService.open_quantized(spark, str(tmp_path), embedder=HashingEmbedder(32))
    text = "# Apples\n" + "Apples grow on trees in the garden. " * 12 + "\n# Rivers\n" + "Rivers flow down to the sea at last. " * 12
    ids = s.add_document(text, "https://x/doc", "Title")
    assert ids == ["https://x/doc_0", "https://x/doc_1"]
    first = s.search("apples in the garden", limit=1).first()
    assert first.id == "https://x/doc_0" and first.section == "Apples"
    assert s.vector_search(HashingEmbedder(32).embed(["rivers flow down to the sea"])[0].tolist(), SearchOptions(limit=1)).first().id == "https://x/doc_1"
    assert "nodes: 2" in s.index_stats() and json.loads(s.quantizer_params())["dimension"] == 32
    assert s.document_count() == 2 and s.documents_by_source().count() == 2
    assert s.remove_source("https://x/doc") == 2 and s.clear() == 0
    assert DocService(spark, str(tmp_path / "p")).index_stats() is None
    assert s.quantization is Quantization.SCALAR_8BIT


def test_project(tmp_path):
    (tmp_path / "proj" / "sub").mkdir(parents=True)
    (tmp_path / "proj" / "pyproject.toml").touch()
    info = project_info(tmp_path / "proj" / "sub", tmp_path / "global")
    assert info.is_project and info.project_name == "proj" and info.database_path == (tmp_path / "proj" / ".docmill" / "store").resolve()


def test_stream(spark, tmp_path):
    from docmill.streaming.ingest import events_per_window, ingest_chunks, latest_fetches

    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    schema = "url string, content string, at timestamp"

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)

    def seen():
        try:
            return spark.read.parquet(sink).select(F.col("content_hash").alias("hash"))
        except Exception:
            return None

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        ingest_chunks(stream, seen, lambda df: df.write.mode("append").parquet(sink), str(tmp_path / "cp")).awaitTermination()
        return sorted(r.url for r in spark.read.parquet(sink).collect())

    put(("u1", SENTENCE.format("one") * 2, DAY), ("u2", SENTENCE.format("two") * 2, DAY))
    assert run() == ["u1", "u2"]
    put(("u3", SENTENCE.format("ONE").upper() * 2, DAY), ("u4", SENTENCE.format("four") * 2, DAY))
    assert run() == ["u1", "u2", "u4"]

    stream = latest_fetches(spark.readStream.schema(schema).parquet(source), "at", ["url"])
    q = stream.writeStream.format("memory").queryName("fetches").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert spark.table("fetches").count() == 4
    counts = events_per_window(spark.readStream.schema(schema).parquet(source), "at")
    q = counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp3")).start()
    q.awaitTermination()
    assert spark.table("windows").first().arrivals == 4


def test_writers_lose_nothing(spark, store):
    """A writer whose pointer was taken meanwhile begins anew on the other's state."""
    store.append(entries(spark, entry("a")))
    other, done = Store(spark, store.path), []
    claim = store._files.write_new

    def late(name, text):
        if not done:
            done.append(other.append(entries(spark, entry("b"))))
        claim(name, text)

    store._files.write_new = late
    assert store.append(entries(spark, entry("c"))) == 1
    assert sorted(r.id for r in store.entries().collect()) == ["a", "b", "c"] and store.count() == 3 == Store(spark, store.path).count()


def test_deleting_a_source_leaves_other_parts(spark, store):
    store.append(entries(spark, *(entry(f"e{i}", url=f"https://x/{i}") for i in range(12))))
    before = set(store.metadata().folders)
    assert store.rewrite(lambda e: e.filter("document.url <> 'https://x/3'"), "https://x/3") == 1
    after = set(store.metadata().folders)
    assert len(before - after) == 1 and len(before & after) == len(before) - 1 > 1
    assert store.remove("e5") == 1 and store.remove("none") == 0 and store.count() == 10
    assert {r.id for r in store.entries().collect()} == {f"e{i}" for i in range(12) if i not in (3, 5)}


def test_unknown_kinds_are_not_written(spark, store):
    with pytest.raises(Exception, match="no such kind"):
        store.append(entries(spark, entry("a", kind="Poem")))
    assert store.count() == 0


def test_search_with_repeated_ids(spark, tmp_path):
    tools = DocTools(spark, str(tmp_path / "t"), HashingEmbedder(2))
    later = datetime(2025, 1, 11)
    tools.store.append(entries(spark, *[entry("a")] * 3, entry("a", indexed=later, content="newest"), entry("bb"), entry("ccc")))
    got = tools.search_docs("text", 3)
    assert sorted(r["id"] for r in got) == ["a", "bb", "ccc"] and {r["content"] for r in got if r["id"] == "a"} == {"newest"}
    listed = tools.list_docs(limit=0)
    assert listed["total_documents"] == 6 and listed["total_sources"] == 1 and listed["sources"] == {}


def test_command_line(spark, tmp_path, capsys):
    from docmill.__main__ import answer, main, within

    assert main(["tools"]) == 0
    assert "search_docs" in capsys.readouterr().out
    tools = DocTools(spark, str(tmp_path / "t"), HashingEmbedder(4))
    assert len(answer(tools, json.dumps({"tool": "info"}))["result"]["tools"]) == 5
    assert within(60, lambda: 5, spark) == 5
    with pytest.raises(TimeoutError):
        within(0.2, lambda: __import__("time").sleep(3), spark)
