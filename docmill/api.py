"""The five tools over a store: search, list, crawl, reload, manage."""

from __future__ import annotations

import warnings
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.operators import chunking, lifecycle
from docmill.operators.ann import AnnIndex, build
from docmill.operators.bm25 import Bm25Index, keep
from docmill.operators.dedup import current
from docmill.operators.hybrid import hybrid_topk
from docmill.operators.quantizer import Quantizer
from docmill.operators.search import exact_topk, filtered, named_content_type, result_rows, with_documents
from docmill.schema import AnnParams, ChunkStrategy, CrawlConfig, CrawlMode, Focus, HeadingBased, HybridOptions, Quantization, SearchOptions
from docmill.sources.embedder import Embedder, HashingEmbedder, embed_column
from docmill.sources.pages import crawl, documents_of, fetch
from docmill.sources.project import ProjectInfo
from docmill.sources.store import Store

DEFAULT_MAX_AGE_DAYS = 90


class InvalidParams(ValueError):
    """A tool was called with a value that it doesn't know."""


def _enum(kind, value: str, what: str):
    try:
        return kind(value)
    except ValueError:
        raise InvalidParams(f"unknown {what} {value!r}; one of {[x.value for x in kind]}") from None


class DocTools:
    """Tools as an assistant calls them; each returns plain data for JSON.

    ``pages`` is a table (url, html) that crawling reads; without one, urls are fetched.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, pages: DataFrame | None = None, project: ProjectInfo | None = None):
        self.spark, self.store, self.pages, self.project = spark, Store(spark, path), pages, project
        self.embedder = embedder or HashingEmbedder()
        self.on_progress = None  # called with the progress of a crawl at each step
        self.store.metadata()  # a store that can't be read is an error here, not an empty store

    def search_docs(self, query: str, limit: int = 5, source_filter: str | None = None, content_type: str | None = None) -> list[dict]:
        """The documents nearest to the query: id, content, score, metadata."""
        kind = named_content_type(content_type)
        if content_type and not kind:
            warnings.warn(f"content type {content_type!r} is unknown and sets no filter", stacklevel=2)
        docs = current(self.store.documents())
        vector = self.embedder.embed([query])[0].tolist()
        hits = exact_topk(docs, vector, SearchOptions(limit=limit, source_filter=source_filter, content_type=kind))
        rows = result_rows(with_documents(hits, docs)).orderBy(F.col("score").desc(), "id").limit(limit)
        return [r.asDict() for r in rows.collect()]

    def list_docs(self, limit: int = 1000, after: str | None = None) -> dict:
        """total_documents, total_sources, sources {url: documents} in order, ``limit`` of them after the source ``after``, project_context."""
        listed = lifecycle.list_sources(self.store.documents())
        whole = listed.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.count(F.lit(1)).alias("sources")).first()
        page = listed if after is None else listed.filter(F.col("source") > after)
        counts = {r.source: r.documents for r in page.orderBy("source").limit(limit).collect()}
        p = self.project
        return {"total_documents": whole.documents, "total_sources": whole.sources, "sources": counts, "project_context": {"is_project": p.is_project, "project_name": p.project_name, "project_root": str(p.project_root) if p.project_root else None} if p else None}

    def _crawl(self, url: str, mode: str, focus: str, max_pages: int) -> tuple[DataFrame, dict]:
        config = CrawlConfig(start_url=url, mode=_enum(CrawlMode, mode, "mode"), focus=_enum(Focus, focus, "focus"), max_pages=max_pages)
        pages = self.pages if self.pages is not None else lambda urls: fetch(urls, config)
        found, progress = crawl(pages, config, self.spark, self.on_progress)
        return documents_of(found, self.embedder), {"status": "success" if progress.crawled else "failed", "source_url": url, "mode": mode, "pages_crawled": progress.crawled}

    def crawl_docs(self, url: str, mode: str = "single", focus: str = "all", max_pages: int = 100) -> dict:
        """Crawl, chunk, embed and add; the counts of it."""
        docs, out = self._crawl(url, mode, focus, max_pages)
        added = self.store.append(docs) if out["pages_crawled"] else 0
        return out | {"documents_created": added, "chunks_created": added, "note": f"{added} chunks of {out['pages_crawled']} pages added"}

    def reload_docs(self) -> dict:
        return {"status": "success", "documents_loaded": self.store.entries().count()}

    def manage_docs(self, operation: str, target: str | None = None, max_age_days: int | None = None, dry_run: bool = False, crawl_mode: str = "single", crawl_focus: str = "all", max_pages: int = 100, now: datetime | None = None) -> dict:
        """``delete`` a source, ``expire`` old documents, or ``refresh`` a source (crawled first, then swapped)."""
        docs, url = self.store.documents(), F.col("document.url")
        if operation == "delete":
            if not target:
                raise InvalidParams("delete needs a target")
            if dry_run:
                return {"operation": "delete", "dry_run": True, "target": target} | lifecycle.dry_run(docs, lifecycle.is_source(target)).first().asDict()
            removed = self.store.rewrite(lambda e: e.filter(X.source_of(url) != target), target)
            return {"operation": "delete", "target": target, "removed": removed, "remaining": self.store.count()}
        if operation == "expire":
            age, at = DEFAULT_MAX_AGE_DAYS if max_age_days is None else max_age_days, now or datetime.now(timezone.utc)
            if dry_run:
                return {"operation": "expire", "dry_run": True, "max_age_days": age} | lifecycle.dry_run(docs, ~lifecycle.is_fresh(at, age)).first().asDict()
            removed = self.store.rewrite(lambda e: e.filter(lifecycle.is_fresh(at, age, "document.metadata.last_updated")))
            return {"operation": "expire", "max_age_days": age, "removed": removed, "remaining": self.store.count()}
        if operation == "refresh":
            if not target:
                raise InvalidParams("refresh needs a target")
            old = docs.filter(lifecycle.is_source(target)).count()
            if dry_run:
                return {"operation": "refresh", "dry_run": True, "target": target, "would_remove": old}
            fresh, out = self._crawl(target, crawl_mode, crawl_focus, max_pages)
            if not out["pages_crawled"]:
                return {"operation": "refresh", "target": target, "status": "failed", "removed": 0, "documents_created": 0, "net_change": 0}
            change = -self.store.rewrite(lambda e: e.filter(X.source_of(url) != target).unionByName(fresh), target)
            return {"operation": "refresh", "target": target, "status": "success", "removed": old, "documents_created": change + old, "net_change": change}
        raise InvalidParams(f"unknown operation {operation!r}; one of delete, expire, refresh")


class DocService:
    """The library's higher level: documents in, documents out, with an index or a codec beside the store."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, strategy: ChunkStrategy | None = None, ann: AnnParams | None = None, quantization: Quantization = Quantization.NONE):
        self.spark, self.store = spark, Store(spark, path)
        self.embedder, self.strategy, self.ann = embedder or HashingEmbedder(), strategy or HeadingBased(), ann
        self.quantization = quantization
        self._index: AnnIndex | None = None
        self._keywords: tuple[tuple[str, ...], Bm25Index] | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **options) -> DocService:
        """With an index."""
        return cls(spark, f"{folder}/enhanced", ann=AnnParams(), **options)

    @classmethod
    def open_quantized(cls, spark: SparkSession, folder: str, **options) -> DocService:
        """With an index and 8-bit codes."""
        return cls(spark, f"{folder}/enhanced_quantized", ann=AnnParams(), quantization=Quantization.SCALAR_8BIT, **options)

    def set_chunking_strategy(self, strategy: ChunkStrategy) -> None:
        self.strategy = strategy

    def add_documents(self, df: DataFrame) -> DataFrame:
        """Add documents (url, content, title, content_type); returns the ids of their chunks."""
        chunks = chunking.chunk(df.select("url", "content"), self.strategy, "url", "content")
        whole = chunks.join(df.select("url", "title", "content_type").dropDuplicates(["url"]), "url")
        name = X.chunk_id(F.col("url"), F.col("position"), "service")
        meta = F.struct("content_type", F.lit(None).cast("string").alias("language"), F.current_timestamp().alias("last_updated"), F.array(F.when(F.col("has_code"), "has-code").otherwise("no-code")).alias("tags"))
        doc = F.struct(name.alias("id"), "content", "url", "title", F.coalesce("heading_context", "heading").alias("section"), meta.alias("metadata"))
        rows = whole.select(name.alias("id"), F.current_timestamp().alias("indexed_at"), embed_column(F.col("content"), self.embedder).alias("vector"), doc.alias("document"))
        before = set(self.store.create().folders)
        self.store.append(rows)
        self._index = None
        added = [f for f in self.store.metadata().folders if f not in before]
        return self.spark.read.parquet(*(f"{self.store.path}/{f}" for f in added)).select("id")

    def add_document(self, content: str, url: str, title: str | None = None, content_type: str = "Documentation") -> list[str]:
        one = self.spark.createDataFrame([(url, content, title, content_type)], "url string, content string, title string, content_type string")
        return [r.id for r in self.add_documents(one).orderBy("id").collect()]

    def search(self, query: str, limit: int = 10, min_score: float = 0.1) -> DataFrame:
        """Documents by hybrid ranking, best first."""
        docs = self.documents()
        options = HybridOptions(base=SearchOptions(limit=limit, min_score=min_score))
        hits = hybrid_topk(docs, self.embedder.embed([query])[0].tolist(), query, options, self.keyword_index())
        return with_documents(hits, docs).orderBy(F.col("combined_score").desc(), "id").limit(limit)

    def vector_search(self, vector: list[float], options: SearchOptions | None = None) -> DataFrame:
        """(id, score) through the index if there is one, else exactly."""
        docs = self.documents()
        if self.ann is None:
            return exact_topk(docs, vector, options)
        return AnnIndex(filtered(self.index().table, options or SearchOptions()), self.index().centres, self.ann).topk(vector, SearchOptions(limit=(options or SearchOptions()).limit, min_score=(options or SearchOptions()).min_score))

    def index(self) -> AnnIndex:
        if self._index is None:
            self._index = build(self.documents().select("id", "vector", "url", "content_type"), self.ann)
        return self._index

    def documents(self) -> DataFrame:
        """The store's documents, of repeated ids the one that was indexed last."""
        return current(self.store.documents())

    def keyword_index(self) -> Bm25Index:
        """The keyword index of the store's present state, kept beside it; built when the state is a new one."""
        m = self.store.create()
        if self._keywords is None or self._keywords[0] != m.folders:
            path = f"{self.store.path}/keywords-{m.number:012d}"
            self._keywords = (m.folders, keep(self.documents(), path))
        return self._keywords[1]

    def remove_document(self, value: str) -> int:
        """Take out the entries of an id."""
        self._index = None
        return self.store.remove(value)

    def index_stats(self) -> str | None:
        if self.ann is None:
            return None
        s = self.index().stats().first()
        return f"nodes: {s.node_count}, dimension: {s.dimension}, cells: {s.cells}, largest cell: {s.largest_cell}"

    def quantizer(self) -> Quantizer:
        """Fitted on the store's vectors."""
        return Quantizer(self.quantization).fit(self.store.entries())

    def quantizer_params(self) -> str | None:
        return None if self.quantization is Quantization.NONE else self.quantizer().to_json()

    def document_count(self) -> int:
        return self.store.count()

    def documents_by_source(self) -> DataFrame:
        return lifecycle.documents_by_source(self.store.documents())

    def remove_source(self, source: str) -> int:
        self._index = None
        return self.store.rewrite(lambda e: e.filter(X.source_of(F.col("document.url")) != source), source)

    def remove_older(self, max_age_days: int, now: datetime | None = None) -> int:
        self._index = None
        at = now or datetime.now(timezone.utc)
        return self.store.rewrite(lambda e: e.filter(lifecycle.is_fresh(at, max_age_days, "document.metadata.last_updated")))

    def clear(self) -> int:
        """Empty the store; the index keeps its parameters."""
        self._index = None
        return self.store.clear()
