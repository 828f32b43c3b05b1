"""Crawling over a table of pages (url, html): frontier, admission, chunks as documents."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.functions.html import extract_page
from docmill.operators.chunking import crawl_chunks
from docmill.plans.lineage import cut
from docmill.plans.sizing import small_side
from docmill.schema import CrawlChunks, CrawlConfig, CrawlMode, UrlPatterns
from docmill.sources.embedder import Embedder, HashingEmbedder, embed_column


@dataclass(frozen=True)
class CrawlProgress:
    crawled: int
    queued: int
    failed: int
    current_url: str | None = None  # the last page that was taken


def host(url: Column) -> Column:
    """Host of an absolute url, in lower case; null of anything else."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def admitted(url: Column, patterns: UrlPatterns | None = None, domains: frozenset[str] = frozenset()) -> Column:
    """Whether a url is to be crawled: it has no excluded part, an included one if there are any, and
    a host, one of ``domains`` if there are any."""
    patterns = patterns or UrlPatterns()
    out = host(url).isNotNull()
    if patterns.exclude:
        out = out & ~X.contains_any(url, patterns.exclude)
    if patterns.include:
        out = out & X.contains_any(url, patterns.include)
    if domains:
        out = out & host(url).isin(sorted(domains))
    return F.coalesce(out, F.lit(False))


def follows(mode: CrawlMode, depth: int, max_depth: int) -> bool:
    """Whether links of a page at ``depth`` are followed."""
    return {CrawlMode.SINGLE: False, CrawlMode.SECTION: depth == 0, CrawlMode.FULL: depth < max_depth}[mode]


def fetch(urls: DataFrame, config: CrawlConfig, timeout: float = 30.0) -> DataFrame:
    """(url, status, html) of urls over the network, politely: each worker waits between requests, and
    longer after being told that there were too many. Anything but status 200 gives no html."""
    agent, pause = config.user_agent, max(config.delay_ms / 1000, 1.0 / max(1, config.concurrent_requests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, html = [], []
            for u in b.column(0).to_pylist():
                try:
                    with urlopen(Request(u, headers={"User-Agent": agent}), timeout=timeout) as r:
                        status.append(r.status)
                        html.append(r.read().decode(r.headers.get_content_charset() or "utf-8", "replace") if r.status == 200 else None)
                except Exception as e:
                    code = getattr(e, "code", 0)
                    status.append(int(code or 0))
                    html.append(None)
                    if code == 429:
                        time.sleep(10)
                time.sleep(pause)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(status, pa.int32()), pa.array(html, pa.string())], ["url", "status", "html"])

    return urls.select("url").repartition(max(1, config.concurrent_requests)).mapInArrow(run, "url string, status int, html string")


def crawl(pages: DataFrame | Callable[[DataFrame], DataFrame], config: CrawlConfig, spark: SparkSession | None = None, on_progress: Callable[[CrawlProgress], None] | None = None) -> tuple[DataFrame, CrawlProgress]:
    """((url, depth, page) in breadth-first order of discovery, progress) from ``config.start_url``.

    ``pages`` has url and html, and maybe status (only 200 counts); or it is a function that gets them for a table of urls,
    such as :func:`fetch`, which is asked level by level for no more pages than may still be taken. A page that is
    missing or failed is passed over. What has been visited stays a table; ``on_progress`` hears of each step.
    Focus sets nothing apart.
    """
    spark = spark or pages.sparkSession

    def contents(urls: DataFrame, n: int) -> DataFrame:
        """url, html of those of the urls that can be had: they meet the pages before anything is gathered by url."""
        got = pages(urls) if callable(pages) else pages.join(small_side(urls, n), "url", "left_semi")
        got = got.filter("url IS NOT NULL AND html IS NOT NULL")
        return (got.filter("status = 200") if "status" in got.columns else got).groupBy("url").agg(F.min("html").alias("html"))

    frontier = spark.createDataFrame([(config.start_url, [0])], "url string, rank array<long>")
    visited = frontier.select("url")
    levels: list[DataFrame] = []
    crawled = failed = queued = depth = 0
    last: str | None = None
    while crawled < config.max_pages and depth <= config.max_depth:
        wanted, asked, n, parts = queued or 1, 0, 0, []
        while asked < wanted and crawled < config.max_pages:
            left = config.max_pages - crawled
            urls, size = frontier, wanted
            if wanted - asked > left and callable(pages):  # ask for no more than may be taken
                urls, size = frontier.orderBy("rank").offset(asked).limit(left), left
            elif asked:
                urls, size = frontier.orderBy("rank").offset(asked), wanted - asked
            found = urls.join(contents(urls.select("url"), size), "url")
            if size > left:  # a limit gathers what it keeps in one task
                found = found.orderBy("rank").limit(left)
            part = cut(found.select("url", "rank", F.lit(depth).alias("depth"), extract_page(F.col("html"), F.col("url")).alias("page")))
            got = part.count()
            asked, n, crawled = asked + size, n + got, crawled + got
            failed += size - got if crawled < config.max_pages else 0
            parts.append(part)
            if got:
                last = part.agg(F.max_by("url", "rank")).first()[0]
            if on_progress:
                on_progress(CrawlProgress(crawled, wanted - asked, failed, last))
        level = reduce(DataFrame.unionByName, parts)
        levels.append(level)
        if not n or not follows(config.mode, depth, config.max_depth):
            break
        links = level.select("rank", F.posexplode("page.links").alias("nth", "url")).filter(admitted(F.col("url"), config.patterns, config.allowed_domains))
        # a rank is the path of link numbers from the start, so order needs no global numbering
        place = F.concat("rank", F.array(F.col("nth").cast("long")))
        frontier = cut(links.join(visited, "url", "left_anti").groupBy("url").agg(F.min(place).alias("rank")))
        queued = frontier.count()
        if not queued:
            break
        visited = visited.unionByName(frontier.select("url"))
        depth += 1
    out = reduce(DataFrame.unionByName, levels).select("url", "depth", "rank", "page")
    return out, CrawlProgress(crawled, queued if crawled >= config.max_pages else 0, failed, last)


def documents_of(crawled: DataFrame, embedder: Embedder | None = None, now: datetime | None = None, strategy: CrawlChunks | None = None) -> DataFrame:
    """Entries of crawled pages: a document for each chunk, with id, tags and vector."""
    embedder = embedder or HashingEmbedder()
    stamp = F.lit(now) if now else F.current_timestamp()
    # the page's fields go along as its key, so that it is extracted once
    key = F.struct("url", F.col("page.title").alias("title"), F.col("page.metadata.language").alias("language"))
    each = crawled.select("url", F.explode(F.array("page")).alias("page"))
    chunks = crawl_chunks(each.select(key.alias("doc"), F.col("page.markdown").alias("content")), strategy, "doc", "content")
    whole = chunks.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("doc"))).select("*", "doc.url", "doc.title", "doc.language")
    name = X.chunk_id(F.col("url"), F.col("position"))
    meta = F.struct(F.lit("Documentation").alias("content_type"), F.col("language").alias("language"), stamp.cast("timestamp").alias("last_updated"), X.chunk_tags(F.col("has_code"), F.col("position"), F.col("total")).alias("tags"))
    doc = F.struct(name.alias("id"), F.col("content").alias("content"), F.col("url").alias("url"), F.col("title").alias("title"), F.col("heading_context").alias("section"), meta.alias("metadata"))
    return whole.select(name.alias("id"), stamp.cast("timestamp").alias("indexed_at"), embed_column(F.col("content"), embedder).alias("vector"), doc.alias("document"))
