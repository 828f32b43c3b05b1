from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docmill.functions import html as H
from docmill.queries import QUERIES
from docmill.schema import CrawlConfig, CrawlMode, UrlPatterns
from docmill.sources import pages as P
from docmill.sources.embedder import EmbeddingError, HashingEmbedder, LazyEmbedder, embed_column

LONG = "This paragraph explains the usage of the library at some length, so that it is content and nothing else. "
PAGE = f"""<html><head><title> A &amp; B </title><meta name="Description" content="d1"><meta name=keywords content=k><meta name="description" content="d2"></head>
<body><header>top</header><nav><a href="/docs/b">b</a></nav><div class="sidebar">side</div><div class="ad-box">buy</div><div class="thread-list">kept thread</div>
<main><h1>Head</h1><p>{LONG}</p><p>Back to top</p><p>Copyright 2020 someone</p><pre><code class="language-python">import os
print(1)</code></pre><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></main>
<a href="c#part">c</a><a href="mailto:x@y">m</a><a href="http://[bad">bad</a><footer>foot</footer><script>evil()</script></body></html>"""


def test_extract():
    r = H.extract(PAGE, "https://h.example/docs/a")
    assert r["title"] == "A & B"
    for gone in ("top", "side", "buy", "foot", "evil", "Back to top", "Copyright"):
        assert gone not in r["markdown"]
    assert "# Head" in r["markdown"] and "```\nimport os\nprint(1)\n```" in r["markdown"] and "* one\n* two" in r["markdown"]
    assert r["code_blocks"] == [{"code": "import os\nprint(1)", "language": "python", "context": f"Section: Head | {LONG.strip()}", "usage_example": True, "api_reference": False}]
    assert r["metadata"]["description"] == "d2" and r["metadata"]["keywords"] == "k"
    assert r["links"] == ["https://h.example/docs/b", "https://h.example/docs/c"]


@pytest.mark.parametrize("html", ["", "<", "</p></div>", "<p>" * 3000 + "x", "no markup", "<b><i>x</b></i>", "<a href>x</a>", "\x00<div id=>"])
def test_any_markup_has_a_result(html):
    r = H.extract(html, None)
    assert r["title"] == "Untitled Document" and isinstance(r["markdown"], str)


def test_selectors():
    root = H.parse("<div class='a b' id=c><pre><code>x</code></pre></div><p class='load-x'></p>")
    assert len(H.select(root, (".a", "#c"))) == 1
    assert [n.tag for n in H.select(root, ("pre code",))] == ["code"]
    assert len(H.select(root, ("[class*='ad-']",))) == 1 and len(H.select(root, ("[class^=ad-]",))) == 0


def test_title_from_heading():
    assert H.extract("<title> </title><h1>One</h1>", "u")["title"] == "One"


def test_extract_column(spark):
    df = spark.createDataFrame([(PAGE, "https://h.example/py/a"), (None, None)], "html string, url string")
    a, b = df.select(H.extract_page(F.col("html"), F.col("url")).alias("p")).collect()
    assert a.p.metadata.language == "Python" and a.p.title == "A & B" and b.p.title is None


def test_admission(spark):
    rows = ["https://a.example/docs/x", "https://a.example/docs/blog/x", "https://b.example/docs/x", "https://a.example/x", "not a url /docs/", "", None, "HTTPS://A.example:8080/docs/"]
    df = spark.createDataFrame([(u,) for u in rows], "u string")
    u = F.col("u")
    assert [r[0] for r in df.select(P.admitted(u, domains=frozenset({"a.example"}))).collect()] == [True, False, False, False, False, False, False, True]
    assert [r[0] for r in df.select(P.admitted(u, UrlPatterns((), ()))).collect()][:5] == [True, True, True, True, False]


def site(spark):
    def page(*links):
        return f"<title>t</title><main><h1>H</h1><p>{LONG * 3}</p></main>" + "".join(f'<a href="{x}">x</a>' for x in links)

    rows = [("a", page("b", "c", "https://other.example/docs/z", "/blog/x"), 200), ("b", page("d", "a"), 200), ("c", page("e", "missing"), 200), ("d", page(), 200), ("e", page("f"), 500), ("f", page(), 200)]
    return spark.createDataFrame([(f"https://s.example/docs/{u}", h, s) for u, h, s in rows], "url string, html string, status int")


def crawl(spark, **options):
    found, progress = P.crawl(site(spark), CrawlConfig("https://s.example/docs/a", allowed_domains=frozenset({"s.example"}), **options))
    return [(r.url[-1], r.depth) for r in found.orderBy("depth", "rank").collect()], progress


def test_crawl(spark):
    assert crawl(spark)[0] == [("a", 0)]
    assert crawl(spark, mode=CrawlMode.SECTION)[0] == [("a", 0), ("b", 1), ("c", 1)]
    order, progress = crawl(spark, mode=CrawlMode.FULL)
    assert order == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert progress.crawled == 4 and progress.failed == 2
    assert crawl(spark, mode=CrawlMode.FULL, max_pages=2)[0] == [("a", 0), ("b", 1)]
    assert crawl(spark, mode=CrawlMode.FULL, max_depth=1)[0] == [("a", 0), ("b", 1), ("c", 1)]


def test_documents(spark):
    found, _ = P.crawl(site(spark), CrawlConfig("https://s.example/docs/a"))
    docs = P.documents_of(found, HashingEmbedder(16), datetime(2025, 1, 1, tzinfo=timezone.utc)).collect()
    assert docs[0].id == "https://s.example/docs/a_chunk_0" and len(docs[0].vector) == 16
    assert docs[0].document.metadata.tags[1] == f"chunk-1-of-{len(docs)}"


def test_embedders(spark):
    e = HashingEmbedder(32)
    a = e.embed(["same words", "same words", "", "other"])
    assert (a[0] == a[1]).all() and not a[2].any() and abs((a[0] ** 2).sum() - 1) < 1e-6
    df = spark.createDataFrame([("x",), (None,)], "t string")
    got = [r.v for r in df.select(embed_column(F.col("t"), e).alias("v")).collect()]
    assert len(got[0]) == 32 and got[1] is None

    def broken():
        raise OSError("no such file")

    with pytest.raises(EmbeddingError):
        LazyEmbedder(broken, 32).embed(["x"])
    assert LazyEmbedder(lambda: e, 32).embed(["x"]).shape == (1, 32)
    with pytest.raises(EmbeddingError):
        LazyEmbedder(lambda: e, 33).embed(["x"])


def test_the_crawl_reaches_every_page(spark):
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    want = {r.page_id for r in spark.read.parquet(f"{folder}/extracted.parquet").select("page_id").collect()}
    got = [(int(r.url.rsplit("-", 1)[1]), r.depth) for r in QUERIES["crawl_bfs"](spark, str(folder)).collect()]
    assert len(got) == len(want) > 31 and {n for n, _ in got} == want
    assert all(depth == (n + 1).bit_length() - 1 for n, depth in got)


def test_crawl_by_a_function_of_urls(spark):
    """Pages are asked for level by level, never more than may be taken, and missing ones are passed over."""
    site = {"https://s/docs/0": [1, 2, 3], "https://s/docs/1": [4, 5], "https://s/docs/3": [6], "https://s/docs/4": [], "https://s/docs/5": [], "https://s/docs/6": []}
    asked, seen = [], []

    def get(urls):
        now = [r.url for r in urls.collect()]
        asked.append(len(now))
        rows = [(u, 200, "<main><h1>t</h1>" + "".join(f'<a href="/docs/{k}">x</a>' for k in site[u]) + "</main>") for u in now if u in site] + [(u, 404, None) for u in now if u not in site]
        return spark.createDataFrame(rows, "url string, status int, html string")

    config = CrawlConfig("https://s/docs/0", CrawlMode.FULL, max_pages=4, max_depth=5)
    found, progress = P.crawl(get, config, spark, seen.append)
    assert [r.url[-1] for r in found.orderBy("depth", "rank").collect()] == ["0", "1", "3", "4"]
    assert progress.crawled == 4 and progress.current_url == "https://s/docs/4" and max(asked) <= 3
    assert [p.crawled for p in seen] == sorted(p.crawled for p in seen)
    whole, progress = P.crawl(get, CrawlConfig("https://s/docs/0", CrawlMode.FULL, max_pages=50), spark)
    assert whole.count() == 6 and progress.failed == 1
