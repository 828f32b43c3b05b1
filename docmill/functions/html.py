"""HTML pages: main content, code blocks, metadata and links.

A small tree over the standard parser, with the selectors that pages need (tag,
.class, #id, [attr*=part], descendants). Work on a page is one pass of a worker; the
cleaning of its text is an expression (:func:`docmill.functions.text.clean_markdown`).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.schema import EXTRACTED

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS = frozenset("p div section article main ul ol table tr pre blockquote h1 h2 h3 h4 h5 h6 li dl dt dd hr header footer nav aside form".split())

#: What is no content, wherever it stands.
UNWANTED = (
    "script", "style", "noscript", "nav", ".navigation", ".navbar", ".nav", ".menu", ".toc", ".table-of-contents",
    "header", ".header", ".site-header", "footer", ".footer", ".sidebar", ".side-nav", ".secondary", "aside",
    ".breadcrumb", ".breadcrumbs", ".crumbs", ".dropdown", ".submenu", ".skip-link", ".skip-to-content", ".screen-reader-text",
    ".social", ".share", ".sharing", ".social-links", ".ad", ".ads", ".advertisement", ".banner", "[class^=ad-]", "[id^=ad-]",
    ".comments", ".comment-section", "#comments", ".related", ".recommended", ".suggestions", ".more-stories",
    ".cookie", ".popup", ".modal", ".overlay", ".search", ".search-box", ".search-form",
)
#: Where the content stands, in order of preference.
MAIN = (
    ("article", "main", ".documentation", ".content", ".docs", ".markdown-body", ".post-content", ".entry-content"),
    ("main",),
    (".content", ".docs", ".documentation"),
    ("#content",), ("#main-content",), (".main-content",), (".content-wrapper",), (".post-content",), (".entry-content",), (".markdown-body",), (".documentation",),
)
#: Short elements with such a text are boilerplate.
BOILERPLATE = ("skip to main content", "skip to content", "skip navigation", "toggle navigation", "menu toggle", "search this site", "table of contents", "back to top", "scroll to top")
#: Selectors of code.
CODE = ("pre code", "pre", ".highlight", ".codehilite", ".code-block")
EXPLAINS = ("example", "usage", "how to", "following", "this code", "you can")
USAGE = ("example", "usage", "how to", "getting started", "quick start", "tutorial", "demo")
API = ("api", "reference", "method", "function", "parameter", "return", "endpoint")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """This element and those within, in order of the document."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.children)
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]

    def within(self, other: Node) -> bool:
        node = self
        while node is not None:
            if node is other:
                return True
            node = node.parent
        return False


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = _CLOSES.get(tag, ())
        node = self.at
        while node.parent is not None and node.tag in closes:
            node = node.parent
        self.at = node
        child = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(child)
        if tag not in _VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:  # an end without a beginning changes nothing
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


@functools.lru_cache(512)
def _compiled(selector: str) -> tuple[tuple[str, str, str], ...]:
    steps = []
    for part in selector.split():
        if part.startswith("."):
            steps.append(("class", part[1:], ""))
        elif part.startswith("#"):
            steps.append(("id", part[1:], ""))
        elif m := re.fullmatch(r"\[([\w-]+)([*^])=['\"]?([^'\"\]]+)['\"]?\]", part):
            steps.append((m[2], m[1], m[3]))
        else:
            steps.append(("tag", part, ""))
    return tuple(steps)


def _fits(node: Node, step: tuple[str, str, str]) -> bool:
    kind, name, value = step
    if kind == "tag":
        return node.tag == name
    if kind == "class":
        return name in node.attrs.get("class", "").split()
    if kind == "id":
        return node.attrs.get("id") == name
    if kind == "*":
        return value in node.attrs.get(name, "")
    return any(x.startswith(value) for x in node.attrs.get(name, "").split())


def matches(node: Node, selector: str) -> bool:
    *above, last = _compiled(selector)
    if not _fits(node, last):
        return False
    up = node.parent
    for step in reversed(above):
        while up is not None and not _fits(up, step):
            up = up.parent
        if up is None:
            return False
        up = up.parent
    return True


def select(root: Node, selectors: tuple[str, ...]) -> list[Node]:
    return [n for n in root.walk() if n is not root and any(matches(n, s) for s in selectors)]


def drop(root: Node, selectors: tuple[str, ...]) -> None:
    for n in select(root, selectors):
        n.remove()


def title_of(root: Node) -> str:
    """Of ``<title>``, else the first ``<h1>``, else ``Untitled Document``."""
    for tag in ("title", "h1"):
        first = next((n for n in root.walk() if n.tag == tag), None)
        if first is not None and (found := first.text().strip()):
            return found
    return "Untitled Document"


def drop_boilerplate(root: Node) -> None:
    """Elements that hold nothing but a boilerplate phrase, and copyright notices (up to 200 characters)."""
    for n in list(root.walk()):
        if n.parent is None:
            continue
        text = n.text().strip().lower()
        if (len(text.encode()) < 50 and any(p in text for p in BOILERPLATE)) or (len(text) <= 200 and text.startswith(("©", "copyright"))):
            n.remove()


def main_content(root: Node) -> Node:
    """The first place of content with more than a few characters, of its sections the valuable ones
    (outermost only); the whole document if there is no such place."""
    for group in MAIN:
        found = next(iter(select(root, group)), None)
        if found is None:
            continue
        sections = [n for n in select(found, ("section", "div", "article")) if _valuable(n)]
        outer = [n for n in sections if not any(n is not o and n.within(o) for o in sections)]
        if outer:
            out = Node("div", {}, None)
            out.children = outer
        else:
            out = found
        if sum(len(n.text()) for n in (outer or [found])) > 100:
            return out
    return root


def _valuable(n: Node) -> bool:
    text = n.text()
    low = text.lower()
    if any(x in low for x in ("example", "usage", "api")) or any(c.tag in ("pre", "code") or "highlight" in c.attrs.get("class", "").split() for c in n.walk()):
        return True
    size = len(text.encode())
    return size > 200 and sum(map(str.isalpha, text)) > size // 3


def render(root: Node) -> str:
    """Text of an element as light Markdown: headings, items, fenced code; blocks apart."""
    out: list[str] = []

    def block() -> None:
        if out and not out[-1].endswith("\n\n"):
            out.append("\n\n" if not out[-1].endswith("\n") else "\n")

    def visit(n: Node | str, depth: int) -> None:
        if isinstance(n, str):
            flat = re.sub(r"\s+", " ", n)
            if not out or out[-1].endswith("\n"):
                flat = flat.lstrip()
            if flat:
                out.append(flat)
            return
        if n.tag in ("script", "style", "title", "head"):
            return
        if n.tag == "br":
            out.append("\n")
            return
        if depth > 300:  # markup nested beyond any page's need
            visit(n.text(), depth)
            return
        if n.tag == "pre":
            block()
            out.append("```\n" + n.text().strip("\n") + "\n```\n\n")
            return
        is_block = n.tag in _BLOCKS
        if n.tag == "li":
            if out and not out[-1].endswith("\n"):
                out.append("\n")
            out.append("* ")
        elif n.tag in ("td", "th"):
            if out and not out[-1].endswith("\n"):
                out.append(" | ")
        elif is_block:
            block()
            if re.fullmatch("h[1-6]", n.tag):
                out.append("#" * int(n.tag[1]) + " ")
        for c in n.children:
            visit(c, depth + 1)
        if n.tag in ("li", "tr"):
            out.append("\n")
        elif is_block:
            block()

    visit(root, 0)
    return "".join(out).strip()


def language_of_code(n: Node, code: str) -> str | None:
    """Of the class (language-, lang-, highlight-), else a data attribute; words are looked at elsewhere."""
    for name in ("language-", "lang-", "highlight-"):
        if m := re.search(re.escape(name) + r"(\S+)", n.attrs.get("class", "")):
            return m[1]
    return n.attrs.get("data-lang") or n.attrs.get("data-language") or words_language(code)


def words_language(code: str) -> str | None:
    """The language whose words the code has, first in order."""
    low = code.lower()
    return next((name for name, groups in X.CODE_LANGUAGES if any(all(p in low for p in g) for g in groups)), None)


def context_of(n: Node) -> str | None:
    """First heading and explaining paragraphs of up to three elements around, joined by `` | ``."""
    found: list[str] = []
    up, depth = n.parent, 0
    while up is not None and depth < 3:
        heading = next((t for h in up.walk() if re.fullmatch("h[1-6]", h.tag) and (t := h.text().strip()) and len(t.encode()) < 100), None)
        if heading:
            found.append(f"Section: {heading}")
        for p in up.walk():
            if p.tag == "p":
                t = p.text().strip()
                if 30 < len(t.encode()) < 300 and any(x in t.lower() for x in EXPLAINS):
                    found.append(t)
                    if len(found) >= 2:
                        break
        up, depth = up.parent, depth + 1
    return " | ".join(dict.fromkeys(found)) or None


def code_blocks(root: Node) -> list[dict]:
    """Pieces of code of ten bytes and more, the outermost element of each, equal ones once."""
    found = select(root, CODE)
    out, seen = [], set()
    for n in found:
        if any(n is not o and n.within(o) for o in found):
            continue
        code = n.text().strip()
        if len(code.encode()) < 10 or code in seen:
            continue
        seen.add(code)
        inner = next((c for c in n.walk() if c.tag == "code"), n)
        near = n.parent.text() if n.parent is not None else ""
        near = near.lower() if len(near.encode()) < 500 else ""
        lang = next((x for c in (n, inner) for x in [language_of_code(c, "")] if x), None) or words_language(code)
        out.append({"code": code, "language": lang, "context": context_of(n), "usage_example": any(x in near for x in USAGE), "api_reference": any(x in near for x in API)})
    return out


def meta_of(root: Node) -> dict[str, str]:
    """Contents of the description, keywords and author tags; the last of a name counts."""
    out = {}
    for n in root.walk():
        if n.tag == "meta" and (name := n.attrs.get("name", "").lower()) in ("description", "keywords", "author"):
            out[name] = n.attrs.get("content")
    return out


def links_of(root: Node, url: str) -> list[str]:
    """Absolute targets of the links, without fragments, each once, in order."""
    base = next((n.attrs["href"] for n in root.walk() if n.tag == "base" and n.attrs.get("href")), "")
    out: dict[str, None] = {}
    for n in root.walk():
        if n.tag == "a" and n.attrs.get("href"):
            try:
                target = urldefrag(urljoin(urljoin(url, base), n.attrs["href"].strip()))[0]
                if urlsplit(target).scheme in ("http", "https"):
                    out[target] = None
            except ValueError:
                continue
    return list(out)


def extract(html: str | None, url: str | None) -> dict | None:
    """Record of a page; null of null. Whatever the markup, there is a result."""
    if html is None:
        return None
    url = url or ""
    root = parse(html)
    title, meta, links = title_of(root), meta_of(root), links_of(root, url)
    drop(root, UNWANTED)
    drop_boilerplate(root)
    main = main_content(root)
    return {"title": title, "markdown": render(main), "code_blocks": code_blocks(main), "links": links, "metadata": {"url": url, "description": meta.get("description"), "keywords": meta.get("keywords"), "author": meta.get("author"), "language": None, "framework": None, "version": None}}


@F.pandas_udf(EXTRACTED)
def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names = EXTRACTED.fieldNames()
    for html, url in batches:
        rows = [extract(h, u) or dict.fromkeys(names) for h, u in zip(html, url, strict=True)]
        yield pd.DataFrame({n: [r[n] for r in rows] for n in names})


def extract_page(html: Column, url: Column, compat: bool = False) -> Column:
    """Struct (title, markdown, code_blocks, metadata, links) of a page; nulls inside of a null page."""
    page = _extract(html, url)
    meta = page["metadata"]
    full = F.struct(
        meta["url"].alias("url"), meta["description"].alias("description"), meta["keywords"].alias("keywords"), meta["author"].alias("author"),
        X.url_language(url).alias("language"), X.framework(url, html).alias("framework"), F.lit(None).cast("string").alias("version"),
    )
    return F.struct(page["title"].alias("title"), X.clean_markdown(page["markdown"], compat).alias("markdown"), page["code_blocks"].alias("code_blocks"), full.alias("metadata"), page["links"].alias("links"))
