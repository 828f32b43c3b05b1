"""Text functions as column expressions (no Python workers)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space in Java's regular expressions.
SPACE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SET = SPACE[1:-1]
_SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: ASCII punctuation.
PUNCTUATION = r"[!-/:-@\[-`{-~]"

#: Marks of navigation within a chunk.
NAVIGATION = ("skip to", "toggle", "menu", "navigation", "breadcrumb", "| next |", "| previous |", "| index |", "table of contents")
#: Marks of navigation within a short line.
NAVIGATION_LINES = ("| |", "* |", "navigation", "table of contents", "skip to", "toggle", "menu", "index | modules | next | previous |")
#: What makes a chunk of a crawled page one with code.
CODE_MARKS = ("```", "    ", "\t", "function", "class", "def ", "const ", "let ", "var ")
#: What makes any other chunk one with code.
PLAIN_CODE_MARKS = ("```", "    ", "\t")
#: Fixed values, in order: language of a page by its url.
URL_LANGUAGES = (("Python", ("python", "/py/")), ("JavaScript", ("javascript", "/js/")), ("TypeScript", ("typescript", "/ts/")), ("Rust", ("rust", "/rs/")), ("Java", ("java",)), ("C#", ("csharp", "/cs/")), ("Go", ("golang", "/go/")))
#: Fixed values, in order: framework of a page by its url and by its content.
FRAMEWORKS = (("React", "react", "react.js"), ("Vue", "vue", "vue.js"), ("Angular", "angular", None), ("Django", "django", None), ("Flask", "flask", None), ("Rails", "rails", None), ("Tokio", "tokio", None))
#: Fixed values, in order: language of a piece of code by what it contains (all of a group).
CODE_LANGUAGES = (
    ("rust", (("fn main()",), ("use std::",), ("cargo ",))),
    ("python", (("def ",), ("import ",), ("pip ",))),
    ("javascript", (("function ",), ("const ",), ("npm ",), ("yarn ",))),
    ("java", (("public class",), ("import java",))),
    ("bash", (("curl ",), ("wget ",), ("sudo ",))),
    ("sql", (("select ",), ("insert ",), ("create table",))),
    ("html", (("<!doctype",), ("<html",))),
    ("typescript", (("interface ",), ("type ", "="))),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether the text contains one of ``parts``; null of null."""
    return reduce(lambda a, b: a | b, (c.contains(p) for p in parts))


def trim(c: Column) -> Column:
    """Without white space (any Unicode) at both ends."""
    return F.btrim(c, F.lit(_SPACES))


def is_blank(c: Column) -> Column:
    return trim(c) == ""


def tokenize(c: Column) -> Column:
    """Tokens: lower case, split at white space, without characters other than letters and digits at the ends."""
    # one pass over the text: runs of other characters that stand next to white space or an end
    other = r"[^\p{IsAlphabetic}\p{N}\s]+"
    bare = F.regexp_replace(F.lower(c), rf"(?U)(?<!\S){other}|{other}(?!\S)", "")
    return F.filter(F.split(bare, SPACE + "+"), lambda x: x != "")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return F.floor(F.octet_length(c) / 4).cast("long")


def contains_code(c: Column) -> Column:
    """Whether a chunk of a crawled page holds code."""
    return contains_any(c, CODE_MARKS)


def has_code(c: Column) -> Column:
    """Whether a chunk, trimmed, holds code."""
    return contains_any(trim(c), PLAIN_CODE_MARKS)


def first_heading(c: Column) -> Column:
    """Text of the first heading of level 1 to 3; null if there is none."""
    return F.nullif(trim(F.regexp_extract(c, r"(?md)^#{1,3}\s+(.+)$", 1)), F.lit(""))


def heading_level(line: Column) -> Column:
    """Level of a (trimmed) line as a heading: number of ``#``; 1 or 2 of an underline; 0 of any other line."""
    underline = line.rlike(r"^[=-]{3,}$")
    return F.when(line.rlike(r"^#{1,6} "), F.length(F.regexp_extract(line, r"^(#{1,6}) ", 1))).when(underline & line.contains("="), 1).when(underline, 2).otherwise(0)


def heading_text(line: Column) -> Column:
    """Text of a heading line; empty of an underline."""
    return F.when(line.rlike(r"^#{1,6} "), trim(F.regexp_replace(line, r"^#{1,6} ", ""))).when(line.rlike(r"^[=-]+$"), "").otherwise(line)


def normalized(c: Column) -> Column:
    """Trimmed, in lower case, white space as one space."""
    return F.regexp_replace(F.lower(trim(c)), SPACE + "+", " ")


def content_hash(c: Column) -> Column:
    """Hash of the trimmed text."""
    return F.sha2(trim(c), 256)


def normalized_hash(c: Column) -> Column:
    """Hash that ignores case and white space."""
    return F.sha2(normalized(c), 256)


def alphabetic_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{IsAlphabetic}]", ""))


def punctuation_count(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, PUNCTUATION, ""))


def text_lines(c: Column) -> Column:
    """Lines of a text without their ends; a line end at the very end begins no further line."""
    return F.split(F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\n$", ""), "\n", -1)


def is_quality(c: Column, min_bytes: int = 100) -> Column:
    """Whether a chunk is worth keeping: long enough, a third of letters, no mark of navigation, no more
    punctuation than letters, and not mostly repeated lines. Null of null."""

    def judge(t: Column) -> Column:
        size = F.octet_length(t)
        repeated = let(text_lines(t), lambda x: (F.size(x) > 1) & (F.size(F.array_distinct(x)) < F.floor(F.size(x) / 2)))
        lettered = let(alphabetic_count(t), lambda n: (n >= F.floor(size / 3)) & (punctuation_count(t) <= n))
        return (size >= min_bytes) & lettered & ~let(F.lower(t), lambda low: contains_any(low, NAVIGATION)) & ~repeated

    return let(trim(c), judge)


def needs_next(c: Column) -> Column:
    """Whether a chunk ends within a thought, so that the next one's beginning helps."""
    return c.endswith(":") | c.endswith("following") | c.endswith("example") | c.endswith("see") | c.contains("continued") | c.contains("next section")


def preview(c: Column, size: int = 200) -> Column:
    """The first ``size`` characters."""
    return F.substring(c, 1, size)


def url_language(url: Column) -> Column:
    """Programming language that the url names; null if none."""
    u = F.lower(url)
    out = None
    for name, parts in URL_LANGUAGES:
        hit = contains_any(u, parts)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def framework(url: Column, content: Column) -> Column:
    """Framework that the url or the content names; null if none."""
    u, text = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    out = None
    for name, in_url, in_text in FRAMEWORKS:
        hit = u.contains(in_url) | text.contains(in_text) if in_text else u.contains(in_url)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def code_language(code: Column) -> Column:
    """Programming language of a piece of code by its words; null if none fits."""
    low = F.lower(code)
    out = None
    for name, groups in CODE_LANGUAGES:
        hit = reduce(lambda a, b: a | b, (reduce(lambda x, y: x & y, (low.contains(p) for p in g)) for g in groups))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def chunk_id(url: Column, index: Column, style: str = "page") -> Column:
    """``{url}_chunk_{i}`` of crawled pages, ``{url}_{i}`` of documents added through the service."""
    return F.concat(url, F.lit("_chunk_" if style == "page" else "_"), index.cast("string"))


def chunk_tags(code: Column, index: Column, total: Column) -> Column:
    """``has-code`` or ``no-code``, and ``chunk-i-of-n`` from 1."""
    return F.array(F.when(code, "has-code").otherwise("no-code"), F.concat(F.lit("chunk-"), (index + 1).cast("string"), F.lit("-of-"), total.cast("string")))


def source_of(url: Column) -> Column:
    """The url, or ``local`` where it is empty or null."""
    return F.when(F.coalesce(url, F.lit("")) == "", "local").otherwise(url)


def clean_markdown(c: Column, compat: bool = False) -> Column:
    """Text of a page without lines of navigation, of fewer than three bytes, or mostly of punctuation.

    Single blank lines and bare fences stay, so that paragraphs and code keep their bounds;
    with ``compat`` they go as any other short line.
    """
    squeezed = F.regexp_replace(c, "\n{3,}", "\n\n")

    def keep(raw: Column) -> Column:
        return let(trim(raw), judge)

    def judge(line: Column) -> Column:
        navigation = contains_any(F.lower(line), NAVIGATION_LINES) & (F.octet_length(line) < 50)
        code = contains_any(line, ("def ", "function", "class "))
        kept = (F.octet_length(line) >= 3) & ~navigation & ((alphabetic_count(line) > punctuation_count(line)) | code)
        return kept if compat else kept | (line == "") | line.rlike("^(```|~~~)[A-Za-z0-9+#-]*$")

    joined = F.array_join(F.filter(text_lines(squeezed), keep), "\n")
    fences = F.regexp_replace(joined, "``` {1,2}\n", "```\n")
    return trim(F.regexp_replace(fences, "\n{3,}", "\n\n"))


def split_headers(c: Column) -> Column:
    """Sections that begin at headings of level 1 to 3 (and what comes before the first); no blank ones."""
    return F.filter(F.split(c, r"(?md)(?=^#{1,3}\s+.+$)", -1), lambda x: ~is_blank(x))


def split_paragraphs(c: Column) -> Column:
    """Parts between empty lines that aren't blank."""
    return F.filter(F.split(c, "\n\n", -1), lambda x: ~is_blank(x))


def code_spans(c: Column) -> Column:
    """Fenced blocks of a text, with their fences."""
    return F.regexp_extract_all(c, F.lit("(?s)(```.*?```)"), F.lit(1))
