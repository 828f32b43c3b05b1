"""Chunkers: fixed windows, paragraphs, headings, and that of crawled pages.

Where the next cut depends on the last one, a text is folded in Python (one narrow
pass over Arrow batches); everything that looks at neighbouring chunks is a window,
and filters and hashes are expressions. Lengths are characters, except where a limit is
given in tokens or bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.operators.dedup import first_of_each
from docmill.plans.tables import dealt
from docmill.schema import ChunkStrategy, CrawlChunks, FixedSize, HeadingBased, Semantic

_HEADING = re.compile(r"(#{1,6}) (.*)")
_UNDERLINE = re.compile(r"[=-]{3,}")
_SECTION = re.compile(r"(?m)^(?=#{1,3}\s+.+$)")
_FIRST_HEADING = re.compile(r"(?m)^#{1,3}\s+(.+)$")

Piece = tuple[int, int, str, str | None, str | None]  # start, end, content, heading, context


def fixed_pieces(text: str, size: int, overlap: int) -> list[Piece]:
    """Windows of ``size`` that end after the last sentence or line end in them; the next begins
    ``overlap`` before, at least one character further on. A text that fits is one piece."""
    n, start, out = len(text), 0, []
    while start < n:
        end = min(n, start + size)
        if end < n:
            last = max(text.rfind(c, start, end) for c in ".!?\n")
            end = last + 1 if last >= 0 else end
        out.append((start, end, text[start:end], None, None))
        if end == n:
            break
        start = max(end - overlap, start + 1)
    return out


def paragraph_pieces(text: str, max_size: int, min_size: int) -> list[Piece]:
    """Paragraphs joined up to ``max_size``; pieces below ``min_size`` wait for more, the last such is dropped."""
    out, held, at = [], [], 0

    def size() -> int:
        return sum(len(p) for _, p in held) + 2 * max(0, len(held) - 1)

    def flush() -> None:
        if held:
            out.append((held[0][0], held[-1][0] + len(held[-1][1]), "\n\n".join(p for _, p in held), None, None))
            held.clear()

    for part in text.split("\n\n"):
        if part.strip():
            if held and size() >= min_size and size() + len(part) + 2 > max_size:
                flush()
            held.append((at, part))
            if len(part) >= max_size:
                flush()
        at += len(part) + 2
    if size() >= min_size:
        flush()
    return out


def heading_of(line: str) -> tuple[int, str]:
    """(level, text) of a trimmed line; level 0 of one that isn't a heading."""
    if m := _HEADING.match(line):
        return len(m[1]), m[2].strip()
    if _UNDERLINE.fullmatch(line):
        return (1 if "=" in line else 2), ""
    return 0, line


def heading_pieces(text: str, max_size: int, min_size: int, keep_small: bool = False) -> list[Piece]:
    """A section for each heading, with the trail of headings above it. A section beyond ``max_size`` goes on
    in further pieces without a heading of their own; one below ``min_size`` is dropped at the next heading
    (or, with ``keep_small``, goes before it)."""
    out: list[Piece] = []
    trail: list[str] = []
    held, start, heading, context, at = "", 0, None, None, 0
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        level, name = heading_of(bare.strip())
        if level:
            if len(held) >= min_size and held:
                out.append((start, at, held, heading, context))
                held = ""
            elif not keep_small:
                held = ""
            del trail[level - 1 :]
            trail.append(name)
            heading, context = name, " > ".join(trail)
            if not held:
                start = at
            held += bare.strip() + "\n"
        else:
            if held and len(held) + len(bare) + 1 > max_size and len(held) >= min_size:
                out.append((start, at, held, heading, context))
                held, heading = "", None
            if not held:
                start = at
            held += ("\n" if held else "") + bare
        at += len(line)
    if held and len(held) >= min_size:
        out.append((start, at, held, heading, context))
    return out


def _tokens(text: str) -> int:
    return len(text.encode("utf-8", "replace")) // 4


def section_pieces(text: str, max_tokens: int) -> list[Piece]:
    """Sections at headings of level 1 to 3, those beyond ``max_tokens`` (a quarter of the bytes) by paragraphs; a
    paragraph is never split."""
    out: list[Piece] = []
    at = 0
    for section in _SECTION.split(text):
        if section.strip():
            if _tokens(section) <= max_tokens:
                out.append((at, at + len(section), section, None, None))
            else:
                held, first, place = "", at, at
                for part in section.split("\n\n"):
                    if part.strip():
                        if held and _tokens(held) + _tokens(part) > max_tokens:
                            out.append((first, place, held, None, None))
                            held = ""
                        if not held:
                            first = place
                        held += part + "\n\n"
                    place += len(part) + 2
                if held:
                    out.append((first, at + len(section), held, None, None))
        at += len(section)
    named = []
    for start, end, content, _, _ in out:
        m = _FIRST_HEADING.search(content)
        named.append((start, min(end, len(text)), content, None, m[1].strip() or None if m else None))
    return named


def pieces(text: str, strategy: ChunkStrategy) -> list[Piece]:
    match strategy:
        case FixedSize(size, overlap):
            return fixed_pieces(text, size, overlap)
        case Semantic(most, least):
            return paragraph_pieces(text, most, least)
        case HeadingBased(most, least, keep):
            return heading_pieces(text, most, least, keep)
        case CrawlChunks(most):
            return section_pieces(text, most)
    raise TypeError(f"no such strategy: {strategy!r}")


def cut(df: DataFrame, strategy: ChunkStrategy, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, n, start_char, end_char, content, heading, heading_context) of all pieces in order of the text.

    Null ids and texts take no part; an empty text has no pieces.
    """
    id_type = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, cols = [], [[] for _ in range(6)]
            for i, t in enumerate(b.column(1).to_pylist()):
                for n, p in enumerate(pieces(t, strategy)):
                    who.append(i)
                    for c, v in zip(cols, (n, *p), strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n", "start_char", "end_char", "content", "heading", "heading_context"])

    return rows.mapInArrow(run, f"id {id_type}, n long, start_char long, end_char long, content string, heading string, heading_context string")


def numbered(df: DataFrame, by: str = "id", order: str = "n") -> DataFrame:
    """``position`` from 0 among the chunks that are left of each document."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)


def first_contents(rows: DataFrame, across: bool) -> DataFrame:
    """Of chunks with equal contents the first, in each document or in all of them.

    Within a document it is a window, for which chunks that lie by document need no further shuffle.
    """
    if across:
        return first_of_each(rows, F.struct("content_hash"), ["id", "n"])
    rank = F.row_number().over(Window.partitionBy("id", "content_hash").orderBy("n"))
    return rows.withColumn("_nth", rank).filter("_nth = 1").drop("_nth")


def chunk(df: DataFrame, strategy: ChunkStrategy, id_col: str = "id", text_col: str = "content", across: bool = False) -> DataFrame:
    """(id, position, content, heading, heading_context, has_code, content_hash, start_char, end_char).

    Content is trimmed; blank chunks go; of equal ones in a document (with ``across``, in all documents: by id and
    place) the first stays. Positions count what is left.
    """
    if isinstance(strategy, CrawlChunks):
        return crawl_chunks(df, strategy, id_col, text_col, across)
    rows = cut(df, strategy, id_col, text_col).withColumn("content", X.trim(F.col("content"))).filter("content <> ''")
    rows = rows.withColumn("content_hash", X.content_hash(F.col("content")))
    rows = rows if across else dealt(rows, "id")
    kept = numbered(first_contents(rows, across))
    out = kept.select("id", F.col("position").cast("long").alias("position"), "content", "heading", "heading_context", X.has_code(F.col("content")).alias("has_code"), "content_hash", "start_char", "end_char")
    return out.withColumnRenamed("id", id_col)


def overlap_before(previous: Column, lines: int) -> Column:
    """The previous chunk's last ``lines`` lines, trimmed, if they say something; else null."""

    def last(x: Column) -> Column:
        n = F.least(F.size(x), F.lit(lines))
        return X.trim(F.array_join(F.slice(x, F.size(x) - n + 1, n), "\n"))

    def judge(tail: Column) -> Column:
        return F.when((F.octet_length(tail) > 20) & (F.regexp_replace(tail, f"{X.PUNCTUATION}|{X.SPACE}", "") != ""), tail)

    return F.when(previous.isNotNull() & F.lit(lines > 0), X.let(X.let(X.text_lines(previous), last), judge))


def overlap_after(content: Column, following: Column) -> Column:
    """The next chunk's first three lines, trimmed, if this one ends within a thought; else null."""
    head = X.trim(F.array_join(F.slice(X.text_lines(following), 1, 3), "\n"))
    return F.when(following.isNotNull() & X.needs_next(content), X.let(head, lambda x: F.when(F.octet_length(x) > 20, x)))


def with_overlap(df: DataFrame, by: str, order: str, content_col: str = "content", overlap: int = 200) -> DataFrame:
    """Chunks with context of the one before and after in the same document."""
    w = Window.partitionBy(by).orderBy(order)
    c = F.col(content_col)
    sided = df.withColumn("_before", F.lag(c).over(w)).withColumn("_after", F.lead(c).over(w))
    before = overlap_before(F.col("_before"), overlap // 10)
    after = overlap_after(c, F.col("_after"))
    joined = F.concat(F.coalesce(F.concat(F.lit("..."), before, F.lit("\n\n")), F.lit("")), c, F.coalesce(F.concat(F.lit("\n\n"), after, F.lit("...")), F.lit("")))
    # exploded, so that what reads the content doesn't compute it again for each time it names it
    names = [c for c in df.columns if c != content_col]
    return sided.select(*names, F.explode(F.array(joined)).alias(content_col)).select(*df.columns)


def crawl_chunks(df: DataFrame, strategy: CrawlChunks | None = None, id_col: str = "id", text_col: str = "content", across: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """Chunks of crawled pages: sections, good ones only, with overlap, each normalised content once.

    Offsets are those of the section in the text, before overlap. ``seen`` holds hashes (column ``hash``)
    of earlier sessions, whose chunks go as well.
    """
    strategy = strategy or CrawlChunks()
    rows = cut(df, strategy, id_col, text_col).filter(X.is_quality(F.col("content"), strategy.min_bytes))
    rows = dealt(rows.withColumn("has_code", X.contains_code(F.col("content"))), "id")
    lapped = with_overlap(rows, "id", "n", overlap=strategy.overlap).filter(X.is_quality(F.col("content"), strategy.min_bytes))
    lapped = lapped.withColumn("content_hash", X.normalized_hash(F.col("content")))
    if seen is not None:
        lapped = lapped.join(seen.select(F.col("hash").alias("content_hash")), "content_hash", "left_anti")
    kept = numbered(first_contents(lapped, across))
    out = kept.select("id", F.col("position").cast("long").alias("position"), "content", "heading", "heading_context", "has_code", "content_hash", "start_char", "end_char")
    return out.withColumnRenamed("id", id_col)
