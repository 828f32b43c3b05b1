"""Problem 1: splitting oversized texts at natural boundaries.

Two ways to choose the cuts over the same boundaries:

``greedy``    each piece ends at the last boundary of the strongest kind in the upper half of
              its allowed length (the rule of this project's result ``p1_found``);
``balanced``  the minimum number of pieces is computed, equal targets are placed, each is snapped to the
              strongest nearby boundary, and a piece is added whenever the limit fails.

Positions are code points. The recurrence of cuts runs within a row; rows are independent, so
the operator is one narrow pass over Arrow batches without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.chars import SPACE, kinds

_HEADING = re.compile(r"#{1,6} ")
_SENTENCE = re.compile(r"[.!?] |[。！？]")
_GAP = re.compile(r"[ \t\n]")
_WHITE = "".join(chr(c) for c in range(0x3001) if kinds()[c] == SPACE)
PIECES = T.ArrayType(T.StructType([T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())]))


def boundaries(text: str) -> list[list[int]]:
    """Positions by kind, strongest first: (a) start of a heading line, (b) of a line after a blank one,
    (c) of any line, (d) after a sentence, all outside fences; (e) start of a line within a fence;
    (f) after a blank, tab or line end."""
    heading, paragraph, line_start, sentence, code = [], [], [], [], []
    fence, blank_before, at = "", False, 0
    for line in text.split("\n"):
        bare = line.strip(_WHITE)
        mark = bare[:3] if bare[:3] in ("```", "~~~") else ""
        opens = not fence and bool(mark)
        if fence:
            code.append(at)
        else:
            line_start.append(at)
            if _HEADING.match(line):
                heading.append(at)
            if bare and blank_before:
                paragraph.append(at)
            if not opens:
                sentence += [at + m.end() for m in _SENTENCE.finditer(line)]
        if opens:
            fence = mark
        elif fence and mark == fence:
            fence = ""
        blank_before = not bare
        at += len(line) + 1
    return [heading, paragraph, line_start, sentence, code, [m.end() for m in _GAP.finditer(text)]]


def greedy(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of at most ``limit`` characters; a piece takes the rest if that fits, else ends at the
    last position of the strongest kind beyond half the limit; the next begins ``overlap`` before it."""
    kinds_at, s, n, out = boundaries(text), 0, len(text), []
    while n - s > limit:
        low, high = s + limit // 2, s + limit
        for places in kinds_at:
            k = bisect_right(places, high)
            if k and places[k - 1] > low:
                e = places[k - 1]
                break
        else:
            e = high
        out.append((s, e))
        s = max(e - overlap, s + 1)  # moves on even if the overlap is half the limit or more
    out.append((s, n))
    return out


def _nearest(places: list[int], target: int, low: int, high: int) -> int | None:
    """The place from ``low`` to ``high`` that is nearest to ``target``, the earlier of two."""
    k = bisect_right(places, max(low, min(target, high)))
    near = [p for p in places[max(0, k - 1) : k + 1] if low <= p <= high]
    return min(near, key=lambda p: abs(p - target)) if near else None


def balanced(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The fewest pieces of nearly equal length: targets at equal distances, each snapped to the
    strongest boundary within a quarter of a piece (nearest of its kind), or else within all that the limit allows.

    Where what is left no longer fits the pieces that were planned, one is added, and the targets that are left are
    placed anew from there. Only a stretch without any boundary within the limit is cut elsewhere.
    """
    n, kinds_at = len(text), boundaries(text)
    overlap = min(overlap, limit - 1)
    fresh = limit - overlap  # new text that a piece can hold
    left, s, out = max(1, -(-(n - overlap) // fresh)), 0, []
    step = (n - overlap) / left
    target = overlap + step
    while n - s > limit:
        if (n - s - overlap) > left * fresh or left < 2:
            left = max(2, -(-(n - s - overlap) // fresh))
            step = (n - s - overlap) / left
            target = s + overlap + step
        goal = min(round(target), s + limit)
        first, last, reach = s + overlap + 1, s + limit, max(1, int(step / 4))
        # a cut before ``least`` would need another piece
        least = max(first, n - overlap - (left - 1) * fresh)
        for low, high in ((max(least, goal - reach), min(last, goal + reach)), (max(first, goal - reach), min(last, goal + reach)), (max(first, s + limit // 2), last), (first, last)):
            e = next((p for places in kinds_at if (p := _nearest(places, goal, low, high)) is not None), None)
            if e is not None:
                break
        else:
            e = max(first, goal)
        out.append((s, e))
        s, left, target = e - overlap, left - 1, target + step
    out.append((s, n))
    return out


METHODS = {"greedy": greedy, "balanced": balanced}


def split_oversized(
    df: DataFrame,
    limits: DataFrame,
    method: str = "balanced",
    id_col: str = "chunk_id",
    text_col: str = "content",
    key_col: str = "strategy",
    context_col: str | None = None,
    with_text: bool = False,
) -> DataFrame:
    """Pieces (id, start_char, end_char[, context][, piece]) of the rows longer than their limit.

    ``limits`` has one row (key_col, max_chars, overlap_chars) for each kind of row; of repeated
    kinds the smallest limit counts. A row whose text, id, kind or limit is null, whose limit is not
    positive, or whose text fits takes no part; a null or negative overlap counts as 0. Repeated rows
    give distinct results. Offsets are code points from 0, end exclusive.
    """
    cut_at = METHODS[method]
    id_type = df.schema[id_col].dataType
    lim = limits.groupBy(F.col(key_col).alias("_k")).agg(F.min(F.struct("max_chars", F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)).alias("overlap"))).alias("_l"))
    context = F.col(context_col).cast("string") if context_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), context.alias("context"), F.col(key_col).alias("_k"))
    rows = rows.join(lim, "_k").filter("id IS NOT NULL AND _l.max_chars > 0 AND char_length(text) > _l.max_chars")
    rows = rows.select("id", "text", "context", F.col("_l.max_chars").cast("int").alias("limit"), F.col("_l.overlap").cast("int").alias("overlap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, starts, ends, text_of = [], [], [], []
            for i, (text, limit, overlap) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                for s, e in cut_at(text, limit, overlap):
                    who.append(i)
                    starts.append(s)
                    ends.append(e)
                    if with_text:
                        text_of.append(text[s:e])
            at = pa.array(who, pa.int64())
            cols = [b.column(0).take(at), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), b.column(2).take(at)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(text_of if with_text else [None] * len(who), pa.string())], ["id", "start_char", "end_char", "context", "piece"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("context", T.StringType()), T.StructField("piece", T.StringType())])
    keep = ["id", "start_char", "end_char", *(["context"] if context_col else []), *(["piece"] if with_text else [])]
    out = rows.mapInArrow(run, schema).select(*keep).distinct().withColumnRenamed("id", id_col)
    return out.withColumnRenamed("context", context_col) if context_col else out
