"""Problem 4: lines repeated across the documents of one source.

PrefixSpan over the documents' sequences of line identifiers, source by source.
Its first level (frequent single lines) is one aggregation over pre-distinct
identifiers. Frequent lines that never come but one right after the other (those of one notice) are then one
item, so that a notice of n lines is one pattern, not 2 ** n. Later levels grow a pattern by the items that follow its first
match (the projected database), again one aggregation a level, until none is frequent. The
occurrences to delete are the places of the lines of all frequent sequences.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import let
from docmill.plans.lineage import cut
from docmill.plans.sizing import small_side

#: Unicode White_Space, for Java's regular expressions.
WHITE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Documents of a source that meet its frequent lines in one part, where these are joined by shuffle.
PART_DOCS = 50_000


def host_of(url: Column) -> Column:
    """Host of a url: after ``://`` up to the next ``/ : ? #`` or the end, lower case, without ``www.``; null if none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"://([^/:?#]*)", 1)), r"^www\.", "")
    return F.when(host != "", host)


def line_key(line: Column) -> Column:
    """The line in lower case, digits as one 0, white space as one space, trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), WHITE + "+", " "), F.lit(" "))


#: Values (of 8 bytes) of the sources' arrays that are broadcast at most.
BROADCAST_VALUES = 400_000
#: At least three words, a word being a longest run of letters and digits.
THREE_WORDS = r"[\p{L}\p{N}]+[^\p{L}\p{N}]+[\p{L}\p{N}]+[^\p{L}\p{N}]+[\p{L}\p{N}]"


class RepeatedLines(NamedTuple):
    found: DataFrame  # id, line_no
    sequences: DataFrame  # source, lines array<long>, support
    cleaned: DataFrame  # id, text


class SourceLines:
    """The line sequences of a table of documents, by source.

    A null id or a null source takes no part. Of rows with the same id one counts: that with the
    latest ``order_col`` (nulls first; ties by text), so results don't depend on the order of rows.
    Documents without text count among those of their source.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, source: Column, order_col: str | None = None, min_docs: int = 4, min_share: float = 0.05):
        self.min_docs, self.min_share = min_docs, min_share
        order = F.col(order_col) if order_col else F.lit(0)
        rows = df.select(F.col(id_col).alias("id"), source.alias("source"), F.col(text_col).cast("string").alias("text"), order.alias("at")).filter("id IS NOT NULL AND source IS NOT NULL")
        self.rows = rows
        keys = F.transform(F.transform(F.split("text", "\n", -1), line_key), lambda x: F.when(x.rlike(THREE_WORDS), F.xxhash64(x)))
        hashed = rows.select("id", F.struct("at", F.xxhash64("text").alias("h"), "source", keys.alias("keys")).alias("r"))
        # no text beyond this point: 8 bytes a line
        self.docs = cut(hashed.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.source", "r.h", "r.keys"))

    def frequent(self) -> DataFrame:
        """source, key, support: lines held by enough documents of their source."""
        totals = self.docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
        single = self.docs.select("source", F.explode(F.array_distinct(F.filter("keys", lambda x: x.isNotNull()))).alias("key"))
        support = single.groupBy("source", "key").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= self.min_docs)
        return support.join(totals, "source").filter(F.col("support") >= F.col("docs") * self.min_share).select("source", "key", "support", "docs")

    def beside(self, per_source: DataFrame, column: str) -> DataFrame:
        """The documents with the array ``column`` of ``per_source`` (source, column).

        A source has at most ``1 / min_share`` times its documents' mean number of lines of them, so they
        go along as one array. Where all arrays together are too large for a broadcast, the documents of a source
        are dealt to a part for each PART_DOCS of them, so that a source with a third of all rows is not one task.
        """
        size = per_source.agg(F.coalesce(F.sum(F.size(column) + 4), F.lit(0))).first()[0]
        if size <= BROADCAST_VALUES:
            return self.docs.join(small_side(per_source, 0), "source")
        parts = cut(self.docs.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / PART_DOCS).cast("int").alias("parts")).filter("parts > 1"))
        large = small_side(parts, parts.count())  # at most one for each PART_DOCS documents
        of_part = F.coalesce("parts", F.lit(1))
        dealt = per_source.join(large, "source", "left").withColumn("part", F.explode(F.sequence(F.lit(0), of_part - 1))).drop("parts")
        docs = self.docs.join(large, "source", "left").withColumn("part", F.pmod(F.xxhash64("id"), of_part).cast("int")).drop("parts")
        return docs.join(dealt, ["source", "part"]).drop("part")

    def places(self) -> DataFrame:
        """Distinct (id, line_no) of the lines of frequent sequences."""
        return self._at(self.repeated()).select("id", F.explode("at").alias("line_no"))

    def repeated(self) -> DataFrame:
        """source, frequent: the lines of the frequent sequences of each source."""
        lines = self.sequences().select("source", F.explode("lines").alias("key"))
        return cut(lines.groupBy("source").agg(F.collect_set("key").alias("frequent")))

    def _at(self, per_source: DataFrame) -> DataFrame:
        """id, h, at: the places of the lines that are in ``frequent`` of the source."""

        def among(hits: Column) -> Column:
            return F.filter(F.transform("keys", lambda x, i: F.when(F.array_contains(hits, x), (i + 1).cast("long"))), lambda x: x.isNotNull())

        return self.beside(per_source, "frequent").select("id", "h", let(F.array_intersect("keys", "frequent"), among).alias("at"))

    def items(self) -> DataFrame:
        """id, source, docs, items: each document's frequent lines in order, as units of lines that always come together."""
        per_source = cut(self.frequent().groupBy("source").agg(F.collect_list("key").alias("frequent"), F.first("docs").alias("docs")))
        kept = let(F.array_intersect("keys", "frequent"), lambda hits: F.filter("keys", lambda x: F.array_contains(hits, x)))
        rows = cut(self.beside(per_source, "frequent").select("id", "source", "docs", kept.alias("rest")).filter("size(rest) > 0"))
        # a line that comes whenever, and only where, the line before has come joins that line's unit
        each = rows.select("source", F.explode("rest").alias("key")).groupBy("source", "key").agg(F.count(F.lit(1)).alias("times"))
        steps = F.zip_with(F.slice("rest", 1, F.size("rest") - 1), F.slice("rest", 2, F.size("rest") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        after = rows.filter("size(rest) > 1").select("source", F.explode(steps).alias("s")).groupBy("source", "s.a", "s.b").agg(F.count(F.lit(1)).alias("both"))
        tied = after.join(each.select("source", F.col("key").alias("a"), F.col("times").alias("times_a")), ["source", "a"]).join(each.select("source", F.col("key").alias("b"), F.col("times").alias("times_b")), ["source", "b"])
        tails = cut(tied.filter("both = times_a AND both = times_b").groupBy("source").agg(F.collect_set("b").alias("tails")))
        held = rows.join(small_side(tails, 0), "source", "left") if self._values(tails) <= BROADCAST_VALUES else rows.join(tails, "source", "left")
        tail_of = F.coalesce("tails", F.array().cast("array<long>"))
        heads = held.select("id", "source", "docs", "rest", F.filter(F.transform("rest", lambda x, i: F.when(~F.array_contains(tail_of, x), i + 1)), lambda x: x.isNotNull()).alias("heads"))
        units = F.transform("heads", lambda at, i: F.slice("rest", at, F.coalesce(F.get("heads", i + 1), F.size("rest") + 1) - at))
        return cut(heads.select("id", "source", "docs", units.alias("items")))

    @staticmethod
    def _values(tails: DataFrame) -> int:
        return tails.agg(F.coalesce(F.sum(F.size("tails") + 4), F.lit(0))).first()[0]

    def sequences(self, max_length: int | None = None) -> DataFrame:
        """Frequent sequences (in order, gaps allowed) of any number of items, or of up to ``max_length``: source, lines, support.

        An item is a line, or the lines of a unit that always come together; parts of a unit are as frequent as the unit and
        aren't listed besides it.
        """
        level = self.items().select("id", "source", "docs", F.array().cast("array<long>").alias("lines"), F.col("items").alias("rest"))
        out = None
        for depth in itertools.count():
            grown = level.select("id", "source", "docs", "lines", "rest", F.explode(F.array_distinct("rest")).alias("item"))
            support = grown.groupBy("source", "lines", "item").agg(F.count(F.lit(1)).alias("support"), F.first("docs").alias("docs"))
            support = cut(support.filter((F.col("support") >= self.min_docs) & (F.col("support") >= F.col("docs") * self.min_share)))
            n = support.count()
            here = support.select("source", F.concat("lines", "item").alias("lines"), "support")
            out = here if out is None else out.unionByName(here)
            if not n or depth + 1 == max_length:
                break
            # the projected database: what follows the first match of the grown pattern
            tail = F.expr("slice(rest, cast(array_position(rest, item) as int) + 1, size(rest))")
            kept = grown.join(small_side(support.select("source", "lines", "item"), n), ["source", "lines", "item"], "left_semi")
            level = cut(kept.select("id", "source", "docs", F.concat("lines", "item").alias("lines"), tail.alias("rest")).filter("size(rest) > 0"))
        return out

    def cleaned(self) -> DataFrame:
        """(id, text) of every document with a source: its text without the occurrences, otherwise untouched."""
        gone = self._at(self.repeated()).select("id", "h", F.col("at").alias("gone"))
        text = self.rows.select("id", "text", F.xxhash64("text").alias("h"))
        whole = text.join(self.docs.select("id", "h"), ["id", "h"], "left_semi").dropDuplicates(["id"]).join(gone.select("id", "gone"), "id", "left")
        lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", (i + 1).cast("long")))
        return whole.select("id", F.when(F.size("gone") > 0, F.array_join(lines, "\n")).otherwise(F.col("text")).alias("text"))
