"""Problem 7: test items that leak into training text, by MinHash containment search.

A test item is searched for by its *windows*: all its runs of ``window`` words (the
whole item, if it is shorter). A document is searched in *passages* of twice the
window length that advance by one window length, so that every window that occurs
in a document lies wholly in at least one passage. MinHash of a small set against a
large one is hopeless as it stands; so windows are partitioned by their size, each
partition has passages of its own length, and within a partition both sides have
sizes that are known, which gives the number of hash functions for the wanted
recall: a window of w shingles in a passage of p has the passage's minimum in a
share w/p of the functions. Any one agreement makes a candidate (document, item),
which is verified on the exact runs of words of the whole text.

The windows' index is broadcast in blocks of items whose size is bounded; a test
set beyond one block takes several passes over the corpus.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.chars import Words, mix, mix1, run_hashes, slices

#: Words of test items in one broadcast index (some 60 MB at most).
INDEX_WORDS = 400_000


class Partition(NamedTuple):
    """Windows of ``low`` to ``high`` words; passages of ``2 * high`` words, one every ``high``."""

    low: int
    high: int
    shingle: int
    hashes: int
    values: list[np.ndarray]  # of each hash function: sorted minima of the windows
    items: list[tuple[np.ndarray, np.ndarray]]  # of each: items of each minimum, and their offsets


class Index(NamedTuple):
    partitions: list[Partition]
    exact: dict[int, tuple[np.ndarray, np.ndarray]]  # item -> sorted hashes of its windows, their length
    window: int


def size_classes(window: int, shingle: int) -> list[tuple[int, int, int]]:
    """(low, high, words of a shingle) of the window sizes from 1 to ``window``, a step of a quarter."""
    out, high = [], window
    while high:
        low = min(high, max(shingle, math.ceil(high * 0.78))) if high >= shingle else high
        out.append((low, high, min(shingle, low)))
        high = low - 1
    return out


def hashes_needed(low: int, high: int, shingle: int, recall: float) -> int:
    """Hash functions of which at least one agrees with probability ``recall`` for the smallest window."""
    share = (low - shingle + 1) / (2 * high - shingle + 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - share)) if share < 1 else 1


def _functions(k: int) -> list[np.uint64]:
    return [np.uint64(mix1(15485863 + i)) for i in range(k)]


def _minima(shingles: np.ndarray, first: np.ndarray, past: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Minimum of the seeded hash in each (overlapping) range of shingles; ranges are not empty."""
    h = mix(shingles ^ seed)
    bounds = np.empty(2 * len(first), np.int64)
    bounds[0::2], bounds[1::2] = first, past
    return np.minimum.reduceat(np.append(h, np.uint64(0)), bounds)[0::2]


def build_index(texts: list[str], window: int, shingle: int, recall: float) -> Index:
    """The windows of the items (numbered from 0) by size."""
    w = Words(texts)
    lengths = np.diff(w.offsets)
    exact: dict[int, tuple[np.ndarray, int]] = {}
    partitions = []
    for low, high, s in size_classes(window, shingle):
        mine = np.flatnonzero((np.minimum(lengths, window) >= low) & (np.minimum(lengths, window) <= high))
        if not len(mine):
            continue
        seeds = _functions(hashes_needed(low, high, s, recall))
        firsts, sizes, owner = [], [], []
        for i in mine.tolist():
            m = min(int(lengths[i]), window)
            at = np.arange(w.offsets[i], w.offsets[i + 1] - m + 1)
            exact[i] = (np.unique(run_hashes(w.hash, at, m)), m)
            firsts.append(at)
            sizes.append(np.full(len(at), m - s + 1))
            owner.append(np.full(len(at), i))
        first, size, own = np.concatenate(firsts), np.concatenate(sizes), np.concatenate(owner)
        shingles = run_hashes(w.hash, np.arange(len(w.hash) - s + 1), s)
        values, items = [], []
        for seed in seeds:
            pairs = np.unique(np.stack([_minima(shingles, first, first + size, seed), own.astype(np.uint64)], axis=1), axis=0)
            distinct, start = np.unique(pairs[:, 0], return_index=True)
            values.append(distinct)
            items.append((pairs[:, 1].astype(np.int64), np.append(start, len(pairs))))
        partitions.append(Partition(low, high, s, len(seeds), values, items))
    return Index(partitions, exact, window)


def candidate_items(w: Words, index: Index) -> dict[int, set[int]]:
    """Of each text of ``w``, the items of which a window may be in one of its passages."""
    out: dict[int, set[int]] = defaultdict(set)
    counts = np.diff(w.offsets)
    for p in index.partitions:
        # passages: every `high` words, the last one shorter; each at least one shingle long
        n = np.where(counts >= p.low, np.maximum(1, -(-(counts - p.low + 1) // p.high)), 0)
        total = int(n.sum())
        if not total:
            continue
        doc = np.repeat(np.arange(len(counts)), n)
        nth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        first = w.offsets[doc] + nth * p.high
        past = np.minimum(first + 2 * p.high, w.offsets[doc + 1]) - p.shingle + 1
        shingles = run_hashes(w.hash, np.arange(len(w.hash) - p.shingle + 1), p.shingle)
        for seed, values, (items, offsets) in zip(_functions(p.hashes), p.values, p.items, strict=True):
            low = _minima(shingles, first, past, seed)
            at = np.minimum(np.searchsorted(values, low), len(values) - 1)
            for k in np.flatnonzero(values[at] == low).tolist():
                out[int(doc[k])].update(items[offsets[at[k]] : offsets[at[k] + 1]].tolist())
    return out


def contained(df: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int = 13, shingle: int = 5, recall: float = 0.9999) -> DataFrame:
    """Distinct (id, item) of the texts that hold ``window`` consecutive words of an item, in a row and
    in order; of an item with fewer words, all its words.

    Null ids, null texts and texts without words take no part; repeated rows give one result row.
    Whole texts are searched. ``items`` is read to the driver in blocks of INDEX_WORDS words.
    """
    id_type, item_type = df.schema[id_col].dataType, items.schema[item_col].dataType
    known = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL").distinct()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    schema = T.StructType([T.StructField("id", id_type), T.StructField("item", item_type)])

    def search(block: list, texts: list[str]) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((build_index(texts, window, shingle, recall), pa.array(block, type=None)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, names = shared.value
            for b in batches:
                for start, part in slices(b.column(1).to_pylist()):
                    w = Words(part)
                    docs, hits = [], []
                    for d, maybe in candidate_items(w, index).items():
                        own = w.hash[w.offsets[d] : w.offsets[d + 1]]
                        runs: dict[int, np.ndarray] = {}
                        for i in maybe:
                            windows, m = index.exact[i]
                            if m > len(own):
                                continue
                            if m not in runs:
                                runs[m] = run_hashes(own, np.arange(len(own) - m + 1), m)
                            if np.isin(windows, runs[m]).any():
                                docs.append(start + d)
                                hits.append(i)
                    if docs:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs)), names.take(pa.array(hits)).cast(b_type)], ["id", "item"])

        from pyspark.sql.pandas.types import to_arrow_type

        b_type = to_arrow_type(item_type)
        return source.mapInArrow(run, schema)

    found, block, texts, size = None, [], [], 0
    for row in known.toLocalIterator():
        words = len(row.text) // 2 + 1  # at most so many words
        if block and size + words > INDEX_WORDS:
            part = search(block, texts)
            found, block, texts, size = (part if found is None else found.unionByName(part)), [], [], 0
        block.append(row.item)
        texts.append(row.text)
        size += words
    if block:
        part = search(block, texts)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], schema)
    return found.distinct().select(F.col("id").alias(id_col), F.col("item").alias(item_col))
