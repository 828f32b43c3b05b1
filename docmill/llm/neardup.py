"""Problem 2: near-duplicate texts by a chosen-path join.

A text is the set of its runs of consecutive words. Each run of the join gives a
text the paths of those tokens whose seeded hash falls below ``picks / set size``,
so that two similar sets choose shared tokens together. Tokens that many texts hold (a site's template)
lead all of them into the same buckets; so a text takes more of its other tokens, and common ones only if what they
make up of it could be most of what it shares with another (see :func:`rare_share`). Texts that meet on a path
form a bucket. Small buckets are compared by brute force (size bound, then 1-bit
minwise sketches), those up to WHOLE times as large in blocks, each against each.
Larger ones are split again on further sampled tokens, level by level, each with
the number of children that keeps the target recall; where a split doesn't pay, and
after the last level, a bucket is compared in blocks, so no bucket is ever cut off.
The number of runs follows from the target recall too. Each candidate pair is verified
on the exact sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.chars import Words, mix, mix1, slices
from docmill.plans.lineage import cut
from docmill.plans.sizing import small_side

SKETCH_BITS = 256
#: Times the size of a small bucket up to which a bucket is compared whole, in blocks.
WHOLE = 8
#: Least part of what two texts must share that their rare tokens have to make up for the common ones to be left aside.
RARE_SHARE = 0.08
#: Share of the texts from which a token is common.
COMMON_SHARE = 0.01
#: Tokens that a worker counts at once.
COUNTED_TOKENS = 1 << 21
#: Characters whose arrays stay near the core while texts become tokens.
NEAR_CHARS = 1 << 16
_TOP = float(2**64)


class NearDuplicates(NamedTuple):
    pairs: DataFrame  # a, b, similarity: of different texts, by their representatives
    members: DataFrame  # id, rep: every text considered, with the smallest id of its exact copies


def runs_needed(threshold: float, picks: float, target: float) -> int:
    """Independent runs after which a pair at the threshold has met with probability ``target``.

    Two sets of similarity t share at least t times the larger set, so they share ``picks * t``
    chosen tokens on average and none with probability at most exp(-picks * t).
    """
    return max(1, math.ceil(math.log(1 - target) / (-picks * threshold)))


def children_needed(threshold: float, picks: float, runs: int, target: float) -> float | None:
    """Mean number of children of a split bucket with which a pair at the threshold still meets with probability
    ``target`` after any number of splits; None if the runs leave no room for splits.

    A shared path has Poisson(m) shared children, m at least ``threshold * children``. The chance q that all that
    comes of it dies out obeys q = exp(-m * (1 - q)), and the pair is missed with probability at most
    exp(-runs * picks * threshold * (1 - q)). Half of the room is kept for the sampling of the spare tokens.
    """
    q = (1 - math.log(1 - target) / (-runs * picks * threshold)) / 2
    return -math.log(q) / (1 - q) / threshold if q >= 0.01 else None


def token_sets(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text end to end, sorted within it, offsets, number of words of each text)."""
    sets, sizes, words = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], [np.empty(0, np.int64)]
    for _, part in slices(texts, NEAR_CHARS):
        w = Words(part)
        runs, offsets = w.runs(shingle)
        for i in range(len(part)):
            runs[offsets[i] : offsets[i + 1]].sort()
        new = np.ones(len(runs), bool)
        new[1:] = runs[1:] != runs[:-1]
        new[offsets[:-1][np.diff(offsets) > 0]] = True
        sets.append(runs[new])
        sizes.append(np.diff(np.concatenate([[0], np.cumsum(new)])[offsets]))
        words.append(np.diff(w.offsets))
    return np.concatenate(sets), np.cumsum(np.concatenate(sizes)), np.concatenate(words)


def sketches(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of SKETCH_BITS/8 bytes for each (non-empty) set: the lowest bits of its minwise hashes."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    low = (tokens >> np.uint64(32)).astype(np.uint32) ^ tokens.astype(np.uint32)
    bits = np.empty((SKETCH_BITS, len(offsets) - 1), np.uint8)
    with np.errstate(over="ignore"):
        for k in range(SKETCH_BITS):
            h = low * np.uint32(int(rng.integers(0, 1 << 31)) * 2 + 1)
            bits[k] = (np.minimum.reduceat(h, offsets[:-1]) >> np.uint32(7)) & np.uint32(1)
    return np.packbits(bits.T, axis=1)


def _chosen(tokens: np.ndarray, rate: np.ndarray, seed: int) -> np.ndarray:
    """Which tokens have a seeded hash below their rate."""
    h = mix(tokens ^ np.uint64(mix1(seed)))
    return h < np.minimum(rate * _TOP, _TOP * (1 - 2**-12)).astype(np.uint64)


def rare_share(n: np.ndarray, common: np.ndarray, threshold: float) -> np.ndarray:
    """For each set the part of ``threshold * n`` that its shared rare tokens make up at least, RARE_SHARE or more.

    Two similar sets share at least ``o = t / (1 + t) * (n_x + n_y)`` tokens, which is at least ``t`` times the larger set, and
    of these at most ``min(common)`` are common. Either ``min(common) > (1 - RARE_SHARE) * o``: then they meet by all
    their tokens, chosen at the rate ``picks / n`` (pairs of the common buckets, see :func:`bucket_pairs`). Or at least the
    part given here of ``t * n`` is rare, of the set with the larger ``n`` times that part, so that rare tokens chosen at ``picks / (part * n)`` are shared
    as often as without common ones.
    """
    return np.maximum(RARE_SHARE, 1 - common / (threshold * n))


def _among(tokens: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``known``, whether it is there) of each token."""
    if not len(known):
        return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return at, known[at] == tokens


def common_tokens(rows: DataFrame, shingle: int, block: int = COUNTED_TOKENS) -> np.ndarray:
    """Sorted tokens that a COMMON_SHARE of the texts (20 at least) hold, counted in all texts.

    Each worker counts its texts in blocks of about ``block`` tokens, and gives on what more than half of that share of a
    block's texts hold. So at most half of the share is missing from the sum of a token: some are common by what was given
    on, some can't be, and the rest, few however many texts there are, are counted in a second pass.
    There are at most ``1 / COMMON_SHARE`` times as many common tokens as a text has, so all workers may have them.
    """
    total = rows.count()
    least = max(20, COMMON_SHARE * total)
    texts = rows.select("text")

    def missing(n: int) -> int:
        return int(COMMON_SHARE / 2 * n)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            often = times > missing(n)
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(times[often])], ["token", "n"])

        held, size, n = [], 0, 0
        for b in batches:
            for _, part in slices(b.column(0).to_pylist()):
                held.append(token_sets(part, shingle)[0])
                size, n = size + len(held[-1]), n + len(part)
                if size >= block:
                    yield counted()
                    held, size, n = [], 0, 0
        if held:
            yield counted()

    def summed(df: DataFrame, at_least: float) -> tuple[np.ndarray, np.ndarray]:
        found = df.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least).toPandas()
        token = found["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(token)
        return token[order], found["n"].to_numpy(np.int64)[order]

    token, n = summed(texts.mapInArrow(blocks, "token long, n long"), least - missing(total))
    sure, unsure = token[n >= least], token[n < least]
    if not len(unsure):
        return sure
    shared = rows.sparkSession.sparkContext.broadcast(unsure)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        times = np.zeros(len(known), np.int64)
        for b in batches:
            for _, part in slices(b.column(0).to_pylist()):
                at, hit = _among(token_sets(part, shingle)[0], known)
                times += np.bincount(at[hit], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known[times > 0].view(np.int64)), pa.array(times[times > 0])], ["token", "n"])

    return np.sort(np.concatenate([sure, summed(texts.mapInArrow(exact, "token long, n long"), least)[0]]))


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def features(df: DataFrame, shingle: int, min_words: int, threshold: float, picks: float, runs: int, spare: int, common: np.ndarray) -> DataFrame:
    """id, h1, h2 (hash of the text) -> with n, common (tokens of both sorts), sketch, paths (chosen in all runs; odd ones of
    common tokens), spare (a further sample)."""
    shared = df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for first, part in slices(b.column(3).to_pylist()):
                tokens, offsets, words = token_sets(part, shingle)
                sizes = np.diff(offsets)
                keep = np.flatnonzero((words >= min_words) & (sizes > 0))
                if not len(keep):
                    continue
                mask = np.isin(np.repeat(np.arange(len(part)), sizes), keep)
                tokens, sizes = tokens[mask], sizes[keep]
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                owner = np.repeat(np.arange(len(keep)), sizes)
                hot = _among(tokens, known)[1]
                held = np.bincount(owner[hot], minlength=len(keep))
                rate = np.where(hot, np.where(held > (1 - RARE_SHARE) * threshold * sizes, 1.0, 0.0)[owner], (1 / rare_share(sizes, held, threshold))[owner]) / sizes[owner]
                paths, owners = [], []
                for r in range(runs):
                    hit = _chosen(tokens, picks * rate, 7919 + r)
                    paths.append(mix(tokens[hit] + np.uint64(mix1(r))) & ~np.uint64(1) | hot[hit])
                    owners.append(owner[hit])
                who = np.concatenate(owners)
                order = np.argsort(who, kind="stable")
                hit = _chosen(tokens, spare * rate, 104729)
                sketch = sketches(tokens, offsets)
                cols = [b.column(i).slice(first, len(part)).take(pa.array(keep)) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(sizes.astype(np.int32)), pa.array(held.astype(np.int32)), pa.array([x.tobytes() for x in sketch], pa.binary()), _lists(np.concatenate(paths)[order], who[order], len(keep)), _lists(tokens[hit], owner[hit], len(keep))],
                    ["id", "h1", "h2", "n", "common", "sketch", "paths", "spare"],
                )

    return df.mapInArrow(run, "id string, h1 long, h2 long, n int, common int, sketch binary, paths array<long>, spare array<long>")


def split_paths(df: DataFrame, children: float, spare: int) -> DataFrame:
    """(id, n, common, sketch, hot paths, spare) -> rows (path, parent, id, n, common, sketch) of the children of a set's large buckets.

    In each of its large buckets a set takes a share of its spare tokens, chosen anew for each path: about
    ``children`` of them, however many such buckets it is in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                paths, tokens = (part.column(i).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for i in (4, 5))
                n_paths, n_tokens = (part.column(i).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5))
                first = np.cumsum(n_tokens) - n_tokens
                row = np.repeat(np.arange(part.num_rows), n_paths)  # of each path
                size = n_tokens[row]
                at = np.repeat(np.arange(len(row)), size)  # path of each (path, token)
                place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + first[row[at]]
                child = mix(mix(paths)[at] ^ tokens[place])
                hit = child < np.uint64(min(children / spare * _TOP, _TOP * (1 - 2**-12)))
                who = pa.array(row[at][hit])
                below = mix(child) & ~np.uint64(1) | paths[at] & np.uint64(1)
                yield pa.RecordBatch.from_arrays([pa.array(x[hit].view(np.int64)) for x in (below, paths[at])] + [part.column(i).take(who) for i in range(4)], ["path", "parent", "id", "n", "common", "sketch"])

    return df.mapInArrow(run, "path long, parent long, id string, n int, common int, sketch binary")


def bucket_pairs(df: DataFrame, threshold: float) -> DataFrame:
    """(path, id, n, common, sketch) with small buckets -> distinct-in-batch candidate pairs (a < b).

    In the bucket of a common token (an odd path) only pairs count whose common tokens could be nearly all that they
    must share; all others meet by their rare tokens.
    """
    # a pair at the threshold agrees in a share (1 + t) / 2 of the bits; 4.5 deviations below
    p = (1 + threshold) / 2
    differ = int(SKETCH_BITS * (1 - p) + 4.5 * math.sqrt(SKETCH_BITS * p * (1 - p)))

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        path = t.column("path").to_numpy()
        n = t.column("n").to_numpy()
        common = t.column("common").to_numpy()
        of_common = path & 1 == 1
        raw = b"".join(t.column("sketch").to_pylist())
        sketch = np.frombuffer(raw, np.uint64).reshape(len(path), SKETCH_BITS // 64)
        ids = t.column("id").combine_chunks()
        left, right = [], []
        at = np.arange(len(path) - 1)
        d = 1
        while len(at):
            at = at[at + d < len(path)]
            at = at[path[at] == path[at + d]]
            x, y = at, at + d
            near = (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y])) & (~of_common[x] | (np.minimum(common[x], common[y]) > (1 - RARE_SHARE) * threshold / (1 + threshold) * (n[x] + n[y])))
            x, y = x[near], y[near]
            near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64) <= differ
            left.append(x[near])
            right.append(y[near])
            d += 1
        if left and sum(map(len, left)):
            codes = ids.dictionary_encode()
            num = codes.indices.to_numpy()
            x, y = num[np.concatenate(left)].astype(np.int64), num[np.concatenate(right)].astype(np.int64)
            key = np.unique(np.minimum(x, y)[x != y] * len(path) + np.maximum(x, y)[x != y])
            a, b = codes.dictionary.take(pa.array(key // len(path))), codes.dictionary.take(pa.array(key % len(path)))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # a bucket may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            path = t.column("path").to_numpy()
            end = int(np.searchsorted(path, path[-1], "left"))
            if end:
                yield from compare(t.slice(0, end))
            held = t.slice(end).to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held))

    pairs = df.repartition("path").sortWithinPartitions("path").mapInArrow(run, "a string, b string")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def in_blocks(level: DataFrame, keys: DataFrame, bucket: int) -> DataFrame:
    """(path, id, n, common, sketch) of the buckets of ``keys``, in blocks: small buckets of each two blocks of a bucket."""
    large = level.join(keys, "path").withColumn("blocks", F.ceil(F.col("count") / bucket).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.shiftleft(F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")), 1).bitwiseOR(F.col("path").bitwiseAND(1))
    return large.select(block.alias("path"), "id", "n", "common", "sketch")


def candidates(sets: DataFrame, threshold: float, bucket: int, children: float, spare: int, levels: int) -> DataFrame:
    """Candidate pairs of the sets, distinct."""
    level = sets.select(F.explode("paths").alias("path"), "id", "n", "common", "sketch")
    hot = cut(level.groupBy("path").count().filter(F.col("count") > bucket))
    found = None
    for depth in range(levels + 1):
        n_hot = hot.count()
        keys = small_side(hot, n_hot)
        rest = level if not n_hot else level.join(keys.select("path"), "path", "left_anti")
        whole = hot if depth == levels else hot.filter(F.col("count") <= WHOLE * bucket)
        split = None if depth == levels else hot.filter(F.col("count") > WHOLE * bucket)
        n_split = 0 if split is None else split.count()
        if n_split:
            paths = level.join(small_side(split.select("path"), n_split), "path", "left_semi").groupBy("id").agg(F.collect_list("path").alias("hot"))
            below = cut(split_paths(paths.join(sets, "id").select("id", "n", "common", "sketch", "hot", "spare"), children, spare))
            hot_below = cut(below.groupBy("path").agg(F.first("parent").alias("parent"), F.count(F.lit(1)).alias("count")).filter(F.col("count") > bucket))
            # a split pays where its children, compared in blocks, cost less than the bucket itself
            cost = hot_below.groupBy("parent").agg(F.sum(F.col("count").cast("double") ** 2).alias("cost")).withColumnRenamed("parent", "path")
            idle = cut(split.join(cost, "path").filter(F.col("cost") >= F.col("count").cast("double") ** 2).select("path", "count"))
            n_idle = idle.count()
            whole = whole.unionByName(idle)
            if n_idle:
                gone = small_side(idle.select(F.col("path").alias("parent")), n_idle)
                below, hot_below = below.join(gone, "parent", "left_anti"), cut(hot_below.join(gone, "parent", "left_anti"))
        if n_hot:
            rest = rest.unionByName(in_blocks(level, small_side(whole, n_hot), bucket))
        pairs = bucket_pairs(rest, threshold)
        found = pairs if found is None else found.unionByName(pairs)
        if not n_split:
            break
        level, hot = below.select("path", "id", "n", "common", "sketch"), hot_below.select("path", "count")
    return found.distinct()


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(a, b, similarity) of the candidate pairs whose exact similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n = part.num_rows
                both = pa.chunked_array([part.column(2), part.column(3)]).combine_chunks().dictionary_encode()
                tokens, offsets, _ = token_sets([t or "" for t in both.dictionary.to_pylist()], shingle)
                code = both.indices.to_numpy()
                sim = np.zeros(n)
                for k in range(n):
                    i, j = code[k], code[n + k]
                    x, y = tokens[offsets[i] : offsets[i + 1]], tokens[offsets[j] : offsets[j + 1]]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    sim[k] = shared / max(1, len(x) + len(y) - shared)
                keep = pa.array(sim >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(sim).filter(keep)], ["a", "b", "similarity"])

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a string, b string, similarity double")


def near_duplicates(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    threshold: float = 0.8,
    shingle: int = 5,
    min_words: int | None = None,
    target_recall: float = 0.999,
    picks: float = 6.0,
    bucket: int = 256,
    spare: int = 24,
    levels: int = 4,
) -> NearDuplicates:
    """All pairs of different texts whose sets of ``shingle`` consecutive words have a Jaccard
    similarity of at least ``threshold``, and the exact copies of each text.

    A null id or text, and a text of fewer than ``min_words`` words (at least ``shingle``), takes
    no part. Rows with the same id and text count once; of rows with one id and different texts the
    text with the smallest hash counts. Exact copies are represented by their smallest id, so that a
    large group of copies costs one set. An empty table gives empty results.
    """
    min_words = max(shingle, min_words or 0)
    runs = runs_needed(threshold, picks, target_recall)
    children = children_needed(threshold, picks, runs, target_recall)
    if children is None:
        runs += 1
        children = children_needed(threshold, picks, runs, target_recall)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(71), F.col("text")).alias("h2"), "text")
    feats = features(rows, shingle, min_words, threshold, picks, runs, spare, common_tokens(rows, shingle))
    one = feats.groupBy("id").agg(F.min(F.struct("h1", "h2", "n", "common", "sketch", "paths", "spare")).alias("f")).select("id", "f.*")
    one = cut(one)
    classes = one.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = one.select("id", "h1", "h2").join(classes, ["h1", "h2"])
    several = classes.filter("copies > 1").select("h1", "h2", "rep")
    sets = one.join(several, ["h1", "h2"], "left").filter("rep IS NULL OR rep = id").select("id", "h1", "h2", "n", "common", "sketch", "paths", "spare")
    cand = cut(candidates(sets, threshold, bucket, children, spare, levels))
    # of an id that comes with different texts, the text that was chosen above
    chosen = one.select("id", "h1", "h2")
    needed = cut(cand.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(chosen, "id"))
    texts = rows.join(small_side(needed, needed.count()), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id"]).select("id", "text")
    return NearDuplicates(verify(cand, texts, threshold, shingle), members.select("id", "rep"))
