"""Problem 5: the k most similar vectors of every vector, by additive quantisation.

Cells restrict where a query looks: k-means centres, and for tables with more rows than these can serve, each centre
with each word of a further codebook, so that cells are as many as the rows ask for and hold as many rows at any size.
Within a cell a vector is its
cell's centre plus a sum of codewords, one of each full-dimensional residual
codebook, in the scale of its centre's residuals (a tight group is resolved like any other), found by beam search. Scores come from lookup tables: of a query and all
codewords once, added up by code, with the stored norm of each reconstruction.
The best by these scores are ranked anew on the vectors themselves, in double
precision.

The model (centres and codebooks) is fitted on a bounded sample whose size is a
parameter; every row is indexed, and every row is a query. A cell with more rows than a
block allows is dealt into blocks by hash, each of which meets all of the cell's queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.plans.lineage import cut
from docmill.plans.sizing import small_side

#: Rows that the model is fitted on, at most.
SAMPLE_ROWS = 40_000


class Model(NamedTuple):
    centres: np.ndarray  # centres x dim, of unit vectors
    within: np.ndarray  # words x dim: of each centre's cells the places relative to it (one zero word if centres are cells)
    scale: np.ndarray  # of each centre: root mean square of the residuals that are left in its cells
    books: np.ndarray  # books x words x dim

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each row, nearest first: the best pairs of the ``n`` nearest centres and all words.

        A row belongs to the first of its cells. Cells of a centre follow each other in number.
        """
        centre = nearest(x, self.centres, min(n, len(self.centres)))
        words = len(self.within)
        if words == 1:
            return centre
        out = np.empty((len(x), n), np.int64)
        half = (self.within**2).sum(axis=1) / 2
        for lo in range(0, len(x), 1024):
            c = centre[lo : lo + 1024]
            rest = x[lo : lo + 1024, None, :] - self.centres[c]
            far = (rest**2).sum(axis=2)[:, :, None] / 2 - rest @ self.within.T + half
            flat = far.reshape(len(c), -1)
            part = np.argpartition(flat, n - 1, axis=1)[:, :n]
            order = np.take_along_axis(part, np.argsort(np.take_along_axis(flat, part, 1), axis=1, kind="stable"), 1)
            out[lo : lo + 1024] = np.take_along_axis(c, order // words, 1).astype(np.int64) * words + order % words
        return out

    def place(self, cell: np.ndarray) -> np.ndarray:
        words = len(self.within)
        return self.centres[cell // words] + self.within[cell % words]

    def scale_of(self, cell: np.ndarray) -> np.ndarray:
        return self.scale[cell // len(self.within)]


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
        if (~filled).any():  # an empty cell begins anew at some row
            centres[~filled] = x[rng.choice(len(x), int((~filled).sum()))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    half = (centres**2).sum(axis=1) / 2
    out = np.empty((len(x), n), np.int32)
    for lo in range(0, len(x), 4096):
        score = x[lo : lo + 4096] @ centres.T - half
        if n == 1:
            out[lo : lo + 4096, 0] = score.argmax(axis=1)
        else:
            part = np.argpartition(-score, n - 1, axis=1)[:, :n]
            order = np.argsort(-np.take_along_axis(score, part, 1), axis=1, kind="stable")
            out[lo : lo + 4096] = np.take_along_axis(part, order, 1)
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, reconstructions) of residuals: beam search over the codebooks for the least squared error."""
    n, (m, words, dim) = len(x), books.shape
    codes = np.empty((n, m), np.uint8)
    rebuilt = np.empty((n, dim), np.float32)
    for lo in range(0, n, 1024):
        part = x[lo : lo + 1024]
        rest, held = part[:, None, :], np.zeros((len(part), 1, 0), np.uint8)
        error = (part**2).sum(axis=1)[:, None]
        for book in books:
            width = rest.shape[1]
            score = (error[:, :, None] - 2 * (rest @ book.T) + (book**2).sum(axis=1)).reshape(len(part), -1)
            keep = min(beam, score.shape[1])
            best = np.argpartition(score, keep - 1, axis=1)[:, :keep]
            parent, word = best // words, best % words
            assert width <= beam
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
            error = np.take_along_axis(score, best, 1)
            held = np.concatenate([np.take_along_axis(held, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        first = error.argmin(axis=1)[:, None, None]
        codes[lo : lo + 1024] = np.take_along_axis(held, first, 1)[:, 0]
        rebuilt[lo : lo + 1024] = part - np.take_along_axis(rest, first, 1)[:, 0]
    return codes, rebuilt


def fit(sample: np.ndarray, centres: int, within: int, books: int, words: int, rounds: int = 8, seed: int = 5) -> Model:
    """Centres, words within them, then one codebook after the other on what the ones before leave over."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x = np.ascontiguousarray(sample, np.float32)
    middle = _kmeans(x, centres, rounds, rng)
    at = nearest(x, middle, 1)[:, 0]
    rest = x - middle[at]
    places = np.zeros((1, x.shape[1]), np.float32)
    if within > 1:
        places = _kmeans(rest, within, rounds, rng)
        rest = rest - places[nearest(rest, places, 1)[:, 0]]
    square, counts = np.bincount(at, (rest**2).sum(axis=1), len(middle)), np.bincount(at, minlength=len(middle))
    # a centre with very few rows in the sample has the scale of all
    scale = np.sqrt(np.maximum(np.where(counts >= 4, square / np.maximum(1, counts), square.sum() / len(x)), 1e-12)).astype(np.float32)
    rest = rest / scale[at, None]
    fitted = []
    for _ in range(books):
        book = _kmeans(rest, words, rounds, rng)
        if len(book) < words:  # fewer rows than words
            book = np.concatenate([book, np.zeros((words - len(book), x.shape[1]), np.float32)])
        rest = rest - book[nearest(rest, book, 1)[:, 0]]
        fitted.append(book)
    return Model(middle, places, scale, np.stack(fitted))


def cells_wanted(total: int, sample: int, cell_rows: int) -> tuple[int, int]:
    """(centres, words within a centre): together a cell for each ``cell_rows`` rows; a centre has 8 rows of the sample or more."""
    wanted = max(1, total // cell_rows)
    centres = min(wanted, max(1, sample // 8))
    return centres, min(max(1, sample // 8), -(-wanted // centres))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """Distinct ids (as text) with their vectors, of those of ``dim`` values without null, NaN or infinity and with a norm above 0."""
    v = F.col(vector_col)
    fine = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.filter(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("string").alias("id"), v.cast("array<float>").alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def with_copies(best: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Neighbours of all ids from those of the representatives of equal vectors.

    Of a group only its k + 1 smallest ids can be among anyone's k best, ties going to the smaller id. A rank
    limit that applies before the shuffle finds them, so no group is gathered.
    """
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    first = cut(copies.withColumn("r", rank).filter(F.col("r") <= k + 1).select("rep", F.col("id").alias("member")))
    near = best.join(first, best["other"] == first["rep"], "left").select(best["id"], F.coalesce("member", "other").alias("other"), "score")
    own = first.select(F.col("rep").alias("id"), F.col("member").alias("other"), F.lit(1.0).alias("score"))
    lists = cut(_best(near.unionByName(own), k + 1).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "other"))).alias("best")))
    alone = lists.join(copies.filter("id <> rep"), "id", "left_anti").join(copies.select(F.col("rep").alias("id")).distinct(), "id", "left_anti").select("id", "best")
    among = copies.join(lists.withColumnRenamed("id", "rep"), "rep").select("id", "best")
    whole = alone.unionByName(among).select("id", F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k).alias("best"))
    return whole.select("id", F.explode("best").alias("b")).select("id", F.col("b.other").alias("other"), (-F.col("b.s")).alias("score"))


def nearest_neighbours(
    df: DataFrame,
    id_col: str = "id",
    vector_col: str = "vector",
    dim: int = 64,
    k: int = 10,
    probes: int = 4,
    rerank: int = 128,
    cell_rows: int = 400,
    block_rows: int = 4000,
    books: int = 4,
    words: int = 64,
    beam: int = 4,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(id, other, score): of every usable vector the ``k`` others found most similar by cosine.

    A null id, a null vector, one of another length, with a null, NaN or infinite value, or of norm 0 takes
    no part. Of rows with one id the smallest vector counts. Ties go to the smaller id. An empty
    table gives an empty result; with fewer than ``k`` others, all of them can come out.
    """
    spark = df.sparkSession
    everyone = cut(usable(df, id_col, vector_col, dim).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(71), F.col("v"))}))
    # equal vectors are one row of the index: a large group of copies costs one
    groups = cut(everyone.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    n_groups = groups.count()
    copies = everyone.join(small_side(groups.select("h1", "h2", "rep"), n_groups), ["h1", "h2"]).select("id", "rep")
    rows = everyone.select("id", "v") if not n_groups else everyone.select("id", "v").join(copies.filter("id <> rep").select("id"), "id", "left_anti")
    rows = rows if not n_groups else cut(rows)
    total = rows.count()
    sample = rows.select("v", F.xxhash64("id").alias("h")).filter(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * min(1.0, 0.9 * sample_rows / max(1, total))) + 1).limit(sample_rows).select("v")
    found = [np.asarray(r.v, np.float64) for r in sample.toLocalIterator()] or [np.ones(dim)]
    x = np.stack(found)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres, within = cells_wanted(total, len(x), cell_rows)
    shared = spark.sparkContext.broadcast(fit(x, centres, within, books, words))
    probes = min(probes, centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1), dim)
            unit = (v / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
            cell = model.near(unit, probes)
            place, scale = model.place(cell[:, 0]), model.scale_of(cell[:, 0])[:, None]
            codes, rebuilt = encode((unit - place) / scale, model.books, beam)
            norm = np.linalg.norm(place + scale * rebuilt, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) * probes + 1, probes, dtype=np.int32)), pa.array(cell.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm.astype(np.float32))], ["id", "v", "cells", "codes", "norm"])

    index = cut(rows.mapInArrow(assign, "id string, v array<float>, cells array<long>, codes binary, norm float"))
    sizes = cut(index.groupBy(F.col("cells")[0].alias("cell")).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")).filter("blocks > 1"))
    large = small_side(sizes, sizes.count())  # at most a row for each ``block_rows`` rows
    of_cell = F.coalesce("blocks", F.lit(1))
    placed = index.select(F.col("cells")[0].alias("cell"), "id", "v", "codes", "norm").join(large, "cell", "left")
    members = placed.withColumn("block", F.pmod(F.xxhash64("id"), of_cell).cast("int")).drop("blocks")
    members = members.withColumn("asks", F.lit(True))
    asking = index.select("id", "v", F.posexplode("cells").alias("nth", "cell")).join(large, "cell", "left").withColumn("blocks", of_cell).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    home = F.pmod(F.xxhash64("id"), F.col("blocks"))
    # in its own cell and block a member asks without a second copy
    visitors = asking.filter((F.col("nth") > 0) | (F.col("block") != home)).select("cell", "id", "v", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).cast("float").alias("norm"), F.col("block").cast("int").alias("block"), F.lit(True).alias("asks"))
    both = members.unionByName(visitors).repartition("cell", "block").sortWithinPartitions("cell", "block")

    def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
        model = shared.value
        ids = t.column("id").combine_chunks()
        v = _matrix(t.column("v").combine_chunks(), dim)
        codes = t.column("codes").combine_chunks()
        own = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
        if not len(own):
            return
        cell = np.array([t.column("cell")[0].as_py()])
        centre, scale = model.place(cell)[0], float(model.scale_of(cell)[0])
        code = np.frombuffer(b"".join(codes.take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
        norm = t.column("norm").to_numpy()[own]
        unit = v.astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        base = np.zeros(len(v), np.int64) - 1
        base[own] = np.arange(len(own))
        keep = min(rerank, len(own))
        for lo in range(0, len(v), 256):
            q = unit[lo : lo + 256]
            look = scale * np.einsum("qd,mwd->mqw", q.astype(np.float32), model.books, optimize=True)
            score = np.repeat((q @ centre)[:, None].astype(np.float32), len(own), axis=1)
            for m in range(code.shape[1]):
                score += look[m][:, code[:, m]]
            score /= norm
            mine = base[lo : lo + 256]
            here = np.flatnonzero(mine >= 0)
            score[here, mine[here]] = -np.inf
            best = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep < len(own) else np.broadcast_to(np.arange(len(own)), score.shape)
            exact = np.einsum("qd,qrd->qr", q, unit[own][best])
            exact[np.take_along_axis(score, best, 1) == -np.inf] = -np.inf
            n = min(k, keep)
            top = np.argpartition(-exact, n - 1, axis=1)[:, :n]
            value = np.take_along_axis(exact, top, 1)
            other = own[np.take_along_axis(best, top, 1)]
            real = value > -np.inf
            who = np.repeat(np.arange(lo, lo + len(q)), real.sum(axis=1))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), ids.take(pa.array(other[real])), pa.array(value[real])], ["id", "other", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            cell, block = t.column("cell").to_numpy(), t.column("block").to_numpy()
            starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])))
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                yield from search(t.slice(i, j - i))
            held = t.slice(starts[-1]).to_batches()
        if held:
            yield from search(pa.Table.from_batches(held))

    hits = both.select("cell", "block", "id", "v", "codes", "norm").mapInArrow(run, "id string, other string, score double")
    best = _best(hits, k)
    return best if not n_groups else with_copies(best, copies, k)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best others of each id; a list holds k hits of each cell and block that the id has asked."""
    ranked = hits.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "other"))), 1, k).alias("best"))
    return ranked.select("id", F.explode("best").alias("b")).select("id", F.col("b.other").alias("other"), (-F.col("b.s")).alias("score"))
