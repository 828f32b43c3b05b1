"""Exact filtered search by cosine (or squared distance).

Filters on url and kind come first, so that they reach the scan; scores are
computed on Arrow batches with NumPy (a higher-order function over arrays falls out of
whole-stage code generation); the best k come from ``TakeOrderedAndProject``,
which keeps k rows a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators.dedup import latest
from docmill.schema import CONTENT_TYPE_NAMES, SearchOptions

#: Bytes of query vectors in one block of a batched search.
QUERY_BYTES = 32 << 20


def filtered(df: DataFrame, options: SearchOptions, url_col: str = "url", type_col: str = "content_type") -> DataFrame:
    """Rows whose url contains the source filter and whose kind is the wanted one."""
    if options.source_filter is not None:
        df = df.filter(F.col(url_col).contains(options.source_filter))
    if options.content_type is not None:
        df = df.filter(F.col(type_col) == options.content_type)
    return df


def named_content_type(name: str | None) -> str | None:
    """Kind of document for a name that a caller gives; no filter for an unknown one."""
    return CONTENT_TYPE_NAMES.get((name or "").lower())


def lists_to_matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the lists with ``dim`` values, which lists those are)."""
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == dim)
    values = lists.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(-1, dim), fits


def scores_of(matrix: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Rows x queries: cosine (0 where a norm is 0), or 1 / (1 + squared distance)."""
    if metric == "l2":
        square = (matrix**2).sum(1)[:, None] - 2 * (matrix @ queries.T) + (queries**2).sum(1)[None, :]
        return 1.0 / (1.0 + np.maximum(square, 0.0))
    norms = np.linalg.norm(matrix, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, (matrix @ queries.T) / norms, np.where(np.isnan(norms), np.nan, 0.0))


def scored(df: DataFrame, query: Sequence[float], id_col: str, vector_col: str, metric: str = "cosine") -> DataFrame:
    """(id, score) of every row with a vector. One of another length than the query scores 0; a null
    vector and a score that isn't a number take no part."""
    q = np.asarray(query, np.float64)[None, :]
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matrix, fits = lists_to_matrix(b.column(1), q.shape[1])
            score = np.zeros(b.num_rows)
            score[fits] = scores_of(matrix, q, metric)[:, 0]
            keep = b.column(1).is_valid().to_numpy(zero_copy_only=False) & ~np.isnan(score)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(score[keep])], ["id", "score"])

    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)


def exact_topk(df: DataFrame, query: Sequence[float], options: SearchOptions | None = None, id_col: str = "id", vector_col: str = "vector", url_col: str = "url", type_col: str = "content_type", metric: str = "cosine") -> DataFrame:
    """(id, score) of the best ``limit`` rows, best first, ties by id; limit 0 gives none."""
    options = options or SearchOptions()
    hits = scored(filtered(df, options, url_col, type_col), query, id_col, vector_col, metric)
    if options.min_score is not None:
        hits = hits.filter(F.col("score") >= options.min_score)
    return hits.orderBy(F.col("score").desc(), F.col(id_col)).limit(max(0, options.limit))


def batch_topk(df: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", query_id_col: str = "query_id", query_col: str = "vector", skip_self: bool = False, cells: tuple[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the best k rows of each of many queries.

    Queries are a stated set; they go over the rows in blocks of QUERY_BYTES. Each Python worker keeps k rows a
    query, so what is shuffled doesn't grow with the table's rows but with its partitions. ``cells`` is the column of
    a row's cell and a function from the matrix of queries to the (query, cell) places to look into; without it all are.
    """
    spark = df.sparkSession
    id_type, q_type = dict(df.dtypes)[id_col], dict(queries.dtypes)[query_id_col]
    base = df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), *([F.col(cells[0]).alias("cell")] if cells else []))

    def search(names: list, vectors: list[list[float]]) -> DataFrame:
        asked = np.asarray(vectors, np.float64)
        shared = spark.sparkContext.broadcast((pa.array(names), asked, cells[1](asked) if cells else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids_of, matrix, looks = shared.value
            held_score = np.full((len(matrix), k), -np.inf)
            held_row = np.full((len(matrix), k), -1, np.int64)
            held_ids: pa.Array | None = None
            for b in batches:
                rows, fits = lists_to_matrix(b.column(1), matrix.shape[1])
                if not len(rows):
                    continue
                ids = b.column(0).take(pa.array(fits))
                if looks is None:
                    score = np.nan_to_num(scores_of(rows, matrix, "cosine").T, nan=-np.inf)
                else:
                    score = np.full((len(matrix), len(rows)), -np.inf)
                    cell = b.column(2).to_numpy()[fits]
                    for c in np.unique(cell):
                        who, here = np.flatnonzero(looks[:, c]), np.flatnonzero(cell == c)
                        if len(who):
                            score[np.ix_(who, here)] = np.nan_to_num(scores_of(rows[here], matrix[who], "cosine").T, nan=-np.inf)
                if skip_self:
                    row = pc.index_in(ids_of, value_set=ids)
                    own = np.flatnonzero(row.is_valid().to_numpy(zero_copy_only=False))
                    score[own, row.drop_null().to_numpy()] = -np.inf
                offset = 0 if held_ids is None else len(held_ids)
                pool = ids if held_ids is None else pa.concat_arrays([held_ids, ids])
                both = np.concatenate([held_score, score], axis=1)
                rows_of = np.concatenate([held_row, np.broadcast_to(np.arange(len(ids)) + offset, score.shape)], axis=1)
                best = np.argsort(-both, axis=1, kind="stable")[:, :k]
                held_score, held_row = np.take_along_axis(both, best, 1), np.take_along_axis(rows_of, best, 1)
                used, packed = np.unique(held_row[held_row >= 0], return_inverse=True)
                held_row[held_row >= 0] = packed
                held_ids = pool.take(pa.array(used))
            if held_ids is not None:
                who, at = np.nonzero(held_score > -np.inf)
                yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(who)), held_ids.take(pa.array(held_row[who, at])), pa.array(held_score[who, at])], ["query_id", "id", "score"])

        return base.mapInArrow(run, f"query_id {q_type}, id {id_type}, score double")

    found, names, vectors, size = None, [], [], 0
    for r in queries.filter(F.col(query_col).isNotNull()).select(F.col(query_id_col).alias("q"), F.col(query_col).alias("v")).toLocalIterator():
        if names and size + 8 * len(r.v) > QUERY_BYTES:
            part = search(names, vectors)
            found, names, vectors, size = (part if found is None else found.unionByName(part)), [], [], 0
        names.append(r.q)
        vectors.append(list(r.v))
        size += 8 * len(r.v)
    if names:
        part = search(names, vectors)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"query_id {q_type}, id {id_type}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def with_documents(hits: DataFrame, docs: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits with their documents' columns; ids without a document drop out. Hits are k rows, so they are broadcast.

    An id has one document: of repeated ids the row that is indexed last (where the documents say when).
    """
    return latest(docs.join(F.broadcast(hits), id_col), id_col)


def result_rows(hits: DataFrame) -> DataFrame:
    """id, content, score, metadata (JSON text) as the search tool returns them."""
    return hits.select("id", "content", "score", F.to_json(F.struct("content_type", "language", "last_updated", "tags")).alias("metadata"))


def point_lookup(df: DataFrame, value: str, id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """The first row of an id (the earliest by ``order_col``)."""
    rows = df.filter(F.col(id_col) == value)
    return (rows.orderBy(order_col) if order_col else rows).limit(1)
