"""Approximate nearest neighbours by an inverted file: cells around centres, exact ranking within.

The centres are fitted on a bounded sample; every row is indexed. A query looks into the
cells nearest to it. Filters come before the cut to k, so they never starve a result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.operators.search import batch_topk, exact_topk, lists_to_matrix
from docmill.schema import AnnParams, SearchOptions


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


def _cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(1) / 2).argmax(axis=1)


def fit_centres(x: np.ndarray, cells: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _cells(x, centres)
        order = np.argsort(near, kind="stable")
        filled, first = np.unique(near[order], return_index=True)
        centres[filled] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centres


@dataclass
class AnnIndex:
    table: DataFrame  # cell, and the columns of the rows
    centres: np.ndarray
    params: AnnParams
    id_col: str = "id"
    vector_col: str = "vector"

    @property
    def dimension(self) -> int:
        return self.centres.shape[1]

    def assigned(self, df: DataFrame) -> DataFrame:
        """The rows with their cell; a vector of another dimension is an error, a null one takes no part."""
        centres, cosine, dim = self.centres, self.params.cosine, self.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, fits = lists_to_matrix(b.column(at), dim)
                if len(fits) < b.num_rows:
                    raise ValueError(f"a vector hasn't {dim} values")
                cell = pa.array(_cells(_unit(x) if cosine else x, centres).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns, cell], [*b.schema.names, "cell"])

        at = df.columns.index(self.vector_col)
        return df.filter(F.col(self.vector_col).isNotNull()).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())]))

    def add(self, df: DataFrame) -> AnnIndex:
        """An index with further rows; an id that is there already, or twice among the new, is an error."""
        both = df.select(self.id_col).unionByName(self.table.select(self.id_col)).groupBy(self.id_col).count().filter("count > 1").limit(1).collect()
        if both:
            raise ValueError(f"id {both[0][0]!r} is in the index already")
        return AnnIndex(self.table.unionByName(self.assigned(df).select(*self.table.columns)), self.centres, self.params, self.id_col, self.vector_col)

    def probe(self, query: Sequence[float], cells: int | None = None) -> list[int]:
        """The cells nearest to a query."""
        q = np.asarray(query, np.float64)[None, :]
        if q.shape[1] != self.dimension:
            raise ValueError(f"a query of {q.shape[1]} values on vectors of {self.dimension}")
        q = _unit(q) if self.params.cosine else q
        score = (q @ self.centres.T - (self.centres**2).sum(1) / 2)[0]
        return np.argsort(-score, kind="stable")[: cells or self.params.probes].tolist()

    def topk(self, query: Sequence[float], options: SearchOptions | None = None, probes: int | None = None) -> DataFrame:
        """(id, score) of the best rows in the nearest cells; the cell filter prunes partitions where the table is stored by cell."""
        near = self.table.filter(F.col("cell").isin(self.probe(query, probes)))
        return exact_topk(near, query, options, self.id_col, self.vector_col, metric="cosine" if self.params.cosine else "l2")

    def topk_batch(self, queries: DataFrame, k: int, probes: int | None = None, query_id_col: str = "query_id", query_col: str = "vector") -> DataFrame:
        """(query_id, id, score, rank) of the best k rows by cosine in the cells nearest to each of many queries."""
        if not self.params.cosine:
            raise ValueError("queries in batches go by cosine")
        centres, n = self.centres, min(probes or self.params.probes, len(self.centres))

        def looks(q: np.ndarray) -> np.ndarray:
            if q.shape[1] != centres.shape[1]:
                raise ValueError(f"queries of {q.shape[1]} values on vectors of {centres.shape[1]}")
            score = _unit(q) @ centres.T - (centres**2).sum(1) / 2
            chosen = np.zeros(score.shape, bool)
            np.put_along_axis(chosen, np.argsort(-score, axis=1, kind="stable")[:, :n], True, axis=1)
            return chosen

        return batch_topk(self.table, queries, k, self.id_col, self.vector_col, query_id_col, query_col, cells=("cell", looks))

    def stats(self) -> DataFrame:
        """One row: node_count, dimension, cells, largest_cell, mean_cell."""
        each = self.table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.lit(self.dimension).alias("dimension"), F.count(F.lit(1)).alias("cells"), F.max("n").alias("largest_cell"), F.avg("n").alias("mean_cell"))

    def neighbour_graph(self, degree: int = 16, block_rows: int = 2000, probes: int | None = None) -> DataFrame:
        """(src, dst, distance): links both ways to the nearest rows, at most ``2 * degree`` a row.

        Every row asks the ``probes`` cells nearest to it, its own among them. The rows of a cell, and those that ask
        it, are dealt into blocks of ``block_rows`` by hash; all blocks meet, so a large cell loses nothing.
        """
        cosine, dim, centres = self.params.cosine, self.dimension, self.centres
        n_cells = min(probes or self.params.probes, len(centres))
        id_type, v_type = dict(self.table.dtypes)[self.id_col], dict(self.table.dtypes)[self.vector_col]
        rows = self.table.select("cell", F.col(self.id_col).alias("id"), F.col(self.vector_col).alias("v"))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, _ = lists_to_matrix(b.column(1), dim)
                x = _unit(x) if cosine else x
                chosen = np.argsort((centres**2).sum(1) / 2 - x @ centres.T, axis=1, kind="stable")[:, :n_cells]
                at = pa.array(np.repeat(np.arange(len(x)), n_cells))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(chosen.ravel().astype(np.int32))], ["id", "v", "cell"])

        asking = rows.select("id", "v").mapInArrow(near, f"id {id_type}, v {v_type}, cell int")

        def blocks(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

        sizes = F.broadcast(blocks(rows, "held").join(blocks(asking, "asked"), "cell"))  # a row a cell

        def dealt(df: DataFrame, mine: str, other: str, asks: bool) -> DataFrame:
            every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
            own = F.pmod(F.xxhash64("id"), F.col(mine)).cast("int")
            return df.join(sizes, "cell").select("cell", own.alias(mine), every.alias(other), "id", "v", F.lit(asks).alias("asks")).select("cell", "held", "asked", "id", "v", "asks")

        placed = dealt(rows, "held", "asked", False).unionByName(dealt(asking, "asked", "held", True))

        def link(key: tuple, t: pa.Table) -> pa.Table:
            x, _ = lists_to_matrix(t.column("v").combine_chunks(), dim)
            ids = t.column("id").combine_chunks()
            asks = t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            to, who = np.flatnonzero(~asks), np.flatnonzero(asks)
            if cosine:
                u = _unit(x)
                d = 1.0 - u[who] @ u[to].T
            else:
                d = np.maximum((x[who] ** 2).sum(1)[:, None] - 2 * (x[who] @ x[to].T) + (x[to] ** 2).sum(1)[None, :], 0)
            code = ids.dictionary_encode().indices.to_numpy()
            d[code[who][:, None] == code[to][None, :]] = np.inf  # not to itself
            best = np.argsort(d, axis=1, kind="stable")[:, :degree]
            far = np.take_along_axis(d, best, 1)
            real = far < np.inf
            src = np.repeat(who, real.sum(axis=1))
            return pa.table({"src": ids.take(pa.array(src)), "dst": ids.take(pa.array(to[best[real]])), "distance": pa.array(far[real])})

        hits = placed.groupBy("cell", "held", "asked").applyInArrow(link, f"src {id_type}, dst {id_type}, distance double")
        one_way = prune_links(hits, degree)
        both = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).dropDuplicates(["src", "dst"])
        return prune_links(both, 2 * degree)


def prune_links(links: DataFrame, most: int, by: Sequence[str] = ("src",)) -> DataFrame:
    """The ``most`` shortest links of each source (and layer), ties by target."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("distance", "dst"))
    return links.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def degree_stats(links: DataFrame) -> DataFrame:
    """One row: nodes with links, total, mean and largest degree."""
    each = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("total_degree"), F.avg("n").alias("mean_degree"), F.max("n").alias("max_degree"))


def build(df: DataFrame, params: AnnParams | None = None, id_col: str = "id", vector_col: str = "vector") -> AnnIndex:
    """Index of all rows with a vector. Centres come from a sample of at most ``params.sample_rows``;
    without any row there is one centre of one dimension."""
    params = params or AnnParams()
    rows = df.filter(F.col(vector_col).isNotNull())
    n = rows.count()
    share = min(1.0, params.sample_rows / max(1, n))
    bucket = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    found = [r.v for r in rows.filter(bucket < int(share * (1 << 30)) + 1).select(F.col(vector_col).alias("v")).limit(params.sample_rows).collect()]
    x = np.asarray(found, np.float64) if found else np.ones((1, 1))
    x = _unit(x) if params.cosine else x
    centres = fit_centres(x, max(1, min(n // params.rows_per_cell, len(x) // 8)), params.seed)
    index = AnnIndex(rows.withColumn("cell", F.lit(0)), centres, params, id_col, vector_col)
    return AnnIndex(index.assigned(df), centres, params, id_col, vector_col) if found else index


def load(spark: SparkSession, path: str, params: AnnParams | None = None, id_col: str = "id", vector_col: str = "vector") -> AnnIndex:
    """An index that :func:`save` has written."""
    centres = np.asarray([r.v for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
    return AnnIndex(spark.read.parquet(f"{path}/rows"), centres, params or AnnParams(), id_col, vector_col)


def save(index: AnnIndex, path: str) -> None:
    """Rows in one folder a cell, so that a query's cells are the only ones read; centres beside them."""
    spark = index.table.sparkSession
    index.table.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centres)], "cell int, v array<double>").write.mode("overwrite").parquet(f"{path}/centres")
