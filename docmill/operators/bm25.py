"""Keyword ranking by BM25 over DataFrames: postings, document lengths, corpus figures.

A text is tokenised in one pass, in which its terms are counted as well: a document comes out as one row with its length and
its (term, tf) pairs, so no text and no token is shuffled. A query on texts filters the pairs by its few terms
in that same pass; a kept index has its postings stored by term, so that a query reads those of its terms.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import tokenize
from docmill.plans.lineage import cut
from docmill.schema import Bm25Params

#: Parts of the terms (by hash) in which the postings of a kept index are stored.
TERM_PARTS = 64


class Bm25Index:
    """``tokens``: id, tokens; a kept index has its postings, terms and figures of the corpus besides."""

    def __init__(self, tokens: DataFrame | None, kept: dict[str, DataFrame] | None = None, figures: tuple[int, float] | None = None):
        self._tokens, self.kept, self.figures = tokens, kept, figures

    @property
    def postings(self) -> DataFrame:
        """id, term, tf."""
        if self.kept:
            return self.kept["postings"].select("id", "term", "tf")
        return counted_terms(self._tokens).select("id", F.explode("terms").alias("p")).select("id", "p.term", "p.tf")

    @property
    def lengths(self) -> DataFrame:
        """id, dl."""
        return self.kept["documents"] if self.kept else self._tokens.select("id", F.size("tokens").cast("long").alias("dl"))

    @property
    def terms(self) -> DataFrame:
        """term, df."""
        return self.kept["terms"] if self.kept else self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def corpus(self) -> DataFrame:
        """One row: n documents, avgdl (documents without a token count)."""
        return self.lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))

    def counts(self, words: list[str]) -> tuple[DataFrame, list[int], int, float]:
        """((id, dl, tf of each word) of the documents with any of the words, their document frequencies, n, avgdl)."""
        tf = [f"tf_{i}" for i in range(len(words))]
        if self.kept:
            n, avgdl = self.figures
            rows = self.kept["postings"].filter(F.col("part").isin(sorted({part_of(w) for w in words})) & F.col("term").isin(words))
            found = rows.groupBy("id").agg(F.max("dl").alias("dl"), *(F.sum(F.when(F.col("term") == w, F.col("tf")).otherwise(0)).alias(c) for w, c in zip(words, tf, strict=True)))
            of = {r.term: r.df for r in self.kept["terms"].filter(F.col("term").isin(words)).collect()}
            return found, [of.get(w, 0) for w in words], n, avgdl
        # a few numbers a document, from one pass over the texts
        each = self._tokens.select("id", F.explode(F.array("tokens")).alias("t"))
        counted = cut(each.select("id", F.size("t").cast("long").alias("dl"), *(_times("t", w).alias(c) for w, c in zip(words, tf, strict=True))))
        row = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), *(F.count_if(F.col(c) > 0).alias(c) for c in tf)).first()
        return counted.filter(F.greatest(*(F.col(c) for c in tf), F.lit(0)) > 0), [row[c] for c in tf], row.n, row.avgdl


def _times(tokens: str, word: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == word))


def part_of(term: str) -> int:
    """Part of a term: by its bytes, the same on driver and workers."""
    return zlib.crc32(term.encode()) % TERM_PARTS


def build_index(df: DataFrame, id_col: str = "id", text_col: str = "content", distinct: bool = False) -> Bm25Index:
    """Index of the documents. A null text is a document without tokens; rows with a null id take no part.

    Ids are unique by contract. With ``distinct``, of repeated ids one row counts (the smallest text); only
    then are texts shuffled.
    """
    docs = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if distinct:
        docs = docs.groupBy("id").agg(F.min("text").alias("text"))
    tokens = F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>"))
    return Bm25Index(docs.select("id", tokens.alias("tokens")))


def counted_terms(docs: DataFrame) -> DataFrame:
    """(id, tokens) -> id, dl, terms: the runs of equal ones among the sorted tokens, by the places where a new one begins."""
    each = docs.select("id", F.explode(F.array(F.array_sort("tokens"))).alias("t"))  # computed once
    begins = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("t", i) != F.element_at("t", F.greatest(i - 1, F.lit(1)))))
    placed = each.select("id", "t", F.explode(F.array(F.when(F.size("t") > 0, begins).otherwise(F.array().cast("array<int>")))).alias("b"))
    runs = F.transform("b", lambda at, k: F.struct(F.element_at("t", at).alias("term"), (F.coalesce(F.get("b", k + 1), F.size("t") + 1) - at).cast("long").alias("tf")))
    return placed.select("id", F.size("t").cast("long").alias("dl"), runs.alias("terms"))


def keep(df: DataFrame, path: str, id_col: str = "id", text_col: str = "content", distinct: bool = False) -> Bm25Index:
    """Build an index and store it: documents (id, dl), postings by part and term, terms, figures of the corpus."""
    counted = cut(counted_terms(build_index(df, id_col, text_col, distinct)._tokens))
    part = F.pmod(F.crc32(F.col("p.term").cast("binary")), F.lit(TERM_PARTS)).cast("int")
    rows = counted.select("id", "dl", F.explode("terms").alias("p")).select("id", "dl", "p.term", "p.tf", part.alias("part"))
    rows.repartitionByRange("part", "term", "id").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    spark = df.sparkSession
    _postings(spark, path, counted.schema["id"]).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    documents = counted.select("id", "dl")
    documents.write.mode("overwrite").parquet(f"{path}/documents")
    documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/corpus")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Bm25Index:
    """An index that :func:`keep` has stored."""
    row = spark.read.parquet(f"{path}/corpus").first()
    terms, documents = (spark.read.parquet(f"{path}/{name}") for name in ("terms", "documents"))
    return Bm25Index(None, {"postings": _postings(spark, path, documents.schema["id"]), "terms": terms, "documents": documents}, (row.n, row.avgdl))


def _postings(spark: SparkSession, path: str, id_field: T.StructField) -> DataFrame:
    rest = [T.StructField("dl", T.LongType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("part", T.IntegerType())]
    return spark.read.schema(T.StructType([id_field, *rest])).parquet(f"{path}/postings")


def idf(n: Column, df: Column, plus_one: bool = False) -> Column:
    ratio = (n - df + 0.5) / (df + 0.5)
    return F.log(ratio + 1.0) if plus_one else F.log(ratio)


def tf_norm(tf: Column, dl: Column, avgdl: Column, params: Bm25Params) -> Column:
    return tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * dl / avgdl))


def query_terms(spark: SparkSession, query: str) -> dict[str, int]:
    """The query's terms and how often each comes."""
    out: dict[str, int] = {}
    for t in spark.range(1).select(tokenize(F.lit(query)).alias("t")).first().t or []:
        out[t] = out.get(t, 0) + 1
    return out


def keyword_scores(index: Bm25Index, query: str, params: Bm25Params | None = None) -> DataFrame:
    """(id, score) of the documents with a score above 0. A token that comes twice in the query counts twice.

    Without a kept index, one pass over the texts counts the query's terms; only their counts and the lengths go on, and
    nothing is shuffled. A kept index has the figures of the corpus, and its postings are read by term.
    """
    params = params or Bm25Params()
    times = query_terms(index.lengths.sparkSession, query)
    words = sorted(times)
    if not words:
        return index.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    rows, df, n, avgdl = index.counts(words)
    parts = [times[w] * idf(F.lit(float(n)), F.lit(float(f)), params.idf_plus_one) * tf_norm(F.col(f"tf_{i}").cast("double"), F.col("dl"), F.lit(avgdl), params) for i, (w, f) in enumerate(zip(words, df, strict=True)) if f]
    if not parts:
        return index.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    return rows.select("id", reduce(lambda a, b: a + b, parts).alias("score")).filter("score > 0")


def keyword_topk(index: Bm25Index, query: str, k: int, params: Bm25Params | None = None) -> DataFrame:
    """The best k of :func:`keyword_scores`, best first, ties by id."""
    return keyword_scores(index, query, params).orderBy(F.col("score").desc(), F.col("id")).limit(max(0, k))


def index_stats(index: Bm25Index) -> DataFrame:
    """One row: doc_count, term_count, avg_doc_length."""
    if index.kept:
        terms = index.terms.agg(F.count(F.lit(1)).alias("term_count"))
        return index.corpus().join(F.broadcast(terms)).select(F.col("n").alias("doc_count"), "term_count", F.col("avgdl").alias("avg_doc_length"))
    # documents and lengths go along with each document's first term, so that one pass gives all three
    each = counted_terms(index._tokens).select("dl", F.posexplode_outer("terms").alias("nth", "p"))
    first = F.coalesce(F.col("nth") == 0, F.lit(True))
    by_term = each.groupBy(F.col("p.term").alias("term")).agg(F.count_if(first).alias("n"), F.coalesce(F.sum(F.when(first, F.col("dl"))), F.lit(0)).alias("dl"))
    whole = by_term.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("doc_count"), F.count("term").alias("term_count"), F.sum("dl").alias("dl"))
    return whole.select("doc_count", "term_count", F.when(F.col("doc_count") > 0, F.col("dl") / F.col("doc_count")).otherwise(0.0).alias("avg_doc_length"))
