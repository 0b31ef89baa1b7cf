"""BM25 and term statistics as DataFrames: postings, document frequencies, scores, coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import terms
from ..storage import small, written
from .retrieval import B, K1, best_records, idf, postings_of


def posting_list(passages: DataFrame, key: str, text: str) -> DataFrame:
    """key, length and one row per term with its frequency; term is null for a passage without terms."""
    rows = passages.select(F.col(key).alias("pid"), terms(F.col(text)).alias("terms"))
    rows = rows.select("pid", F.size("terms").alias("length"), F.explode_outer("terms").alias("term"))
    return rows.groupBy("pid", "length", "term").agg(F.count("term").alias("tf"))


def corpus_size(passages: DataFrame, text: str) -> DataFrame:
    """One row: n passages and their mean length in terms; passages without terms count."""
    return passages.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(terms(F.col(text)))), F.lit(0.0)).alias("mean_length"))


def term_stats(passages: DataFrame, text: str) -> DataFrame:
    """term, df and idf of every term of the corpus.

    Terms are made distinct within each passage by the array function, so one partial aggregation per term is all that
    is shuffled.
    """
    size = passages.agg(F.count("*").alias("n"))
    found = passages.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    counted = found.groupBy("term").agg(F.count("*").alias("df"))
    return counted.crossJoin(F.broadcast(size)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


@dataclass
class Bm25:
    """An index over passages (unique key, text): postings restricted to the terms that are asked for."""

    passages: DataFrame
    key: str
    text: str
    k1: float = K1
    b: float = B

    def _asked(self, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
        return queries.select(F.col(query_key).alias("qid"), F.array_sort(F.array_distinct(terms(F.col(query_text)))).alias("terms")).where(F.size("terms") > 0)

    def _docs(self) -> DataFrame:
        return self.passages.select(F.col(self.key).alias("pid"), terms(F.col(self.text)).alias("terms"))

    def scores(self, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
        """qid, pid, bm25 for every passage that shares a term with the query; repeated query terms count once.

        One row for each such pair: for the best of each query ``top`` needs far fewer.
        """
        asked = self._asked(queries, query_key, query_text).select("qid", F.explode("terms").alias("term"))
        postings, size = postings_of(self._docs(), asked.select("term"))
        frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
        weights = frequency.crossJoin(F.broadcast(size)).select("term", "mean_length", idf(F.col("n"), F.col("df")).alias("idf"))
        tf = F.col("tf")
        norm = self.k1 * (1.0 - self.b + self.b * F.col("length") / F.greatest(F.col("mean_length"), F.lit(1e-9)))
        part = F.col("idf") * tf * (self.k1 + 1.0) / (tf + norm)
        return small(asked).join(postings.join(weights, "term"), "term").groupBy("qid", "pid").agg(F.sum(part).alias("bm25"))

    def top(self, queries: DataFrame, query_key: str, query_text: str, k: int) -> DataFrame:
        """The best k passages of each query: qid, rank, pid, bm25; equal scores by passage key.

        Scores are rounded to nine places, so that the order of additions can't change the order of passages.  Queries
        with the same terms are scored once.
        """
        return self.top_with_weights(queries, query_key, query_text, k)[0]

    def top_with_weights(self, queries: DataFrame, query_key: str, query_text: str, k: int) -> tuple[DataFrame, DataFrame]:
        """``top``, and term and idf of the queries' terms that some passage has."""
        asked = self._asked(queries, query_key, query_text).withColumn("key", F.xxhash64("terms"))
        sets = asked.groupBy("key").agg(F.lit("").alias("split"), F.first("terms").alias("terms"))
        docs = self._docs().withColumn("split", F.lit(""))
        best, weights = best_records(written(sets, "sets"), docs, k, k1=self.k1, b=self.b)
        order = Window.partitionBy("qid").orderBy("less", "pid")
        found = best.sets.join(best.lists, "known").select("key", F.explode("best").alias("x")).select("key", "x.less", "x.pid")
        ranked = asked.select("qid", "key").join(found, "key").withColumn("rank", F.row_number().over(order))
        return ranked.select("qid", "rank", "pid", (-F.col("less")).alias("bm25")), weights.select("term", "idf")


def coverage(pairs: DataFrame, query: str, document: str, weights: DataFrame | None = None) -> DataFrame:
    """``pairs`` with ``coverage``: the weighted share of the query's terms that the document has.

    ``weights`` (term, idf) defaults to 1 for every term; a query term outside the table weighs as the heaviest inside.
    """
    empty = F.lit("")
    rows = pairs.withColumn("_pair", F.md5(F.concat(F.coalesce(F.col(query), empty), F.lit("\0"), F.coalesce(F.col(document), empty))))
    asked, held = F.array_distinct(terms(F.col(query))), F.array_distinct(terms(F.col(document)))
    if weights is None:
        share = F.size(F.array_intersect(asked, held)) / F.size(asked)
        return pairs.withColumn("coverage", F.when(F.size(asked) == 0, 0.0).otherwise(share))
    once = rows.groupBy("_pair").agg(F.first(query).alias(query), F.first(document).alias(document))  # equal pairs are worked out once
    spread = once.select("_pair", F.explode(asked).alias("term"), held.alias("held")).select("_pair", "term", F.array_contains("held", F.col("term")).alias("hit"))
    heaviest = weights.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("heaviest"))
    weighed = spread.join(weights.select("term", "idf"), "term", "left").crossJoin(F.broadcast(heaviest)).withColumn("w", F.coalesce("idf", "heaviest"))
    shares = weighed.groupBy("_pair").agg((F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("coverage"))
    return rows.join(shares, "_pair", "left").drop("_pair").withColumn("coverage", F.least(F.lit(1.0), F.coalesce("coverage", F.lit(0.0))))
