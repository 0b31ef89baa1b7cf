"""Search: candidates by BM25 or given ones, relevance, threshold, removal of repeated neighbours, highlights."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import STOPWORDS, WORD, fold_accents, let, light_stem, terms
from .lexical import Bm25, term_stats
from .scoring import keyword_score


def matching_words(text: Column, asked: Column) -> Column:
    """Words of the text, in lower case as written, whose stem is among the terms: sorted, each once."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))
    hit = lambda f: ~f.isin(*STOPWORDS) & F.array_contains(asked, light_stem(f))
    return F.array_sort(F.filter(words, lambda w: let(fold_accents(w), hit)))


def best_sentence(text: Column, asked: Column, weights: Column, least: float = 0.3) -> Column:
    """The sentence or line with the most weight of the asked terms; the whole text where none has enough of it.

    ``asked`` is an array of terms, ``weights`` a map from term to weight; absent terms weigh nothing.
    """

    def weight(found):
        return F.aggregate(found, F.lit(0.0), lambda acc, t: acc + F.coalesce(F.element_at(weights, t), F.lit(0.0)))

    stripped = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    whole = stripped(text)
    parts = F.filter(F.transform(F.split(text, r"(?U)(?<=[.?!])\s+|\n+"), stripped), lambda p: p != "")
    scored = F.transform(parts, lambda p, i: F.struct(weight(F.array_intersect(asked, F.array_distinct(terms(p)))).alias("w"), (-i).alias("i"), p.alias("p")))
    choice = lambda x: F.when((x["total"] <= 0) | x["top"].isNull() | (x["top"]["w"] <= 0) | (x["top"]["w"] < least * x["total"]), whole).otherwise(x["top"]["p"])
    return let(F.struct(F.array_max(scored).alias("top"), weight(asked).alias("total")), choice)


def drop_repeated(ranked: DataFrame, query: str = "qid") -> DataFrame:
    """Leave out passages that mostly repeat a neighbour ranked higher and itself shown.

    Whether a passage is shown depends only on its higher-ranked neighbours, so runs of adjacent passages of one
    document are settled from the top down.  Each round shows the passages whose repeating neighbours are all settled;
    runs of candidates are short (they are at most the pool), and the rounds end with the longest chain.
    """
    w = Window.partitionBy(query, "doc").orderBy("passage_no")
    length = F.greatest(F.length("body"), F.lit(1))
    beside = ranked.withColumn("_before", F.when(F.lag("passage_no").over(w) == F.col("passage_no") - 1, F.lag("rank").over(w)))
    beside = beside.withColumn("_after", F.when(F.lead("passage_no").over(w) == F.col("passage_no") + 1, F.lead("rank").over(w)))
    beside = beside.withColumn("_shared_after", F.lead("shared_prev").over(w))
    up = F.when((2 * F.col("shared_prev") > length) & (F.col("_before") < F.col("rank")), F.col("_before"))
    down = F.when((2 * F.col("_shared_after") > length) & (F.col("_after") < F.col("rank")), F.col("_after"))
    rows = beside.withColumn("_blocked_by", F.filter(F.array(up, down), lambda x: x.isNotNull()))
    # a passage with no possible blocker is shown; the others are settled along the chain, inside each document's list
    per_doc = rows.groupBy(query, "doc").agg(F.array_sort(F.collect_list(F.struct("rank", "_blocked_by"))).alias("_chain"))
    shown = F.aggregate(
        "_chain",
        F.array().cast("array<int>"),
        lambda acc, c: F.when(F.arrays_overlap(acc, c["_blocked_by"]), acc).otherwise(F.array_append(acc, c["rank"])),
    )
    kept = per_doc.select(query, "doc", F.explode(shown).alias("rank"))
    return ranked.join(kept, [query, "doc", "rank"], "left_semi")


#: What a request may ask for at most.
MOST_QUERY_CHARS, MOST_RESULTS = 2000, 50


@dataclass
class SearchSettings:
    pool: int = 30
    top_k: int = 5
    threshold: float = 0.5
    near_misses: int = 3

    def clamped(self) -> SearchSettings:
        """The settings with a threshold between 0 and 1, and 1 to ``MOST_RESULTS`` results."""
        return replace(self, threshold=min(1.0, max(0.0, float(self.threshold))), top_k=min(MOST_RESULTS, max(1, int(self.top_k))))


def search(queries: DataFrame, query_key: str, query_text: str, found: DataFrame, settings: SearchSettings | None = None, relevance=keyword_score, candidates: DataFrame | None = None) -> DataFrame:
    """Results of each query over passages (as ``passages`` gives them), best first; blank queries give none.

    Candidates are the best ``pool`` passages by BM25, or the rows of ``candidates`` (qid, pid, score), for scorers that
    find passages without a common term (see ``vectors.at_least``, which goes through all passages); these keep their
    score, and BM25 only orders equal ones.  ``kind`` is match (at least the threshold) or near (at least half of it, the
    best few, only where matches don't fill top_k).  ``matches_total`` counts all matches left after repeated neighbours
    are dropped.  Queries are cut to ``MOST_QUERY_CHARS``; settings out of range are brought into it.
    """
    s = (settings or SearchSettings()).clamped()
    asked = queries.select(F.col(query_key).alias("qid"), F.substring(F.trim(F.col(query_text)), 1, MOST_QUERY_CHARS).alias("query")).where("query != ''")
    index = Bm25(found, "passage_id", "text")
    if candidates is None:
        pool, known = index.top_with_weights(asked, "qid", "query", s.pool)
    else:
        scored, known = index.scores(asked, "qid", "query"), term_stats(found, "text")
        pool = candidates.select("qid", "pid", "score").join(scored, ["qid", "pid"], "left").fillna(0.0, ["bm25"]).withColumn("rank", F.lit(0))
    rows = pool.drop("rank").join(found.withColumnRenamed("passage_id", "pid"), "pid").join(asked, "qid")
    if candidates is None:
        rows = rows.withColumn("score", relevance(F.col("query"), F.col("text")))
    rows = rows.where(F.col("score") >= s.threshold * 0.5)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc(F.round("bm25", 9)), "doc", "passage_no")
    shown = drop_repeated(rows.withColumn("rank", F.row_number().over(order)))
    match = F.col("score") >= s.threshold
    side = Window.partitionBy("qid", match).orderBy("rank")
    shown = shown.withColumn("place", F.row_number().over(side)).withColumn("matches_total", F.count_if(match).over(Window.partitionBy("qid")))
    shown = shown.where((match & (F.col("place") <= s.top_k)) | (~match & (F.col("place") <= s.near_misses) & (F.col("matches_total") < s.top_k)))
    weights = asked.select("qid", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")).join(known, "term")
    weights = weights.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("weights"))
    out = shown.join(weights, "qid", "left").withColumn("_asked", F.array_distinct(terms(F.col("query"))))
    return out.select(
        "qid",
        F.when(match, F.lit("match")).otherwise(F.lit("near")).alias("kind"),
        F.col("place"),
        F.col("pid").alias("passage_id"),
        "doc",
        "file_name",
        "line_start",
        "line_end",
        F.round("score", 4).alias("score"),
        F.round("bm25", 3).alias("bm25"),
        best_sentence(F.col("body"), F.col("_asked"), F.coalesce("weights", F.create_map().cast("map<string,double>"))).alias("highlight"),
        matching_words(F.col("body"), F.col("_asked")).alias("highlight_terms"),
        "matches_total",
        (F.col("matches_total") > s.top_k).alias("more_available"),
    )


def group_by_file(results: DataFrame) -> DataFrame:
    """Matches per file in the order of each file's best one: qid, file_place, file_name, best passage, passages."""
    files = results.where("kind = 'match'").groupBy("qid", "file_name").agg(F.min("place").alias("best"), F.min_by("passage_id", "place").alias("best_passage"), F.count("*").alias("passages"))
    return files.withColumn("file_place", F.row_number().over(Window.partitionBy("qid").orderBy("best"))).drop("best")


