"""Relevance of (query, text) pairs by rule, pruning and ranking, and the two-tier decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import NEGATIONS, OVERLAP_STOPWORDS, WORD, let, long_words, normalize, rule_stem


def keyword_score(query: Column, text: Column) -> Column:
    """Score bucket by the share of query words whose stem occurs in the text, with phrase and negation adjustments.

    A null is an empty text.  A query without words scores 0, a text that shares no stem 0.005.
    """
    asked, given = normalize(F.coalesce(query, F.lit(""))), normalize(F.coalesce(text, F.lit("")))

    def scored(t):
        q, c = t["q"], t["c"]
        return let(F.struct(q.alias("q"), c.alias("c"), long_words(q).alias("qw"), long_words(c).alias("cw")), by_words)

    def by_words(t):
        stems = F.struct(*[t[x].alias(x) for x in ("q", "c", "qw", "cw")], F.transform(t["qw"], rule_stem).alias("qs"), F.array_distinct(F.transform(t["cw"], rule_stem)).alias("cs"))
        return let(stems, by_stems)

    def by_stems(t):
        hits = F.size(F.filter(t["qs"], lambda q: F.exists(t["cs"], lambda c: F.contains(c, q))))
        return let(F.struct(t.alias("t"), hits.alias("hits")), by_hits)

    def by_hits(x):
        t, hits = x["t"], x["hits"]
        ratio = hits / F.size(t["qw"])
        base = F.when(ratio >= 0.99, 0.95).when(ratio >= 0.66, 0.78).when(ratio >= 0.49, 0.52).otherwise(0.20)
        base = F.when(F.contains(t["c"], t["q"]), F.least(F.lit(0.99), base + 0.10)).otherwise(base)
        denies = [F.exists(t[w], lambda w: w.isin(*NEGATIONS)) for w in ("qw", "cw")]
        touchy = F.contains(t["q"], F.lit("allerg")) | F.contains(t["q"], F.lit("contr"))
        base = F.when((denies[0] != denies[1]) & touchy, F.round(base * 0.85, 4)).otherwise(base)
        score = F.round(F.least(F.lit(0.995), F.greatest(F.lit(0.005), base)), 4)
        return F.when(F.size(t["qw"]) == 0, 0.0).when(hits == 0, 0.005).otherwise(score)

    return let(F.struct(asked.alias("q"), given.alias("c")), scored)


def overlap_share(query: Column, text: Column) -> Column:
    """Share of the query's five-letter word beginnings that the text has; 0 for a query without words."""

    def stems(x):
        words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(WORD), F.lit(0)))
        return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(*OVERLAP_STOPWORDS)), lambda w: F.substring(w, 1, 5)))

    return let(stems(query), lambda asked: F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, stems(text))) / F.size(asked)))


def prune(pairs: DataFrame, threshold: float, by: str = "query", score: str = "score", position: str = "position") -> DataFrame:
    """Pairs with at least the threshold, with their rank within the query; equal scores keep their position's order."""
    order = Window.partitionBy(by).orderBy(F.desc(score), position)
    return pairs.where(F.col(score) >= threshold).withColumn("rank", F.row_number().over(order))


def decide(pairs: DataFrame, tier1: str = "score", overlap: str = "overlap", tier2: str | None = None, drop_below: float = 0.75, keep_from: float = 0.95) -> DataFrame:
    """Two-tier decision for each pair: decision, kept, final_score and whether the second tier was asked.

    ``tier2`` names the second tier's probability; a null is a failed call, None no second tier at all.  The second
    tier should be computed on ``ambiguous(pairs)`` only, since an expensive function is not skipped inside ``when``.
    """
    s, lex = F.col(tier1), F.col(overlap)
    sure_no, sure_yes = (lex == 0.0) & (s < drop_below), s >= keep_from
    asked = ~sure_no & ~sure_yes
    if tier2 is None:
        tag = F.when(s >= 0.5, F.lit("direct_kept")).otherwise(F.lit("direct_dropped"))
        final = s
    else:
        p = F.col(tier2)
        rescued = (p >= 0.25) & (p < 0.5) & (lex >= 0.20) & (s >= 0.70)
        tag = F.when(p.isNull() & (s >= 0.5), F.lit("fallback_kept")).when(p.isNull(), F.lit("fallback_dropped"))
        tag = tag.when(p >= 0.5, F.lit("tier2_kept")).when(rescued, F.lit("tier2_rescued")).otherwise(F.lit("tier2_dropped"))
        final = F.when(p.isNull(), s).when(rescued, F.round(0.5 * p + 0.5 * s, 4)).otherwise(p)
    tag = F.when(sure_no, F.lit("tier1_dropped")).when(sure_yes, F.lit("tier1_kept")).otherwise(tag)
    out = pairs.withColumn("decision", tag).withColumn("final_score", F.when(asked, final).otherwise(s))
    return out.withColumn("kept", F.col("decision").endswith("_kept") | F.col("decision").endswith("_rescued")).withColumn("asked", asked)


def ambiguous(pairs: DataFrame, tier1: str = "score", overlap: str = "overlap", drop_below: float = 0.75, keep_from: float = 0.95) -> DataFrame:
    """The pairs that the first tier can't decide: the only ones to send to an expensive second tier."""
    return pairs.where(~((F.col(overlap) == 0.0) & (F.col(tier1) < drop_below)) & (F.col(tier1) < keep_from))


def decision_stats(decided: DataFrame, by: str = "query") -> DataFrame:
    """Per query: counts of each outcome and the share of candidates that the second tier was spared, in percent."""
    tag = F.col("decision")
    return decided.groupBy(by).agg(
        F.count("*").alias("candidates"),
        F.count_if(tag == "tier1_dropped").alias("tier1_dropped"),
        F.count_if(tag == "tier1_kept").alias("tier1_kept"),
        F.count_if("asked").alias("arbitrated"),
        F.count_if("kept").alias("kept"),
        F.round((1.0 - F.count_if("asked") / F.count("*")) * 100, 1).alias("spared_pct"),
    )
