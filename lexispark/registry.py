"""Queries of the core operators, each over its whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import sigmoid, terms
from .operators import calibration, metrics
from .operators.encoding import character_vocabulary, pair_ids, token_ids
from .operators.lexical import Bm25, coverage, term_stats
from .operators.passages import passages
from .operators.scoring import decide, decision_stats, keyword_score, overlap_share, prune
from .operators.search import best_sentence, group_by_file, matching_words, search
from .operators.training_pairs import build_pairs, clean_records, hard_negatives, positives, shared_between_splits, unlabelled
from .operators.vectors import at_least, missing, nearest
from .plans.evaluation import scored_cases, suite_report
from .sources.files import unique_names, why_skipped
from .sql import SQL
from .storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["QUERIES", "SQL"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; one that comes in fewer splits than there are cores is dealt out to all of them."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def asked_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_cases").groupBy("query").agg(F.min("id").alias("qid"))


def training_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, folder, f"contrastive_{s}") for s in ("train", "val", "test")])


def scored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = training_pairs(spark, folder).select("pair_id", "query", "content", "label", "type", "split", "teacher")
    return rows.withColumn("score", keyword_score(F.col("query"), F.col("content"))).withColumn("overlap", overlap_share(F.col("query"), F.col("content")))


def six(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


@query
def bm25_topk(spark, folder):
    """The ten best records for each judged query."""
    top = Bm25(table(spark, folder, "legal_records"), "row_id", "content").top(asked_queries(spark, folder), "qid", "query", 10)
    return top.select("qid", "rank", F.col("pid").alias("row_id"), *six("bm25"))


@query
def idf_table(spark, folder):
    return term_stats(table(spark, folder, "legal_records"), "content").select("term", "df", *six("idf"))


@query
def idf_coverage(spark, folder):
    """Coverage of every pair's query by its content, terms weighed by all records."""
    weights = term_stats(table(spark, folder, "legal_records"), "content")
    return coverage(training_pairs(spark, folder), "query", "content", weights).select("pair_id", *six("coverage"))


@query
def case_coverage(spark, folder):
    """Coverage of every case's query by its doc, terms weighed by all docs."""
    cases = table(spark, folder, "eval_cases")
    return coverage(cases, "query", "doc", term_stats(cases, "doc")).select("id", *six("coverage"))


@query
def keyword_rule(spark, folder):
    return scored_pairs(spark, folder).select("pair_id", "score")


@query
def overlap(spark, folder):
    return scored_pairs(spark, folder).select("pair_id", *six("overlap"))


@query
def prune_pairs(spark, folder):
    """Candidates of each query that score at least 0.5, best first."""
    kept = prune(scored_pairs(spark, folder), 0.5, "query", "score", "pair_id")
    return kept.select("pair_id", "score", "rank")


@query
def rank_pairs(spark, folder):
    ranked = prune(scored_pairs(spark, folder), 0.0, "query", "score", "pair_id")
    return ranked.select("pair_id", "rank")


@query
def cascade_direct(spark, folder):
    return decide(scored_pairs(spark, folder)).select("pair_id", "decision", "kept", "final_score")


@query
def cascade_two_tiers(spark, folder):
    decided = decide(scored_pairs(spark, folder), tier2="teacher")
    return decided.select("pair_id", "decision", "kept", *six("final_score"))


@query
def cascade_stats(spark, folder):
    return decision_stats(decide(scored_pairs(spark, folder), tier2="teacher"))


@query
def auc(spark, folder):
    return metrics.roc_auc(scored_pairs(spark, folder), ["split"]).select("split", *six("auc"))


@query
def query_auc(spark, folder):
    return metrics.query_auc(scored_pairs(spark, folder), ["split"], "query").select("split", *six("query_auc"))


@query
def binary_metrics(spark, folder):
    found = metrics.binary_metrics(scored_pairs(spark, folder), ["split"])
    return found.select("split", "n", "tp", "fp", "tn", "fn", *six("accuracy", "precision", "recall", "f1"))


@query
def calibration_error(spark, folder):
    return metrics.calibration_error(scored_pairs(spark, folder), ["split"]).select("split", *six("ece", "mce", "brier"))


@query
def log_loss(spark, folder):
    return metrics.log_loss(scored_pairs(spark, folder), ["split"]).select("split", *six("log_loss"))


@query
def category_accuracy(spark, folder):
    return metrics.category_accuracy(scored_pairs(spark, folder), ["split"], "type")


@query
def traps_fooled(spark, folder):
    cases = table(spark, folder, "eval_cases").withColumn("score", keyword_score(F.col("query"), F.col("doc")))
    return metrics.traps_fooled(cases, ["suite"], "category")


@query
def suite_metrics(spark, folder):
    """All metrics of every scorer on every suite."""
    found = suite_report(table(spark, folder, "eval_cases"))
    return found.select("suite", "scorer", "n", "tp", "fp", "tn", "fn", *six("accuracy", "auc", "query_auc"))


@query
def bootstrap_accuracy(spark, folder):
    return metrics.bootstrap_accuracy(scored_pairs(spark, folder), ["split"])


@query
def bootstrap_auc(spark, folder):
    return metrics.bootstrap_auc(scored_pairs(spark, folder), ["split"])


@query
def bootstrap_kept(spark, folder):
    """For every split, accuracy and AUC, and whether their intervals are what theory says: around the value, and as wide
    as the normal approximation (for the AUC as the bound of Hanley and McNeil, within a half)."""
    scored = written(scored_pairs(spark, folder).select("split", "label", "score"), "scored")
    right, ranked = metrics.bootstrap_accuracy(scored, ["split"]), metrics.bootstrap_auc(scored, ["split"])
    sizes = scored.groupBy("split").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    rows = right.withColumnsRenamed({"low": "a_low", "high": "a_high"}).join(ranked, "split").join(sizes, "split")
    a, u, p, q = (F.col(c) for c in ("accuracy", "auc", "p", "q"))
    wide = 2 * 1.96 * F.sqrt(a * (1 - a) / (p + q))
    more = u * (1 - u) + (p - 1) * (u / (2 - u) - u * u) + (q - 1) * (2 * u * u / (1 + u) - u * u)
    expected = 2 * 1.96 * F.sqrt(more / (p * q))
    near = (F.col("a_low") <= a) & (a <= F.col("a_high")) & (F.abs((F.col("a_high") - F.col("a_low")) / wide - 1) < 0.25)
    auc_near = (F.col("low") <= u) & (u <= F.col("high")) & (F.abs((F.col("high") - F.col("low")) / expected - 1) < 0.5)
    return rows.select("split", *six("accuracy", "auc"), near.alias("accuracy_near"), auc_near.alias("auc_near"))


def _validation_fit(spark, folder):
    return calibration.fit_platt(scored_pairs(spark, folder).where("split = 'val'"))


@query
def platt_fit(spark, folder):
    """Scaling of the keyword score, fitted on the validation split."""
    a, b = _validation_fit(spark, folder)
    return spark.createDataFrame([(round(a, 5), round(b, 5))], "a double, b double")


@query
def platt_apply(spark, folder):
    """Probability of every pair by the scaling fitted on the validation split."""
    a, b = _validation_fit(spark, folder)
    return scored_pairs(spark, folder).select("pair_id", F.round(calibration.apply_platt(F.col("score"), a, b), 5).alias("probability"))


@query
def temperature_fit(spark, folder):
    """Temperature of the keyword score's logit, fitted on the validation split, and the loss with it."""
    rows = scored_pairs(spark, folder).where("split = 'val'").withColumn("logit", F.log(F.greatest("score", F.lit(0.005)) / (1 - F.greatest("score", F.lit(0.005)))))
    t = calibration.fit_temperature(rows)
    loss = metrics.log_loss(rows.withColumn("after", sigmoid(F.col("logit") / t)), [], score="after")
    return loss.select(F.lit(round(t, 3)).alias("temperature"), F.round("log_loss", 6).alias("loss_after"))


@query
def blended_targets(spark, folder):
    rows = training_pairs(spark, folder)
    return rows.select("pair_id", F.round(calibration.blended_target(F.col("label"), F.col("teacher"), 0.3), 6).alias("target"))


@query
def training_records(spark, folder):
    """Cleaned, distinct records with their id, split and category."""
    rows = clean_records(table(spark, folder, "legal_records"), "row_id")
    return rows.select("doc_id", "jurisdiction", "split", "category", F.length("content").alias("n_chars"))


@query
def mined_pairs(spark, folder):
    """Positive, hard-negative and random-negative pairs mined from all cleaned records."""
    return build_pairs(written(clean_records(table(spark, folder, "legal_records"), "row_id"), "records"))


@query
def pairs_kept(spark, folder):
    """For every split, what any right mining keeps: a positive for each record, negatives of the same split and of another
    title, hard ones from the pool, numbers that run from 0."""
    records = written(clean_records(table(spark, folder, "legal_records"), "row_id"), "records")
    pairs = build_pairs(records)
    of = records.select("doc_id", F.col("title").alias("_title"), F.col("split").alias("_split"))
    rows = pairs.join(of, "doc_id").withColumn("_same", F.substring("_title", 1, 90) == F.col("query"))
    number = F.substring_index("pair_id", "-", -1).cast("bigint")
    return rows.groupBy("split").agg(
        F.count_if(F.col("type") == "positive").alias("positives"),
        F.count_if((F.col("type") == "positive") & ~F.col("_same")).alias("wrong_positives"),
        F.count_if(F.col("split") != F.col("_split")).alias("split_mixed"),
        (F.max(number) - F.count("*")).alias("last_number"),
    )


@query
def hard_pool(spark, folder):
    """The whole pool of hard negatives of every record's own query: the best records of its split, of another title."""
    records = written(clean_records(table(spark, folder, "legal_records"), "row_id").select("doc_id", "split", "title", "content"), "records")
    return hard_negatives(positives(records), records, pool=10, n=11).select("own", "doc_id", "split")


@query
def pair_tokens(spark, folder):
    """Token ids of every pair, as a pair model takes them: start, query, separator, content, separator."""
    known = character_vocabulary()
    ids = pair_ids(token_ids(F.col("query"), known), token_ids(F.col("content"), known), known["[CLS]"], known["[SEP]"])
    return training_pairs(spark, folder).select("pair_id", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@query
def split_leaks(spark, folder):
    return shared_between_splits(training_pairs(spark, folder)).select("query", F.array_join("splits", ",").alias("splits"))


@query
def content_leaks(spark, folder):
    """Contents that stand in more than one split of the pairs."""
    return shared_between_splits(training_pairs(spark, folder), "content").select("content", F.array_join("splits", ",").alias("splits"))


@query
def unlabelled_pairs(spark, folder):
    rows = training_pairs(spark, folder)
    return unlabelled(rows, rows.where("teacher is not null")).select("pair_id", "split")


@query
def document_passages(spark, folder):
    found = passages(table(spark, folder, "documents"), "doc_id", F.col("text"), F.col("file_name"))
    return found.select("passage_id", F.col("doc").alias("doc_id"), "passage_no", "line_start", "line_end", "shared_prev", F.length("body").alias("n_chars"))


@query
def passages_kept(spark, folder):
    """For every document with a word, what any right cutting keeps: its letters and digits, in order and each once, when
    what a passage repeats is left out."""
    found = passages(table(spark, folder, "documents"), "doc_id", F.col("text"), F.col("file_name"))
    fresh = F.regexp_replace(F.expr("substring(body, shared_prev + 1)"), r"[^\p{L}\p{N}_]+", "")
    parts = F.array_sort(F.collect_list(F.struct("passage_no", fresh.alias("fresh"))))
    return found.groupBy(F.col("doc").alias("doc_id")).agg(F.md5(F.array_join(F.transform(parts, lambda x: x["fresh"]), "")).alias("letters"))


def _found(spark, folder):
    found = written(passages(table(spark, folder, "legal_records"), "row_id", F.col("content"), F.col("source_file")), "passages")
    return search(asked_queries(spark, folder), "qid", "query", found)


@query
def search_results(spark, folder):
    """Results and near misses of every judged query over the passages of all records."""
    return _found(spark, folder)


@query
def search_files(spark, folder):
    return group_by_file(_found(spark, folder))


@query
def highlights(spark, folder):
    """The best sentence of each pair's content, by the weight of its query's terms in all records, and the words that match."""
    stats = term_stats(table(spark, folder, "legal_records"), "content")
    asked = training_pairs(spark, folder).select("pair_id", "content", F.array_distinct(terms(F.col("query"))).alias("asked"))
    weights = asked.select("pair_id", F.explode("asked").alias("term")).join(stats, "term").groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("w"))
    rows = asked.join(weights, "pair_id", "left")
    sentence = best_sentence(F.col("content"), F.col("asked"), F.coalesce("w", F.create_map().cast("map<string,double>")))
    return rows.select("pair_id", sentence.alias("sentence"), F.array_join(matching_words(F.col("content"), F.col("asked")), " ").alias("words"))


@query
def cosine_topk(spark, folder):
    """The ten nearest vectors of every vector whose id is divisible by 50, among all vectors."""
    rows = table(spark, folder, "embeddings")
    found = nearest(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10)
    return found.select("qid", "rank", "pid", F.round("cosine", 5).alias("cosine"))


@query
def cosine_at_least(spark, folder):
    """All vectors whose cosine with a vector whose id is divisible by 50 is 0.3 or more."""
    rows = table(spark, folder, "embeddings")
    found = at_least(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 0.3)
    return found.select("qid", "pid", F.round("cosine", 5).alias("cosine"))


@query
def vector_store_gaps(spark, folder):
    """Texts of the pairs that a store filled from the training split has no vector for."""
    rows = training_pairs(spark, folder)
    store = rows.where("split = 'train'").select(F.sha2("content", 256).alias("text_key")).distinct()
    return missing(rows, "content", store).select("text_key")


@query
def uploaded_names(spark, folder):
    """Base names of files made unique in order of row id: the second of a name gets (2), and so on."""
    return unique_names(table(spark, folder, "legal_records"), "source_file", "row_id").select("row_id", "unique_name")


@query
def skipped_files(spark, folder):
    """How many documents a scan would take or skip, by reason."""
    rows = table(spark, folder, "documents").withColumn("reason", why_skipped(F.col("file_name"), F.col("n_chars")))
    return rows.groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"))


@query
def cases_scored(spark, folder):
    return scored_cases(table(spark, folder, "eval_cases")).select("id", "scorer", *six("score"))


