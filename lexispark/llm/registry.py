"""Queries of the training-data operators: p1_ to p8_, each over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .groups import contract, grouped_splits, tie_key, tied_groups
from .leaks import leaks
from .lookalikes import canonical_texts, same_looking
from .mixing import mix
from .near_duplicates import all_pairs, near_duplicates, record_text
from .overlaps import overlaps, row_pairs
from .packing import fill_report, pack
from .pieces import pieces
from .sql import SQL
from .tokens import limited, token_counts

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Vocabulary that lengths are counted in: a public file, outside this repository.
VOCABULARY = os.environ.get("LEXISPARK_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _records_near(spark: SparkSession, folder: str):
    records = table(spark, folder, "legal_records")
    return near_duplicates(records, "row_id", record_text(F.col("title"), F.col("content")), threshold=0.6, size=3, least_words=25)


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return all_pairs(_records_near(spark, folder))


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that had to be cut, and among them those with a forced cut, read off the pieces."""
    first = pieces(table(spark, folder, "legal_records"), "row_id", F.col("content"), with_text=False).where("piece_no = 0 and n_pieces > 1")
    kinds = F.when(F.col("n_forced") > 0, F.array(F.lit("oversized"), F.lit("unbroken"))).otherwise(F.array(F.lit("oversized")))
    return first.select(F.col("id").alias("row_id"), F.explode(kinds).alias("kind"))


@query
def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all records, in order, with their texts."""
    return pieces(table(spark, folder, "legal_records"), "row_id", F.col("content")).withColumnRenamed("id", "row_id")


@query
def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For every record, what any right cutting keeps: the new parts of the pieces, in order, are the text again; no piece
    or overlap is too long; and whether a cut had to be forced."""
    records = table(spark, folder, "legal_records").select("row_id", "content").where("content is not null")
    found = pieces(records, "row_id", F.col("content"))
    fresh = F.struct("piece_no", F.expr("substring(text, overlap + 1)").alias("fresh"))
    within = (F.length("text") <= 500) & (F.col("overlap") <= 100) & (F.length("text") == F.col("end") - F.col("start"))
    again = found.groupBy("id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(fresh)), lambda x: x["fresh"]), "")).alias("again"), F.min(within).alias("within"), F.max(F.col("n_forced") > 0).alias("forced"))
    rows = records.select("row_id", F.length("content").alias("n_chars"), F.md5("content").alias("stored")).join(again.withColumnRenamed("id", "row_id"), "row_id")
    return rows.select("row_id", "n_chars", (F.col("again") == F.col("stored")).alias("whole"), "within", "forced")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    records, cases = table(spark, folder, "legal_records"), table(spark, folder, "eval_cases")
    return leaks(records, "row_id", F.col("content"), cases, F.col("id"), F.col("doc"), F.col("query"))


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The leaks whose words stand in the record without an edit."""
    return _leaks(spark, folder).where("exact").select(F.col("id").alias("row_id"), "case_id")


@query
def p2_cases(spark: SparkSession, folder: str) -> DataFrame:
    """For each leaked case: how many records hold it exactly, and how many more with an edit."""
    found = _leaks(spark, folder).groupBy("case_id").agg(F.count_if("exact").alias("records"), F.count_if(~F.col("exact")).alias("near_records"))
    cases = table(spark, folder, "eval_cases").select(F.col("id").alias("case_id"), "suite", "category")
    return cases.join(found, "case_id")


def _keys():
    return [F.col("jurisdiction"), F.col("doc_id")]


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the groups that join at least two jurisdictions."""
    found = tied_groups(table(spark, folder, "legal_records"), "row_id", _keys()).records
    return found.where("values > 1").select(F.col("id").alias("row_id"), F.col("group").alias("group_row"))


@query
def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every record."""
    targets = [tuple(r) for r in table(spark, folder, "split_targets").select("split_name", "share").orderBy(F.desc("share"), "split_name").collect()]
    return grouped_splits(table(spark, folder, "legal_records"), "row_id", _keys(), targets).withColumnRenamed("id", "row_id")


@query
def p5_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For every split, what any right split keeps: its share within a thousandth, and no court or document in two."""
    rows = table(spark, folder, "legal_records").select("row_id", *[tie_key(k).alias(n) for k, n in zip(_keys(), ("court", "document"), strict=True)])
    placed = written(rows.join(p5_splits(spark, folder), "row_id").select("row_id", "court", "document", "split"), "placed")
    counts = placed.groupBy("split").agg(F.count("*").alias("n"))
    out = table(spark, folder, "split_targets").select(F.col("split_name").alias("split"), "share").join(counts, "split", "left").crossJoin(F.broadcast(placed.agg(F.count("*").alias("all_records"))))
    for name in ("court", "document"):
        torn = placed.where(F.col(name).isNotNull()).groupBy(name).agg((F.min("split") != F.max("split")).alias("torn"))
        out = out.crossJoin(F.broadcast(torn.agg(F.count_if("torn").alias(f"torn_{name}s"))))
    near = F.abs(F.coalesce("n", F.lit(0)) / F.col("all_records") - F.col("share")) < 0.001
    return out.select("split", "share", near.alias("near"), "torn_courts", "torn_documents", "all_records")


@query
def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every compared record with its exact-copy class, its group of near-duplicates and its class's number of links."""
    found = _records_near(spark, folder)
    pairs = written(found.pairs, "pairs")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    roots = contract(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("vertex").alias("rep"), "root")
    smallest = roots.groupBy("root").agg(F.min("rep").alias("group_row"))
    grouped = roots.join(smallest, "root").select("rep", "group_row")
    rows = found.members.join(grouped, "rep", "left").join(links, "rep", "left")
    return rows.select(F.col("id").alias("row_id"), F.col("rep").alias("class_row"), F.coalesce("group_row", "rep").alias("group_row"), F.coalesce("links", F.lit(0)).alias("links"))


def _split_overlaps(spark: SparkSession, folder: str):
    splits = [table(spark, folder, f"contrastive_{s}").select("pair_id", "doc_id", "query", "content", F.lit(s).alias("part")) for s in ("train", "val", "test")]
    rows = reduce(DataFrame.unionByName, splits)
    rows = rows.select("pair_id", "doc_id", "part", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("content", "query")])).alias("x"))
    return overlaps(rows, "pair_id", F.col("x.field"), F.col("x.text"), F.col("part") == "train", keep=("doc_id", "part"), whole=("query",), threshold=0.6, size=3)


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a held-out and a training row with similar contents or equal queries."""
    pairs = row_pairs(_split_overlaps(spark, folder))
    return pairs.select(F.least("eval_id", "train_id").alias("pair_id_a"), F.greatest("eval_id", "train_id").alias("pair_id_b"), "field")


@query
def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out rows, those that overlap with the training split, and their words that stand in it, per split, field and
    jurisdiction of their record."""
    found = _split_overlaps(spark, folder)
    key = tie_key(F.col("doc_id"))
    named = table(spark, folder, "legal_records").select(key.alias("doc"), "row_id", tie_key(F.col("jurisdiction")).alias("jurisdiction")).where("doc is not null and jurisdiction is not null")
    named = named.groupBy("doc").agg(F.min_by("jurisdiction", "row_id").alias("jurisdiction"))
    hit = found.pairs.groupBy(F.col("eval_class").alias("class")).agg(F.max("similarity").alias("similarity"))
    rows = found.members.where(~F.col("is_train")).join(hit, "class", "left").join(found.coverage, "class", "left").withColumn("doc", key).join(named, "doc", "left")
    covered = F.when(F.col("field") == "query", F.when(F.col("similarity").isNotNull(), F.col("words")).otherwise(0)).otherwise(F.coalesce("covered", F.lit(0)))
    by = rows.groupBy(F.col("part").alias("split"), "field", F.coalesce("jurisdiction", F.lit("unknown")).alias("jurisdiction"))
    return by.agg(F.count("*").alias("rows"), F.count("similarity").alias("overlapping"), F.count_if(F.col("similarity") >= 1.0).alias("equal"), F.sum("words").alias("words"), F.sum(covered).alias("covered_words"))


@query
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that look the same and are stored differently."""
    found = same_looking(table(spark, folder, "documents"), "doc_id", F.col("text"))
    return found.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


@query
def p8_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every document."""
    forms = canonical_texts(table(spark, folder, "documents"), "doc_id", F.col("text"))
    return forms.select(F.col("id").alias("doc_id"), F.col("canonical").alias("text"), (F.col("text") != F.col("canonical")).alias("changed"))


@query
def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """For every document that is neither null nor empty, the first document whose consistent form is the same."""
    forms = canonical_texts(table(spark, folder, "documents"), "doc_id", F.col("text")).where("text != ''")
    keyed = written(forms.select(F.col("id").alias("doc_id"), F.md5("canonical").alias("form")), "forms")
    return keyed.join(keyed.groupBy("form").agg(F.min("doc_id").alias("class_doc")), "form").select("doc_id", "class_doc")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts(table(spark, folder, "documents"), {"id": F.col("doc_id")}, F.col("text"), VOCABULARY)
    profiles = limited(table(spark, folder, "pack_limits").select("profile", "capacity_tokens").orderBy("capacity_tokens", "profile"), 100, "profiles")
    return pack(counted, [tuple(p) for p in profiles])


@query
def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of each of its pieces, for each profile."""
    return _packed(spark, folder).withColumnRenamed("id", "doc_id")


@query
def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers of each profile are filled."""
    return fill_report(_packed(spark, folder))


@query
def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For every profile, what any right packing keeps: every document is there once and whole, only those over the
    capacity are cut, no container holds more than its size or is larger than the capacity; and few tokens are left."""
    packed = written(_packed(spark, folder), "packed")
    by_item = packed.groupBy("profile", "capacity", "id").agg(F.sum("length").alias("length"), F.max("tokens").alias("tokens"), F.count("*").alias("pieces"), F.count_distinct("piece_no").alias("numbers"))
    cut = (F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))
    items = by_item.groupBy("profile", "capacity").agg(F.count("*").alias("documents"), F.count_if(F.col("length") != F.col("tokens")).alias("not_whole"), F.count_if(cut | (F.col("pieces") != F.col("numbers"))).alias("cut_in_vain"))
    bins = packed.groupBy("profile", "container").agg(F.sum("length").alias("used"), F.first("container_size").alias("size"), F.first("capacity").alias("most"))
    bins = bins.groupBy("profile").agg(F.count_if((F.col("used") > F.col("size")) | (F.col("size") > F.col("most"))).alias("too_full"), (F.sum("used") / F.sum("size") > 0.95).alias("well_filled"))
    return items.join(bins, "profile")


def _mixture(spark: SparkSession, folder: str):
    columns = {"id": F.col("doc_id"), "source": F.col("source"), "lang": F.col("lang")}
    counted = token_counts(table(spark, folder, "documents"), columns, F.col("text"), VOCABULARY)
    return mix(counted, table(spark, folder, "mix_targets"))


@query
def p7_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture, and how often each is used."""
    return _mixture(spark, folder).documents.withColumnRenamed("id", "doc_id")


@query
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source."""
    return _mixture(spark, folder).shares


@query
def p7_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Budget and tokens of every domain, language and source."""
    return _mixture(spark, folder).leaves


@query
def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For every target, what any right mixture keeps: repeats within the limit, tokens within the longest documents of
    what the leaves were given, and no source over its share unless another can't reach its own."""
    found = _mixture(spark, folder)
    longest = found.documents.groupBy("source").agg(F.max("tokens").alias("longest"))
    rows = found.shares.join(longest, "source", "left")
    near = F.abs(F.col("tokens") - F.col("budget")) <= F.coalesce("longest", F.lit(0)) * F.col("languages")
    return rows.select("source", "target_share", "max_repeats", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), near.alias("near_budget"))
