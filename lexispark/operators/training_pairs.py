"""Training pairs: cleaned records with split and category, positives, hard and random negatives, leak check, resuming."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_text, record_id, split_of, terms, weak_category
from ..storage import written
from .retrieval import best_records


def clean_records(rows: DataFrame, order: str, jurisdiction: str = "jurisdiction", title: str = "title", content: str = "content", most: int = 500) -> DataFrame:
    """Cleaned records with title and content long enough, the first of equal ones, and their id, split and category."""
    row = F.struct(F.col(order).alias("_o"), *[clean_text(F.coalesce(F.col(c), F.lit(""))).alias(n) for n, c in (("jurisdiction", jurisdiction), ("title", title), ("content", content))])
    long = F.filter(F.array(row), lambda x: (F.length(x["title"]) > 5) & (F.length(x["content"]) > 50))  # a condition on columns would clean texts twice
    kept = rows.select(F.inline(long)).withColumn("content", F.substring("content", 1, most))
    first = kept.groupBy("title", "content").agg(F.min_by("jurisdiction", "_o").alias("jurisdiction"))
    return first.select(
        record_id(F.col("title"), F.col("content")).alias("doc_id"),
        "jurisdiction",
        "title",
        "content",
        split_of(F.col("title")).alias("split"),
        weak_category(F.col("jurisdiction"), F.col("title"), F.col("content")).alias("category"),
    )


def _seeded(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))


def _row(frame: DataFrame, label: float, kind: str) -> DataFrame:
    return frame.select("query", F.lit(label).alias("label"), F.lit(kind).alias("type"), "doc_id", "split", "own")


def positives(records: DataFrame, extra_queries: DataFrame | None = None) -> DataFrame:
    """query, split, title, own id and jurisdiction: each record's title (90 characters) and its extra queries."""
    own = records.select(F.substring("title", 1, 90).alias("query"), *records.columns)
    if extra_queries is None:
        return own
    more = records.join(extra_queries.select("doc_id", "query"), "doc_id").select("query", *records.columns)
    return own.unionByName(more)


def hard_negatives(asked: DataFrame, records: DataFrame, pool: int = 10, n: int = 1, seed: int = 42, common: int = 200, champions: int = 50) -> DataFrame:
    """For each query, ``n`` of the best ``pool`` records of its split by BM25 that aren't of its own title.

    Scores are whole sums over all terms of the query, frequent ones too (see ``best_records``); queries with the same
    terms are scored once.
    """
    docs = records.select(F.col("doc_id").alias("pid"), "split", F.xxhash64("title").alias("mark"), terms(F.col("content")).alias("terms"))
    queries = asked.select("query", "split", F.col("doc_id").alias("own"), F.xxhash64("title").alias("mark"), F.array_sort(F.array_distinct(terms(F.col("query")))).alias("terms"))
    queries = written(queries.withColumn("key", F.xxhash64("split", "terms")), "queries")
    sets = queries.groupBy("key").agg(F.first("split").alias("split"), F.first("terms").alias("terms"))
    top, _ = best_records(written(sets, "sets"), docs, pool + 1, common, champions)
    named = queries.select("key", "query", "split", "mark", "own").join(top.sets, "key").join(top.lists, "known")
    others = F.filter("best", lambda x: (x["pid"] != F.col("own")) & (x["mark"] != F.col("mark")))
    drawn = F.slice(F.array_sort(F.transform(others, lambda x: F.struct(_seeded(seed, F.col("own"), x["pid"]).alias("draw"), x["pid"].alias("pid")))), 1, n)
    return named.select("query", "split", "own", F.explode(drawn).alias("x")).select("query", F.col("x.pid").alias("doc_id"), "split", "own")


def random_negatives(asked: DataFrame, records: DataFrame, n: int = 1, seed: int = 42, look: int = 8, bucket_rows: int = 20_000) -> DataFrame:
    """For each query, ``n`` records of another title and, if one is near, of another jurisdiction.

    Records and queries of a split are put in one seeded order inside hash buckets of about ``bucket_rows`` records, and
    a query takes from the ``look`` records that follow its own there, the first ones again after the last: no pair of
    all records is formed, and no bucket grows with the data.
    """
    buckets = max(1, -(-records.count() // bucket_rows))
    w = Window.partitionBy("split", "bucket").orderBy("_h", "doc_id")
    placed = records.select("doc_id", "split", "title", "jurisdiction").withColumn("_h", _seeded(seed, F.col("doc_id"))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)))
    one = F.struct("doc_id", "title", "jurisdiction")
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = [F.lead(one, k).over(w) for k in range(1, look + 1)] + [F.nth_value(one, k).over(everything) for k in range(1, look + 1)]
    placed = placed.withColumn("near", F.array_distinct(F.filter(F.array(*after), lambda x: x["doc_id"].isNotNull() & (x["title"] != F.col("title")))))
    other = F.filter("near", lambda x: ~x["jurisdiction"].eqNullSafe(F.col("jurisdiction")))
    chosen = placed.select(F.col("doc_id").alias("own"), F.explode(F.slice(F.when(F.size(other) > 0, other).otherwise(F.col("near")), 1, n)).alias("x"))
    return asked.select("query", "split", F.col("doc_id").alias("own")).join(chosen, "own").select("query", F.col("x.doc_id").alias("doc_id"), "split", "own")


def build_pairs(records: DataFrame, extra_queries: DataFrame | None = None, n_hard: int = 1, n_random: int = 1, pool: int = 10, seed: int = 42) -> DataFrame:
    """Positive, hard and random negative rows of all splits; splits never mix, draws depend on the seed and ids only.

    ``pair_id`` is the split and a running number, in an order that the seed gives.
    """
    asked = positives(records, extra_queries)
    rows = _row(asked.withColumn("own", F.col("doc_id")), 1.0, "positive")
    rows = rows.unionByName(_row(hard_negatives(asked, records, pool, n_hard, seed), 0.0, "hard_negative"))
    rows = rows.unionByName(_row(random_negatives(asked, records, n_random, seed), 0.0, "random_negative"))
    rows = numbered(rows.withColumn("_h", _seeded(seed, F.col("query"), F.col("own"), F.col("doc_id"), F.col("type"))), "split", "_h")
    held = records.select("doc_id", "content", "category")  # contents come last, so that they are shuffled once
    return rows.join(held, "doc_id").select("split", "query", "content", "label", "type", "category", "doc_id", "pair_id")


def numbered(rows: DataFrame, split: str, order: str, digits: int = 3) -> DataFrame:
    """Rows with ``pair_id``: the split and a running number from 0 by ``order`` (hexadecimal hashes, unique in a split).

    Rows are counted by the first digits of the hash before they are numbered within these, so no split is sorted in one
    task.
    """
    rows = written(rows.withColumn("_head", F.substring(order, 1, digits)), "pairs")
    before = Window.partitionBy(split).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(split, "_head").agg(F.count("*").alias("_n")).select(split, "_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    number = F.row_number().over(Window.partitionBy(split, "_head").orderBy(order)) - 1 + F.col("_offset")
    return rows.join(offsets, [split, "_head"]).withColumn("pair_id", F.format_string("%s-%08d", split, number)).drop("_head", "_offset")


def shared_between_splits(rows: DataFrame, value: str = "query", split: str = "split") -> DataFrame:
    """Values that stand in more than one split, with the splits."""
    return rows.groupBy(value).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def unlabelled(rows: DataFrame, done: DataFrame, key: str = "pair_id", most: int | None = None) -> DataFrame:
    """Rows that a labelling run still has to do: those without a result, the first ``most`` by key."""
    left = rows.join(done.select(key), key, "left_anti")
    return left if most is None else left.orderBy(key).limit(most)


def label_pairs(rows: DataFrame, done: DataFrame, scorer, most: int | None = None, key: str = "pair_id") -> DataFrame:
    """The rows without a result in ``done``, each with ``teacher``: what ``scorer(query, contents)`` says, to four places.

    Pairs of one query in a batch are scored in one call.  A call that fails leaves its pairs out, so that a later run
    takes them again; append the result to the store that ``done`` is read from.
    """
    left = unlabelled(rows.drop("teacher"), done, key, most)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)

    def run(batches):
        for batch in batches:
            queries, contents = batch.column("query").to_pylist(), batch.column("content").to_pylist()
            groups: dict = {}
            for i, query in enumerate(queries):
                groups.setdefault(query, []).append(i)
            kept, found = [], []
            for query, places in groups.items():
                try:
                    scores = [round(float(x), 4) for x in scorer(query, [contents[i] for i in places])]
                except Exception:  # noqa: S112 - tried again by the next run
                    continue
                kept += places
                found += scores
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.float64())], names=[*some.schema.names, "teacher"])

    return left.repartition("query").mapInArrow(run, f"{schema}, teacher double")
