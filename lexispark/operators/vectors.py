"""Embedding columns: similarity search in blocks, calibrated scores, and a store keyed by text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written

#: Query vectors of one block: at most about 16 MB of a broadcast of 1024 dimensions.
BLOCK_QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(block, k: int):
    """The best ``k`` rows of a task for each query of the block; equal scores by key."""

    def run(batches):
        ids, vectors = block.value
        score, key = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(keys) or not len(ids):
                continue
            score = np.concatenate([score, np.round(vectors @ _matrix(batch.column(1)).T, 12)], 1)
            key = np.concatenate([key, np.broadcast_to(keys, (len(ids), len(keys)))], 1)
            if score.shape[1] > k:
                least = np.partition(score, score.shape[1] - k, 1)[:, [-k]]
                order = np.lexsort((key, -score), axis=1) if (np.count_nonzero(score >= least, 1) > k).any() else np.argpartition(-score, k - 1, 1)
                score, key = (np.take_along_axis(x, order[:, :k], 1) for x in (score, key))
        if score.size:
            yield pa.record_batch({"qid": pa.array(np.repeat(ids, score.shape[1])), "pid": pa.array(key.ravel()), "cosine": pa.array(score.ravel())})

    return run


def _reaching(block, least: float):
    def run(batches):
        ids, vectors = block.value
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            score = np.round(vectors @ _matrix(batch.column(1)).T, 12)
            q, p = np.nonzero(score >= least)
            yield pa.record_batch({"qid": pa.array(ids[q]), "pid": batch.column(0).take(pa.array(p)), "cosine": pa.array(score[q, p])})

    return run


def _by_blocks(queries: DataFrame, vectors: DataFrame, key: str, vector: str, search) -> DataFrame:
    """Union of what ``search(block)`` finds in the rows for each block of queries, one block in memory at a time."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("pid"), F.col(vector).alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("qid"), F.col(vector).alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()
        block = spark.sparkContext.broadcast((part["qid"].to_numpy(), _matrix(part["v"].combine_chunks())))
        found = rows.mapInArrow(search(block), "qid bigint, pid bigint, cosine double")
        if blocks > 1:
            found = written(found, "block")
            block.destroy()
        out = found if out is None else out.unionByName(found)
    return out.where("qid != pid")


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """The k rows with the largest dot product (cosine of unit vectors) for each query row, itself left out.

    Queries are sent in blocks of bounded size; each task multiplies a block with its rows and keeps the best k, so
    k rows per query and task are shuffled and no pair is formed.  Null vectors take no part.
    """
    found = _by_blocks(queries, vectors, key, vector, lambda block: _best(block, k + 1))
    order = Window.partitionBy("qid").orderBy(F.desc("cosine"), "pid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def at_least(queries: DataFrame, vectors: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """Every row whose dot product with a query row is ``least`` or more, itself left out: qid, pid, cosine.

    All rows are gone through for every query, in blocks as in ``nearest``; only what reaches the bound comes out.
    """
    return _by_blocks(queries, vectors, key, vector, lambda block: _reaching(block, least))


def missing(texts: DataFrame, text: str, store: DataFrame) -> DataFrame:
    """Distinct texts that the store (text_key, vector, created) has no vector for: text_key and text."""
    wanted = texts.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("text_key"), F.col(text).alias("text")).dropDuplicates(["text_key"])
    return wanted.join(store.select("text_key"), "text_key", "left_anti")


def retained(store: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` rows of a store; equal times by key. Top rows are taken per partition before they meet."""
    return store.orderBy(F.desc("created"), "text_key").limit(most)


def pool(states: np.ndarray, mask: np.ndarray, kind: str = "mean") -> np.ndarray:
    """Unit vectors from token states (rows, tokens, dims): the mean over the mask, or the first token's."""
    if kind == "mean":
        weights = mask[..., None].astype(states.dtype)
        found = (states * weights).sum(1) / np.maximum(weights.sum(1), 1)
    else:
        found = states[:, 0]
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def embed(texts: DataFrame, text: str, encoder, store: DataFrame, batch: int = 16) -> DataFrame:
    """Rows of a store for the texts it lacks: ``encoder(list of texts)`` gives a matrix, called once per batch in tasks."""

    def run(batches):
        for rows in batches:
            keys, values = rows.column("text_key").to_pylist(), rows.column("text").to_pylist()
            order = sorted(range(len(values)), key=lambda i: len(values[i]))  # near lengths together: little padding
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                matrix = np.asarray(encoder([values[i] for i in some]), np.float32)
                yield pa.record_batch({"text_key": pa.array([keys[i] for i in some]), "vector": pa.array(list(matrix), pa.list_(pa.float32()))})

    found = missing(texts, text, store).mapInArrow(run, "text_key string, vector array<float>")
    return found.withColumn("created", F.current_timestamp())


def embed_cached(rows: DataFrame, text: str, encoder, store: DataFrame, batch: int = 16) -> tuple[DataFrame, DataFrame, int]:
    """(every row with its ``vector``; the rows to append to the store; how many texts the store lacked).

    Each distinct text that the store lacks is encoded once, and written before it is joined back by its key; a row with a
    null text has a null vector.  Columns of ``rows`` stay as they are.
    """
    new = written(embed(rows, text, encoder, store, batch), "vectors")
    known = store.select("text_key", "vector").unionByName(new.select("text_key", "vector"))
    keyed = rows.withColumn("_key", F.sha2(F.col(text), 256))
    joined = keyed.join(known.withColumnRenamed("text_key", "_key"), "_key", "left").drop("_key")
    return joined, new, new.count()
