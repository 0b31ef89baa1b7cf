"""Sizes of texts in tokens of a public byte-level BPE vocabulary (a file of base64 pieces and ranks)."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..storage import written

#: How byte-level BPE vocabularies of this kind cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _counts(vocabulary, pattern: str):
    def run(batches):
        encode = _encoding(vocabulary.value, pattern).encode_ordinary
        for batch in batches:
            sizes = [0 if t is None else len(encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(sizes, pa.int64())], names=[*(n for n in batch.schema.names if n != "text"), "tokens"])

    return run


def token_counts(items: DataFrame, columns: dict[str, Column], text: Column, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """The named columns and ``tokens``, written once; null and empty texts have 0 tokens.

    The vocabulary file (under 1 MB) is read on the driver and sent to the tasks, so executors need not have it.
    """
    spark = items.sparkSession
    sent = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rows = items.select(*[c.alias(n) for n, c in columns.items()], text.alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return written(rows.mapInArrow(_counts(sent, pattern), f"{schema}, tokens bigint"), "tokens")


def limited(rows: DataFrame, most: int, what: str) -> list:
    """Rows of a table of settings, after a check of its size."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} {what}")
    return found
