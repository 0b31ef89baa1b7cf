"""Documents as they arrive: a file stream cut into passages and appended to a table, each document once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.passages import passages

#: Keeps the keys seen so far on disk and not in an executor's memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(spark: SparkSession, source: str, schema: StructType | str, key: str, text: str, table: str, checkpoint: str, file_name: str | None = None) -> StreamingQuery:
    """Start a query that reads new files of ``source`` and appends passages of documents not seen before to ``table``.

    The keys of documents are the query's state, dealt to all tasks by their hash: a batch looks up its own keys and
    never reads the table.  State and file sink commit with the batch, so one that is repeated after a failure adds
    nothing twice.  Of equal keys the first to come stays; null keys are left out.  ``availableNow``: what has arrived is
    taken, then the query ends.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    new = spark.readStream.schema(schema).parquet(source).where(F.col(key).isNotNull()).dropDuplicates([key])
    found = passages(new, key, F.col(text), F.col(file_name) if file_name else None)
    return found.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
