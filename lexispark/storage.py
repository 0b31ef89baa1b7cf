"""Where intermediate tables live: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach; a local temporary one only where the session names none (tests)."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        named = spark.sparkContext.getCheckpointDir()
        if named:
            return named
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexispark-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext.getCheckpointDir() or folder
    return folder


#: Tables that this program has written and not discarded.
_kept: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several jobs read, and return it as a scan: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lexispark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _kept.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexispark_path = path
    return out


def written_with_count(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written``, and how many rows there are, counted by the same job."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _kept.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, once nothing reads them any more."""
    for table in tables:
        _delete(table.sparkSession, table._lexispark_path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this program has written: for the end of a run, when every result has been read or saved."""
    for path in list(_kept):
        _delete(spark, path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows, as it is (for a shuffled join) if it has more."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
