"""Pairs of classes of equal texts, written out as pairs of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import small

#: Rows of one part of a class; a class that holds a third of all rows comes in many parts, which are paired apart.
SPAN = 1_000


def pair_rows(pairs: DataFrame, left: DataFrame, right: DataFrame, large_left: DataFrame, large_right: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows of ``pairs`` (a, b, ...) with each row of ``left`` (a, a_id, ...) and of ``right`` (b, b_id, ...).

    ``large_left`` and ``large_right`` name the classes with more than ``span`` rows: (class, n), unique.  Their rows are
    dealt to parts by the hash of their ids, and a pair becomes one row for each pair of parts, so that no key of the
    joins has more than about ``span`` rows on its right side.  Nothing is dropped; empty tables give an empty result.
    """
    sides = {"a": left, "b": right}
    for side, large in (("a", large_left), ("b", large_right)):
        parts = small(large.select(F.col("class").alias(side), F.ceil(F.col("n") / span).cast("bigint").alias("parts")))
        n = F.coalesce("parts", F.lit(1).cast("bigint"))
        pairs = pairs.join(parts, side, "left").withColumn(f"{side}_part", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))).drop("parts")
        sides[side] = sides[side].join(parts, side, "left").withColumn(f"{side}_part", F.pmod(F.xxhash64(f"{side}_id"), n)).drop("parts")
    return pairs.join(sides["a"], ["a", "a_part"]).join(sides["b"], ["b", "b_part"]).drop("a_part", "b_part")
