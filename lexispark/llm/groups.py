"""Splits that keep related records together: connected records by random-mate contraction, then shares by weight.

Vertices are record ids: a key value (say, a court) is stood for by the smallest id that has it, so no value is hashed
and a value that a third of all records has is one vertex.  Each round every vertex throws a coin that depends on its
id and the round only; each tail with a neighbour that shows heads is merged into the smallest of these.  Rounds are
SQL joins over the edges that are left, written to the shared folder (one job a round, which counts them as well) and
deleted once the labels are unwound; about a quarter of the vertices vanish in each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import discard, small, written, written_with_count


def tie_key(value: Column) -> Column:
    """Value without letter case, outer and repeated white space; null if blank."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " "))), F.lit(""))


def contract(edges: DataFrame) -> DataFrame:
    """Component of every vertex that has an edge: (vertex, root), root being one vertex of the component.

    ``edges`` has BIGINT columns u and v in any order; loops, repeated edges and null ends are ignored.
    """
    left = edges.where("u != v").select("u", "v")
    left, n = written_with_count(left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    rounds: list[DataFrame] = []
    moves: list[DataFrame] = []
    while n:
        heads = F.pmod(F.xxhash64(F.col("v"), F.lit(len(moves))), F.lit(2)) == 1
        tails = F.pmod(F.xxhash64(F.col("u"), F.lit(len(moves))), F.lit(2)) == 0
        move = left.where(tails & heads).groupBy("u").agg(F.min("v").alias("to"))
        rounds.append(left)
        moves.append(move.select(F.col("u").alias("vertex"), "to"))
        for end in "uv":
            now = move.select(F.col("u").alias(end), F.col("to").alias(f"{end}_to"))
            left = left.join(now, end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
        left, n = written_with_count(left.where("u != v").distinct(), "edges")
    discard(left)
    if not moves:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).limit(0)
    roots = None
    for k in range(len(moves) - 1, -1, -1):  # unwind: what a vertex was merged into may have been merged later
        if roots is None:
            roots = moves[k].select("vertex", F.col("to").alias("root"))
        else:
            onward = roots.select(F.col("vertex").alias("to"), "root")
            roots = moves[k].join(onward, "to", "left").select("vertex", F.coalesce("root", "to").alias("root")).unionByName(roots)
        if k % 4 == 0:
            roots = written(roots, "roots")
    discard(*rounds)
    # every surviving vertex is a root: it is never moved, so it has no row yet
    return roots.unionByName(roots.select(F.col("root").alias("vertex"), "root").distinct())


@dataclass
class Groups:
    """``records``: id, group (smallest id of the group), values (different values of the first key in the group), size."""

    records: DataFrame


def tied_groups(records: DataFrame, id_column: str, keys: list[Column]) -> Groups:
    """Records that share one of the keys, directly or through others, are one group.

    Keys are compared as ``tie_key`` gives them; null and blank ones tie nothing, and a record without any key is a
    group of its own.  ``id_column`` must be a unique BIGINT; rows without an id are left out.
    """
    rows = records.select(F.col(id_column).alias("id"), *[tie_key(k).alias(f"k{n}") for n, k in enumerate(keys)]).where("id is not null")
    first = rows.where("k0 is not null").groupBy("k0").agg(F.min("id").alias("base"))
    based = rows.join(first, "k0", "left").withColumn("value", F.col("base"))
    edges: list[DataFrame] = []
    for n in range(1, len(keys)):
        key = f"k{n}"
        based = written(based.drop("k0"), "based")
        by_value = based.where(f"{key} is not null").groupBy(key).agg(F.min("base").alias("low"), F.max("base").alias("high"), F.min("id").alias("own"))
        wide = by_value.where("low < high").select(key, "low")
        edges.append(based.where("base is not null").select(key, "base").join(wide, key).where("base != low").select(F.col("low").alias("u"), F.col("base").alias("v")).distinct())
        based = based.join(by_value.select(key, F.coalesce("low", "own").alias("other")), key, "left").withColumn("base", F.coalesce("base", "other")).drop("other")
    based = written(based.select("id", "value", F.coalesce("base", "id").alias("base")), "based")
    if edges:
        roots = contract(reduce(DataFrame.unionByName, edges)).select(F.col("vertex").alias("base"), "root")
        based = based.join(roots, "base", "left").select("id", "value", F.coalesce("root", "base").alias("root"))
    else:
        based = based.withColumnRenamed("base", "root")
    # values are counted after they have been made distinct, so no group is gathered in one task
    values = based.where("value is not null").select("root", "value").distinct().groupBy("root").agg(F.count("*").alias("values"))
    whole = based.groupBy("root").agg(F.min("id").alias("group"), F.count("*").alias("size")).join(values, "root", "left")
    return Groups(based.join(whole, "root").select("id", "group", F.coalesce("values", F.lit(0)).alias("values"), "size"))


def deal(weights: list[tuple[int, int]], shares: list[float]) -> list[list[int]]:
    """How many groups of each (weight, number), heaviest first, go to each split, by what its cumulative weight lacks.

    The groups of one weight go to the splits in proportion to what these lack, and the few that are left over to those
    that then lack most.  Light groups come last and even out what heavy ones left uneven.
    """
    lack = [s / sum(shares) * sum(w * n for w, n in weights) for s in shares]
    out = []
    for w, n in weights:
        total = sum(max(0.0, x) for x in lack)
        got = [int(n * max(0.0, x) / total) if total else 0 for x in lack]
        lack = [x - w * k for x, k in zip(lack, got, strict=True)]
        for _ in range(n - sum(got)):
            i = max(range(len(lack)), key=lack.__getitem__)
            got[i] += 1
            lack[i] -= w
        out.append(got)
    return out


def share_splits(groups: DataFrame, group: str, weight: str, targets: list[tuple[str, float]], buckets: int = 1024) -> DataFrame:
    """A split for every group, by cumulative weight, heaviest groups first: (group, weight, split).

    Shares are scaled to sum 1.  How many groups of each weight go to which split is worked out from the numbers of groups
    of each weight (see ``deal``): different weights are fewer than the square root of twice the total weight, groups
    themselves are never collected.  Which groups these are follows from their number among those of their weight,
    counted in two steps (hash buckets first), so nothing is ordered in one task; ``buckets`` should grow with the groups.
    """
    spark = groups.sparkSession
    rows = groups.select(F.col(group).alias("group"), F.col(weight).cast("bigint").alias("weight")).withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    counts = written(rows.groupBy("weight", "bucket").agg(F.count("*").alias("n")), "weights")
    weights = [tuple(r) for r in counts.groupBy("weight").agg(F.sum("n").alias("n")).orderBy(F.desc("weight")).collect()]
    ends = [(w, [sum(got[: k + 1]) for k in range(len(got))]) for (w, _), got in zip(weights, deal(weights, [s for _, s in targets]), strict=True)]
    planned = spark.createDataFrame(ends, "weight bigint, ends array<bigint>")
    inside = Window.partitionBy("weight").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("weight", "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("offset")).join(small(planned), "weight")
    number = F.col("offset") + F.row_number().over(Window.partitionBy("weight", "bucket").orderBy("group"))
    placed = rows.join(offsets, ["weight", "bucket"]).withColumn("number", number)
    names = F.array(*[F.lit(n) for n, _ in targets])
    return placed.select("group", "weight", F.element_at(names, F.size(F.filter("ends", lambda e: e < F.col("number"))) + 1).alias("split"))


def grouped_splits(records: DataFrame, id_column: str, keys: list[Column], targets: list[tuple[str, float]]) -> DataFrame:
    """A split for every record, none for two tied ones apart: id, group, split."""
    found = tied_groups(records, id_column, keys).records
    found = written(found.select("id", "group", "size"), "tied")
    splits = share_splits(found.select("group", "size").distinct(), "group", "size", targets, max(1024, found.count() // 100_000))
    return found.join(splits.select("group", "split"), "group").select("id", "group", "split")
