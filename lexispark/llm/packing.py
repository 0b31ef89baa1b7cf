"""Filling containers of fixed capacity with items of varying length: best fit with several permitted sizes.

Items are dealt to shards by a hash, as many shards as keep each small, and each shard of each profile is packed by
itself: longest items first, each into the open bin it fills best.  Where none has room a bin is opened, of the permitted
size that costs least per token it can be expected to hold: each size is tried with the longest of the remaining items
that fit.  At last every bin is downsized to the smallest permitted size that holds its contents.  The packings that
always open one size or a larger one are tried as well, and the cheapest of all is kept.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one shard; a shard leaves a few bins partly empty, out of hundreds.
SHARD_ITEMS = 20_000


def expected_fill(lengths: list[int], at: int, size: int) -> int:
    """Tokens of a bin of that size that item ``at`` opens and the longest later items that fit go on to fill."""
    filled = lengths[at]
    at += 1
    while at < len(lengths) and filled < size:
        at = bisect_left(lengths, filled - size, lo=at, key=lambda n: -n)
        if at < len(lengths) and lengths[at]:
            filled += lengths[at]
            at += 1
        else:
            break
    return filled


def best_fit(lengths: list[int], sizes: list[int], bin_cost: int, least: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """Bin of each item (longest first is the caller's order), size and content of each bin.

    A bin is opened at the size with the least cost per token expected in it, or, if ``least`` is given, at the smallest
    size of at least that.
    """
    room: list[tuple[int, int]] = []
    where, opened, content = [], [], []
    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            fits = [s for s in sizes if s >= max(n, least or 0)]
            left = fits[0] if least is not None or not n else min(fits, key=lambda s: ((s + bin_cost) / expected_fill(lengths, i, s), -s))
            k = len(opened)
            opened.append(left)
            content.append(0)
        where.append(k)
        content[k] += n
        if left > n or n == 0:
            insort(room, (left - n, k))
    return where, [next(s for s in sizes if s >= c) for c in content], content


def joint_best_fit(lengths: list[int], sizes: list[int], bin_cost: int) -> tuple[list[int], list[int], list[int]]:
    """The cheapest packing: total size, and ``bin_cost`` for each bin."""
    tried = [best_fit(lengths, sizes, bin_cost, least) for least in (None, *sizes)]
    return min(tried, key=lambda p: sum(p[1]) + bin_cost * len(p[1]))


def _pack_shard(sizes_of: dict[str, list[int]], bin_cost: int):
    def run(table: pa.Table) -> pa.Table:
        profile, shard = table["profile"][0].as_py(), table["shard"][0].as_py()
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece_no", "ascending")])
        sizes = sizes_of[profile]
        where, size, content = joint_best_fit(table["length"].to_pylist(), sizes, bin_cost)
        ids = pa.array([f"{shard}-{k}" for k in where], pa.string())
        return table.drop_columns(["shard"]).append_column("container", ids).append_column("container_size", pa.array([size[k] for k in where], pa.int64())).append_column("container_used", pa.array([content[k] for k in where], pa.int64()))

    return run


def pack(items: DataFrame, profiles: list[tuple[str, int]], fractions: tuple[int, ...] = (1, 2, 4, 8), shard_items: int = SHARD_ITEMS, bin_cost: int = 1) -> DataFrame:
    """Assign every item (id, tokens) to a container of each profile (name, capacity).

    Only items over the capacity are cut: into pieces of just the capacity and a last one with the rest, which is packed
    like any item.  Items of no length (null and empty texts) are put into a container too.  A container's size is its
    profile's capacity over one of ``fractions``, and ``bin_cost`` tokens more count for each container opened.  One row per profile, item and piece; ids must be unique; an empty table
    gives an empty result.  Profiles with a null or no capacity are refused.
    """
    if any(not c or c < 1 for _, c in profiles):
        raise ValueError("every profile needs a capacity")
    sizes_of = {name: sorted({max(1, cap // f) for f in fractions} | {cap}) for name, cap in profiles}
    spark = items.sparkSession
    wanted = spark.createDataFrame([(n, int(c)) for n, c in profiles], "profile string, capacity bigint")
    shards = max(1, -(-items.count() // shard_items))
    rows = items.select("id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    rows = rows.crossJoin(F.broadcast(wanted)).withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int"))
    cut = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    cut = cut.withColumn("start", F.col("piece_no") * F.col("capacity")).withColumn("length", F.least("capacity", F.col("tokens") - F.col("start")))
    kind = items.schema["id"].dataType.simpleString()
    # full pieces fill a container each and need no packing, so one endless item can't swell a shard
    number = F.concat_ws("-", F.lit("full"), "id", "piece_no")
    full = cut.where("length = capacity").select("profile", "capacity", "id", "tokens", "n_pieces", "piece_no", "start", "length", number.alias("container"), F.col("capacity").alias("container_size"), F.col("length").alias("container_used"))
    rest = cut.where("length < capacity").select("profile", "capacity", "id", "tokens", "n_pieces", "piece_no", "start", "length", "shard")
    schema = f"profile string, capacity bigint, id {kind}, tokens bigint, n_pieces int, piece_no int, start bigint, length bigint, container string, container_size bigint, container_used bigint"
    packed = rest.groupBy("profile", "shard").applyInArrow(_pack_shard(sizes_of, bin_cost), schema)
    return full.unionByName(packed)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per profile: items, pieces, containers (and those of a smaller size), their total size and content, and the share of it that is used."""
    bins = packed.groupBy("profile", "capacity", "container").agg(F.first("container_size").alias("size"), F.sum("length").alias("used"), F.count("*").alias("pieces"), F.count_if(F.col("piece_no") == 0).alias("items"))
    smaller = F.count_if(F.col("size") < F.col("capacity")).alias("smaller_containers")
    out = bins.groupBy("profile", "capacity").agg(F.sum("items").alias("items"), F.sum("pieces").alias("pieces"), F.count("*").alias("containers"), smaller, F.sum("size").alias("size_tokens"), F.sum("used").alias("used_tokens"))
    return out.withColumn("fill", F.round(F.col("used_tokens") / F.col("size_tokens"), 6))
