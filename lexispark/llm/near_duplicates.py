"""Near-duplicate records: a blocked sparse product of the record-by-shingle incidence matrix with itself.

Rows of the matrix are records, columns word shingles.  Only the entries that the size-derived bound leaves (a record's
rarest shingles, see ``shingles``) are sent to the blocks; a block holds the columns of one hash range, multiplies them
with their transpose and emits partial overlap counts of record pairs, which are added up over the blocks.  Pairs whose
count stays below the bound are discarded, the rest is compared exactly on whole shingle sets.

Exact copies are one row of the product: they share a class, and a class that holds a third of all records costs one
row.  Columns that hold more than ``sh.HOT`` entries are cut into a grid of smaller blocks.  Nothing is sampled or capped.
"""

from __future__ import annotations

import zlib
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import shingles as sh
from .classes import SPAN, pair_rows
from .words import chunks, mix

#: Shared prefix shingles that a pair must have; the prefixes are longer by as many, which keeps every pair.
LEAST = 4
_U = np.uint64
_FLAG_BITS = 24
_BLOCK = 1 << 18
_SKETCHES = 256
#: Entries of a block that are multiplied at once (whole columns), pairs that are expanded at once, and pairs that are
#: held before they are passed on: what a task needs besides its block doesn't grow with the columns or their pairs.
_SLICE, _STEP, _HELD = 250_000, 500_000, 2_000_000
#: Entries of a block, and bytes of packed arrays that go to or from a Python worker in one Arrow batch.
_ENTRIES, _BATCH = 500_000, 8 << 20


@dataclass
class NearDuplicates:
    """``members``: id, rep (smallest id of its exact-copy class), copies (rows of the class); ``pairs``: a < b representatives, similarity."""

    members: DataFrame
    pairs: DataFrame


@contextmanager
def _small_batches(spark):
    """Arrow batches of ``_BATCH`` bytes while a job runs: they lie outside of the heap, several times over while they grow."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(_BATCH))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def record_text(title: Column, content: Column) -> Column:
    """Title (if any), a space and content; null where the content is null or blank."""
    return F.when(content.rlike(r"(?U)\S"), F.concat(F.coalesce(F.concat(title, F.lit(" ")), F.lit("")), content))


def flags(ids: Column, df: DataFrame) -> np.ndarray:
    """Bitmap of 2**24 slots (2 MB, whatever the input) of the hashed ids of ``df``."""
    slot = F.pmod(F.xxhash64(ids), F.lit(1 << _FLAG_BITS)) + 1  # these functions count from 1
    rows = df.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = np.zeros(1 << _FLAG_BITS - 3, np.uint8)
    for row in rows:
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def _counted(part: np.ndarray) -> bytes:
    """The counters of one block of the sketch: a byte each, and those above it as a list."""
    at = np.flatnonzero(part > 254)
    low = zlib.compress(np.minimum(part, 255).astype(np.uint8).tobytes(), 1)
    return len(low).to_bytes(4, "little") + low + sh.pack(at.astype(np.uint32), part[at])


def _counts_of(blob: bytes) -> np.ndarray:
    end = 4 + int.from_bytes(blob[:4], "little")
    out = np.frombuffer(zlib.decompress(blob[4:end]), np.uint8).astype(np.uint32)
    at, count = sh.unpack(blob[end:], np.uint32, np.uint32)
    out[at] = count
    return out


def _pass_one(size: int, least_words: int, slots: int):
    def run(batches):
        sketch = sh.Sketch(slots)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for at, part in chunks(texts):
                doc, hashes = sh.shingle_sets(part, size, least_words)
                sketch.add(sh.slots(hashes, slots))
                which, sizes, one, two = sh.set_hashes(doc, hashes)
                yield pa.record_batch({"id": pa.array(ids[at + which], pa.int64()), "n": pa.array(sizes, pa.int32()), "h1": pa.array(one), "h2": pa.array(two), "block": pa.nulls(len(which), pa.int32()), "counts": pa.nulls(len(which), pa.binary())})
        none = pa.nulls(1, pa.int64())
        for k, part in sketch.blocks(_BLOCK):
            yield pa.record_batch({"id": none, "n": none.cast(pa.int32()), "h1": none, "h2": none, "block": pa.array([k], pa.int32()), "counts": pa.array([_counted(part)], pa.binary())})

    return run


def _add_counts(last: bool):
    """Blocks of the sketch added up: as codes of one byte at last, before that as counts again."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = _counts_of(blob)
                total[block] = total[block] + counts if block in total else counts
        if total:
            yield pa.record_batch({"block": pa.array(list(total), pa.int32()), "counts": pa.array([sh.coded(t).tobytes() if last else _counted(t) for t in total.values()], pa.binary())})

    return run


def frequency_codes(first: DataFrame, slots: int) -> np.ndarray:
    """The sketch, added up over all tasks: one byte for each of its slots.

    The sketches of many tasks are added in two steps, so that no task gets more than about ``_SKETCHES`` of them.
    """
    rows, blocks = first.where("block is not null").select("block", "counts"), slots // _BLOCK
    tasks = first.rdd.getNumPartitions()
    if tasks > _SKETCHES:
        groups = -(-tasks // _SKETCHES)
        to = F.col("block") + blocks * F.pmod(F.spark_partition_id(), F.lit(groups))
        rows = rows.withColumn("to", to).repartitionById(blocks * groups, "to").select("block", "counts").mapInArrow(_add_counts(False), "block int, counts binary")
    adders = blocks // 4
    rows = rows.repartitionById(adders, F.col("block") % adders).mapInArrow(_add_counts(True), "block int, counts binary").collect()
    out = np.zeros(slots, np.uint8)
    for r in rows:
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(r.counts, np.uint8)
    return out


def hot_grid(token, code, rows, hot: int):
    """Copies of the entries of hot columns for each cell of the column's grid: (index of the entry, cell, side)."""
    cuts = np.ceil(sh.decoded(code) / hot).astype(np.int64)
    many = np.flatnonzero(cuts > 1)
    if not len(many):
        return np.arange(len(token)), token, np.zeros(len(token), np.uint8)
    k = cuts[many]
    mine = (mix(rows[many].view(_U)) % k.astype(_U)).astype(np.int64)
    entry, own = np.repeat(many, k), np.repeat(mine, k)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(k) - k, k)
    low, high = np.minimum(own, other), np.maximum(own, other)
    cell = mix(token[entry] ^ mix((low * (1 << 20) + high + 1).astype(_U))) & _U((1 << sh.TOKEN_BITS) - 1)
    side = np.where(own == other, 0, np.where(own == low, 1, 2)).astype(np.uint8)
    cold = np.flatnonzero(cuts <= 1)
    return np.concatenate([cold, entry]), np.concatenate([token[cold], cell]), np.concatenate([np.zeros(len(cold), np.uint8), side])


def _post(size: int, least_words: int, threshold: float, shared, parts: int, hot: int):
    def run(batches):
        codes, copied = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            for at, part in chunks(texts):
                doc, hashes = sh.shingle_sets(part, size, least_words)
                if not len(doc):
                    continue
                which, _, one, two = sh.set_hashes(doc, hashes)
                tag = np.zeros(len(part), np.int64)
                slot = marks[at + which]
                dup = (copied[slot >> 3] >> (slot & 7)) & 1
                tag[which] = np.where(dup == 1, one ^ (two << 1) | 1, 0)
                _, doc, token, code, position, n = sh.prefixes(doc, hashes, codes, threshold, LEAST)
                keep = code > 0  # a slot counted once has one shingle of one record
                doc, token, code, position, n = doc[keep], token[keep], code[keep], position[keep], n[keep]
                if not len(doc):
                    continue
                rows, tags = ids[at + doc], tag[doc]
                if tags.any():  # copies within this batch are one row already here
                    order = np.lexsort((rows, tags, token))
                    t, g = token[order], tags[order]
                    first = np.concatenate([[True], (g[1:] == 0) | (t[1:] != t[:-1]) | (g[1:] != g[:-1])])
                    order = order[first]
                    token, code, position, n, rows, tags = (x[order] for x in (token, code, position, n, rows, tags))
                entry, token, side = hot_grid(token, code, np.where(tags != 0, tags, rows), hot)  # copies fall into one grid row
                to = (mix(token) % _U(parts)).astype(np.int64)
                order = np.lexsort((token, to))
                entry, token, side, to = entry[order], token[order], side[order], to[order]
                edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
                blobs = []
                for i, j in zip(edge[:-1], edge[1:], strict=True):
                    e = entry[i:j]
                    blobs.append(sh.pack(token[i:j], rows[e], tags[e], n[e].astype(np.int32), position[e].astype(np.int32), side[i:j]))
                yield pa.record_batch({"part": pa.array(to[edge[:-1]], pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _multiply(threshold: float, parts: int):
    """One block: partial overlap counts of the pairs of records in its columns."""

    def emit(found: list[np.ndarray], rows: np.ndarray):
        codes = np.concatenate(found)
        found.clear()
        codes.sort()
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        count = np.minimum(np.diff(first, append=len(codes)), 65535).astype(np.uint16)
        codes = codes[first]
        a, b = rows[codes // len(rows)], rows[codes % len(rows)]
        del codes, first
        to = (mix(a.view(_U) ^ mix(b.view(_U))) % _U(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) > 0, [True]]))
        some, blobs, size = [], [], 0
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            o = order[i:j]
            some.append(to[o[0]])
            blobs.append(sh.pack(a[o], b[o], count[o]))
            size += len(blobs[-1])
            if size > _BATCH or j == len(order):
                yield pa.record_batch({"part": pa.array(some, pa.int32()), "blob": pa.array(blobs, pa.binary())})
                some, blobs, size = [], [], 0

    def run(batches):
        got = [sh.unpack_all(batch.column(1).to_pylist(), _U, np.int64, np.int64, np.int32, np.int32, np.uint8) for batch in batches]
        if not got:
            return
        all_token, row, all_tag, all_n, all_position, all_side = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        if not len(row):
            return
        rows, all_index = np.unique(row, return_inverse=True)
        del row
        by_token = np.argsort(all_token, kind="stable")
        ordered = all_token[by_token]
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        del ordered
        found, held, i = [], 0, 0
        while i + 1 < len(edge):
            k = max(i + 1, int(np.searchsorted(edge, edge[i] + _SLICE, side="right")) - 1)
            mine, i = by_token[edge[i] : edge[k]], k
            token, index, tag, n, position, side = (x[mine] for x in (all_token, all_index, all_tag, all_n, all_position, all_side))
            order = np.lexsort((index, tag, side, token))
            same = np.concatenate([[False], (tag[order][1:] != 0) & (tag[order][1:] == tag[order][:-1]) & (token[order][1:] == token[order][:-1]) & (side[order][1:] == side[order][:-1])])
            order = order[~same]  # of copies the smallest row stays, the same one in every block
            order = order[np.lexsort((n[order], token[order]))]
            token, index, position, side = (x[order] for x in (token, index, position, side))
            n = n[order].astype(np.int64)
            group = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]).astype(np.int64)]))
            for left, right in sh.expand(sh.spans_of_pairs(group, n, position, threshold, LEAST), _STEP):
                need = sh.needed(n[left], n[right], threshold)
                ok = (position[left] < n[left] - need + LEAST) & (position[right] < n[right] - need + LEAST)
                ok &= ((side[left] == 0) | (side[left] != side[right])) & (index[left] != index[right])
                left, right, need = left[ok], right[ok], need[ok]
                low, high = np.minimum(index[left], index[right]), np.maximum(index[left], index[right])
                found.append(np.repeat(low * len(rows) + high, np.where(need < LEAST, LEAST, 1)))  # small sets may have to share fewer
                held += len(found[-1])
                if held > _HELD:
                    yield from emit(found, rows)
                    held = 0
        if held:
            yield from emit(found, rows)

    return run


def _add_up(least: int):
    def run(batches):
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        if not blobs:
            return
        a, b, count = sh.unpack_all(blobs, np.int64, np.int64, np.uint16)
        order = np.lexsort((b, a))
        a, b, count = a[order], b[order], count[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        total = np.add.reduceat(count, first)
        keep = first[total >= least]
        yield pa.record_batch({"a": pa.array(a[keep], pa.int64()), "b": pa.array(b[keep], pa.int64())})

    return run


def _redealt(parts: int, cuts: int):
    """Packed pairs of one partition dealt on to ``cuts`` partitions by a second hash."""

    def run(batches):
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b, count = sh.unpack(blob, np.int64, np.int64, np.uint16)
                to = mix(mix(a.view(_U)) + b.view(_U)) % _U(cuts)
                out: dict[str, list] = {"part": [], "blob": []}
                for k in np.unique(to):
                    some = to == k
                    out["part"].append(part + parts * int(k))
                    out["blob"].append(sh.pack(a[some], b[some], count[some]))
                yield pa.record_batch({"part": pa.array(out["part"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    return run


def added_up(partial: DataFrame, parts: int, least: int, each: int = 1_000_000) -> DataFrame:
    """Pairs (a, b) whose partial counts (packed, by ``parts`` hash parts of the pair) sum up to ``least``.

    The counts are written first, so that the number of partitions they are added up in follows from how many there are:
    pairs grow faster than records, and no partition gets more than about ``each`` of them.
    """
    with _small_batches(partial.sparkSession):
        counts = written(partial, "counts")
    cuts = max(1, -(-(counts.agg(F.sum(F.length("blob"))).first()[0] or 0) // (18 * each * parts)))
    if cuts > 1:
        counts = counts.mapInArrow(_redealt(parts, cuts), "part int, blob binary")
    return counts.repartitionById(parts * cuts, "part").mapInArrow(_add_up(least), "a bigint, b bigint")


def _sets_of(size: int, least_words: int, wanted):
    """Whole shingle sets of the wanted records, as hashes of 40 bits: two sets of 1000 agree by chance once in 10**6."""

    def run(batches):
        bits = wanted.value
        for batch in batches:
            marks = batch.column(2).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero((bits[marks >> 3] >> (marks & 7)) & 1)
            if not len(keep):
                continue
            batch = batch.take(pa.array(keep))
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for at, part in chunks(texts):
                doc, hashes = sh.shingle_sets(part, size, least_words)
                if not len(doc):
                    continue
                edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
                yield pa.record_batch({"id": pa.array(ids[at + doc[edge[:-1]]], pa.int64()), "shingles": pa.array([sh.pack(hashes[i:j] >> _U(24)) for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    return run


def _compare(threshold: float):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            common = np.zeros(len(left), np.int64)
            a, b = (np.array([len(x) // 8 for x in side], np.int64) for side in (left, right))
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                both = np.concatenate([*sh.unpack(x, _U), *sh.unpack(y, _U)])
                both.sort()
                common[i] = np.count_nonzero(both[1:] == both[:-1])
            keep = np.flatnonzero(sh.similar(common, a, b, threshold))
            yield pa.record_batch({"a": batch.column(0).take(pa.array(keep)), "b": batch.column(1).take(pa.array(keep)), "similarity": pa.array((common / np.maximum(1, a + b - common))[keep])})

    return run


def exact_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets (id, shingles) have the similarity: a, b, similarity."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "left", "right").mapInArrow(_compare(threshold), f"a {kind}, b {kind}, similarity double")


def near_duplicates(records: DataFrame, id_column: str, text: Column, threshold: float = 0.8, size: int = 5, least_words: int = 1) -> NearDuplicates:
    """Find all pairs of records whose sets of ``size``-word shingles have a Jaccard similarity of ``threshold`` or more.

    ``id_column`` must be a unique BIGINT.  Null texts and texts with fewer than ``least_words`` or ``size`` words are
    in no class and no pair.  Texts with equal shingle sets are one class; its smallest id stands for it in ``pairs``.
    Repeated ids, ties and empty tables are allowed: a pair never joins an id with itself, an empty table gives none.
    Other columns are not read, so their names can't clash.
    """
    spark = records.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = records.select(F.col(id_column).alias("id"), text.alias("text")).where("id is not null and text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = sh.sketch_size(chars)
    first = written(rows.mapInArrow(_pass_one(size, least_words, slots), "id bigint, n int, h1 bigint, h2 bigint, block int, counts binary"), "classes")
    known = first.where("id is not null").select("id", "n", "h1", "h2")
    by_class = known.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = written(known.join(by_class, ["h1", "h2", "n"]).select("id", "rep", "copies"), "members")
    total = known.agg(F.sum("n")).first()[0] or 0
    codes = frequency_codes(first, slots)
    copied = flags(F.col("id"), members.where("copies > 1"))
    shared = spark.sparkContext.broadcast((codes, copied))
    parts = sh.partitions_for(total * ((1 - threshold) * 1.1), least, _ENTRIES)
    marked = rows.withColumn("mark", F.pmod(F.xxhash64("id"), F.lit(1 << _FLAG_BITS)))
    posted = marked.mapInArrow(_post(size, least_words, threshold, shared, parts, sh.hot_from(chars, sh.HOT)), "part int, blob binary")
    blocks = posted.repartitionById(parts, "part").mapInArrow(_multiply(threshold, parts), "part int, blob binary")
    sums = added_up(blocks, parts, LEAST)
    with _small_batches(spark):
        close = written(sums, "candidates")
    wanted = spark.sparkContext.broadcast(flags(F.col("id"), close.select(F.explode(F.array("a", "b")).alias("id"))))
    sets = marked.mapInArrow(_sets_of(size, least_words, wanted), "id bigint, shingles binary")
    return NearDuplicates(members, exact_pairs(close, sets, threshold))


def all_pairs(found: NearDuplicates) -> DataFrame:
    """Every pair of similar records, copies included: row_id_a < row_id_b."""
    left, right = (found.members.select(F.col("rep").alias(c), F.col("id").alias(f"{c}_id")) for c in "ab")
    copied = found.members.where("id = rep and copies > 1").select(F.col("rep").alias("class"), F.col("copies").alias("n")).distinct()
    pairs = found.pairs.select("a", "b").unionByName(copied.select(F.col("class").alias("a"), F.col("class").alias("b")))
    large = copied.where(F.col("n") > SPAN)
    both = pair_rows(pairs, left, right, large, large).where((F.col("a") != F.col("b")) | (F.col("a_id") < F.col("b_id")))
    return both.select(F.least("a_id", "b_id").alias("row_id_a"), F.greatest("a_id", "b_id").alias("row_id_b"))
