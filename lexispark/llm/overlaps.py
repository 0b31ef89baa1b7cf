"""Records of evaluation splits that stand in the training split: a suffix array in partitions, common prefixes, coverage.

Texts with the same words in the same order are one class.  The classes are texts of one collection whose suffixes (one
for each word) are sorted: a suffix goes to the partition of its first ``size`` words, and each partition sorts those it
gets by these and the next ``AHEAD`` words.  The longest common prefix with the other split is read off the neighbours
in that order: it is the deepest interval of common prefixes in which both splits stand.  Suffixes that have one of
``size`` words or more are shared spans; they go back to their texts, where they are merged into coverage: how many
words, and how many of the text's distinct word runs, the other split has.

Texts of which too few runs are shared have no similar text in the other split and end here.  Each of the others names
the intervals of its rarest shared suffixes, as many as the size-derived bound asks for (see ``shingles``): similar
texts stand together in at least ``LEAST`` of them, so no pair is lost, and the intervals of frequent phrases are never
written out as pairs.  Pairs that stand together that often are compared exactly.

A run of words that more than ``sh.HOT`` texts have is dealt to several partitions, for the sorting as for the intervals.
Which side has the run is told to each of these, so coverage is the same as without the dealing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import shingles as sh
from .classes import SPAN, pair_rows
from .near_duplicates import _FLAG_BITS, _pass_one, _sets_of, added_up, exact_pairs, flags, frequency_codes
from .words import chunks, mix, runs, split_words

#: Intervals that a pair must share, and words of a suffix that are sorted beyond its first run (16 bits of each one's hash).
LEAST, AHEAD = 4, 8
_U = np.uint64
TRAIN, EVAL = 1, 2


@dataclass
class Overlaps:
    """``members``: class, field, pair_id, words and what else the rows have; ``pairs``: eval_class, train_class, similarity;
    ``classes``: class, with the numbers of its rows on both sides (trains, evals); ``coverage``: class, covered (words
    in spans that the other split has), spans (stretches of such words) and longest (words of the longest of these)."""

    members: DataFrame
    pairs: DataFrame
    classes: DataFrame
    coverage: DataFrame


def _sequence_hashes(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        one, two, count = (np.zeros(len(texts), np.int64) for _ in "otc")
        for at, part in chunks(texts):
            words = split_words(part)
            n = np.diff(words.first)
            some = np.flatnonzero(n)
            count[at : at + len(part)] = n
            if len(some):
                place = (np.arange(len(words.hashes)) - np.repeat(words.first[:-1], n)).astype(_U)
                for out, salt in ((one, _U(0x5851F42D4C957F2D)), (two, _U(0x14057B7EF767814F))):
                    out[at + some] = mix(np.add.reduceat(mix(words.hashes + place * salt), words.first[:-1][some])).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one), pa.array(two), pa.array(count.astype(np.int32))], names=[*batch.schema.names, "h1", "h2", "n"])


def hot_cells(token, code, ids, sides, hot: int):
    """Entries of runs with more than ``hot`` of them, for each cell of the run's grid: (index of the entry, cell, side).

    A training text stands in all cells of one row, a held-out one in all cells of one column, so they meet in one cell.
    """
    cuts = np.ceil(sh.decoded(code) / hot).astype(np.int64)
    cold, many = np.flatnonzero(cuts <= 1), np.flatnonzero(cuts > 1)
    found = [(cold, token[cold], sides[cold])]
    for side in (TRAIN, EVAL):
        of = many[(sides[many] & side) > 0]
        k = cuts[of]
        own = np.repeat((mix(ids[of].view(_U)) % k.astype(_U)).astype(np.int64), k)
        entry = np.repeat(of, k)
        other = np.arange(len(entry)) - np.repeat(np.cumsum(k) - k, k)
        row, column = (own, other) if side == TRAIN else (other, own)
        cell = mix(token[entry] ^ mix((row * (1 << 20) + column + 1).astype(_U))) & _U((1 << sh.TOKEN_BITS) - 1)
        found.append((entry, cell, np.full(len(entry), side, np.uint8)))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _dealt(to: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows packed by the partition that each goes to."""
    order = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) > 0, [True]]))
    blobs = [sh.pack(*(c[order[i:j]] for c in columns)) for i, j in zip(edge[:-1], edge[1:], strict=True)]
    return pa.record_batch({"part": pa.array(to[order][edge[:-1]], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _following(words, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Four words from each place on in one number, the first one highest; 0 stands for no word."""
    out = np.zeros(len(at), _U)
    for k in range(4):
        word = (words.hashes[np.minimum(at + k, len(words.hashes) - 1)] >> _U(48)) | _U(1)
        out = (out << _U(16)) | np.where(at + k < end, word, _U(0))
    return out


def _suffixes(size: int, codes_of, parts: int, hot: int):
    def run(batches):
        codes, told = codes_of.value, set()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            sides = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            for at, part in chunks(texts):
                words = split_words(part)
                hashes, begin = runs(words, size)
                if not len(hashes):
                    continue
                doc = np.repeat(np.arange(len(part)), np.diff(begin))
                start = np.arange(len(hashes)) - begin[doc]
                order = np.lexsort((hashes, doc))
                new = np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(hashes[order]) != 0)])
                n = np.bincount(doc[order], new, len(part)).astype(np.int32)
                code, token = codes[sh.slots(hashes, len(codes))], hashes >> _U(64 - sh.TOKEN_BITS)
                keep = np.flatnonzero((code > 0) | (sides[at + doc] == TRAIN | EVAL))  # a run counted once is of one text
                doc, start, code, token = doc[keep], start[keep], code[keep], token[keep]
                after, end = words.first[doc] + start + size, words.first[doc + 1]
                columns = [token, ids[at + doc], start.astype(np.int32), n[doc], code, sides[at + doc], _following(words, after, end), _following(words, after + 4, end)]
                cuts = np.ceil(sh.decoded(code) / hot).astype(np.int64)
                deal = np.where(cuts > 1, mix(columns[1].view(_U)) % cuts.astype(_U), _U(0))
                many = np.flatnonzero(cuts > 1)
                many = many[np.unique(token[many] << _U(2) | columns[5][many], return_index=True)[1]]
                many = [i for i in many if (token[i], columns[5][i]) not in told]
                if many:  # entries without a text tell each of the partitions which side has the run
                    told.update((token[i], columns[5][i]) for i in many)
                    i, k = np.repeat(many, cuts[many]), np.concatenate([np.arange(c) for c in cuts[many]])
                    zero = np.zeros(len(i), np.int64)
                    columns = [np.concatenate([c, v.astype(c.dtype)]) for c, v in zip(columns, (token[i], zero - 1, zero, zero, code[i], columns[5][i], zero, zero), strict=True)]
                    deal = np.concatenate([deal, k.astype(_U)])
                if len(deal):
                    yield _dealt((mix(columns[0] ^ mix(deal)) % _U(parts)).astype(np.int64), *columns)

    return run


def _leading(x: np.ndarray) -> np.ndarray:
    """Of four words in one number, how many at the front are zero."""
    return (x < _U(1 << 48)).astype(np.int8) + (x < _U(1 << 32)) + (x < _U(1 << 16)) + (x == 0)


def common_prefixes(token, one, two, side, size: int) -> np.ndarray:
    """Of sorted suffixes, the words of the longest prefix that each has in common with a suffix of the other side.

    The prefix that two neighbours have in common bounds the intervals of each depth; the deepest interval in which both
    sides stand gives the answer.  0 where not even the first run is on the other side.
    """
    near = np.concatenate([[True], token[1:] != token[:-1]])
    same = np.concatenate([[0], _leading(one[1:] ^ one[:-1])])
    lcp = np.where(near, 0, size + np.where(same == 4, 4 + np.concatenate([[0], _leading(two[1:] ^ two[:-1])]), same))
    words = [(x >> _U(16 * k)) & _U(0xFFFF) != 0 for x in (one, two) for k in range(4)]
    length = size + np.sum(words, 0)
    best, at = np.zeros(len(token), np.int32), np.arange(len(token))
    for depth in range(size, size + AHEAD + 1):
        long = length[at] >= depth
        at = at[long]
        if not len(at):
            break
        edge = np.flatnonzero(lcp[at] < depth)
        edge = np.union1d(edge, [0])  # what stood before may have ended
        both = np.bitwise_or.reduceat(side[at], edge) == TRAIN | EVAL
        at = at[np.repeat(both, np.diff(np.concatenate([edge, [len(at)]])))]
        best[at] = depth
    return best


def _shared_spans(size: int, parts: int):
    """One partition of the suffix array: sorted, and the spans in it that both sides have, on the way to their texts."""

    def run(batches):
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        if not blobs:
            return
        columns = sh.unpack_all(blobs, _U, np.int64, np.int32, np.int32, np.uint8, np.uint8, _U, _U)
        del blobs
        order = np.lexsort((columns[7], columns[6], columns[0]))
        token, ids, start, n, code, side, one, two = (c[order] for c in columns)
        length = common_prefixes(token, one, two, side, size)
        keep = np.flatnonzero((length > 0) & (ids >= 0))
        if len(keep):
            ids = ids[keep]
            yield _dealt((mix(ids.view(_U)) % _U(parts)).astype(np.int64), ids, start[keep], length[keep], token[keep], code[keep], n[keep], side[keep])

    return run


def _coverage(size: int, threshold: float, parts: int, hot: int):
    """The spans of each text merged (class, covered, spans, longest), and the intervals that its pairs are looked for in."""

    def run(batches):
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        if not blobs:
            return
        ids, start, length, token, code, n, side = sh.unpack_all(blobs, np.int64, np.int32, np.int32, _U, np.uint8, np.int32, np.uint8)
        del blobs
        order = np.lexsort((start, ids))
        ids, start, token, code, n, side = (x[order] for x in (ids, start, token, code, n, side))
        end = start + length[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        text = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(ids)]])))
        wide = int(end.max()) + 1
        seen = np.maximum.accumulate(end + text * wide) - text * wide  # furthest end so far within the text
        before = np.concatenate([[0], seen[:-1]])
        before[first] = -1
        fresh = np.flatnonzero(start > before)  # a stretch begins
        sizes = np.maximum.reduceat(seen, fresh) - start[fresh]
        covered, spans, longest = np.bincount(text[fresh], sizes, len(first)).astype(np.int32), np.bincount(text[fresh], minlength=len(first)), np.zeros(len(first), np.int64)
        np.maximum.at(longest, text[fresh], sizes)
        nulls = pa.nulls(len(first), pa.int32())
        yield pa.record_batch({"class": pa.array(ids[first]), "covered": pa.array(covered), "spans": pa.array(spans.astype(np.int32)), "longest": pa.array(longest.astype(np.int32)), "part": nulls, "blob": pa.nulls(len(first), pa.binary())})
        order = np.lexsort((token, code, text))
        order = order[np.concatenate([[True], (np.diff(text[order]) != 0) | (np.diff(token[order]) != 0)])]
        text, ids, token, code, n, side = (x[order] for x in (text, ids, token, code, n, side))
        shared = np.bincount(text, minlength=len(first))
        left = np.cumsum(shared)[text] - np.arange(len(text))  # shared runs of the text from this one on, rarest first
        keep = np.flatnonzero(left > np.ceil(threshold * n - 1e-9) - LEAST)  # none of a text that has too few shared runs
        keep = keep[shared[text[keep]] >= threshold * n[keep] - 1e-9]
        if len(keep):
            entry, token, side = hot_cells(token[keep], code[keep], ids[keep], side[keep], hot)
            rows = _dealt((mix(token) % _U(parts)).astype(np.int64), token, ids[keep][entry], n[keep][entry], left[keep][entry].astype(np.int32), side)
            none = pa.nulls(rows.num_rows, pa.int32())
            yield pa.record_batch({"class": none.cast(pa.int64()), "covered": none, "spans": none, "longest": none, "part": rows.column(0), "blob": rows.column(1)})

    return run


def _meet(threshold: float, parts: int):
    """Pairs of both sides that stand in one interval, as far as their sizes and the runs that are left allow it."""

    def run(batches):
        blobs = [x for batch in batches for x in batch.column(1).to_pylist()]
        if not blobs:
            return
        token, ids, n, left, side = sh.unpack_all(blobs, _U, np.int64, np.int32, np.int32, np.uint8)
        order = np.lexsort((n, token))
        token, ids, n, left, side = token[order], ids[order], n[order].astype(np.int64), left[order].astype(np.int64), side[order]
        interval = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]).astype(np.int64)]))
        held, of_train = np.flatnonzero(side & EVAL), np.flatnonzero(side & TRAIN)
        if not len(held) or not len(of_train):
            return
        wide = np.int64(n.max() / threshold + 2)
        places = interval[of_train] * wide + n[of_train]
        reach = np.floor((left[held] + LEAST - 1) * (1 + threshold) / threshold - n[held] + 1e-9)
        most = np.clip(np.minimum(reach, np.floor(n[held] / threshold + 1e-9)), 0, wide - 1).astype(np.int64)
        low = np.searchsorted(places, interval[held] * wide + np.ceil(n[held] * threshold - 1e-9).astype(np.int64))
        count = np.maximum(0, np.searchsorted(places, interval[held] * wide + most, side="right") - low)
        total = np.concatenate([[0], np.cumsum(count)])
        i = 0
        while i < len(held):
            j = max(i + 1, int(np.searchsorted(total, total[i] + 4_000_000, side="right")) - 1)
            e = np.repeat(held[i:j], count[i:j])
            t = of_train[np.repeat(low[i:j], count[i:j]) + np.arange(len(e)) - np.repeat(total[i:j] - total[i], count[i:j])]
            i = j
            need = sh.needed(n[e], n[t], threshold)
            ok = (need < left[e] + LEAST) & (need < left[t] + LEAST) & (ids[e] != ids[t])
            a, b, need = ids[e[ok]], ids[t[ok]], need[ok]
            if len(a):
                times = np.where(need < LEAST, LEAST, 1).astype(np.uint16)  # small sets may have to share fewer
                yield _dealt((mix(a.view(_U) ^ mix(b.view(_U) + _U(1))) % _U(parts)).astype(np.int64), a, b, times)

    return run


def overlaps(rows: DataFrame, id_column: str, field: Column, text: Column, is_train: Column, keep: tuple[str, ...] = (), whole: tuple[str, ...] = (), threshold: float = 0.8, size: int = 5) -> Overlaps:
    """Pairs of a held-out and a training text whose word runs have a Jaccard similarity of ``threshold`` or more.

    Texts of different ``field`` values are not compared as pairs, but have their spans looked up in one collection: do
    not mix fields of which one repeats the other.  Texts of the fields named in ``whole`` are compared as a whole only
    (the same words in the same order) and have no spans.  Null texts and texts without words are in no class; texts with
    fewer than ``size`` words can only be equal as a whole.  Repeated rows are members of one class.  ``keep`` names
    columns of ``rows`` that the members carry; a clash with the operator's own names is not possible for others.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = rows.select(F.col(id_column).alias("pair_id"), *keep, field.alias("field"), is_train.alias("is_train"), text.alias("text")).where("text is not null")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields)
    hashed = picked.mapInArrow(_sequence_hashes, f"{schema}, h1 bigint, h2 bigint, words int").where("words > 0")
    key = ["field", "h1", "h2"]
    side = F.max(F.col("is_train").cast("int")) * TRAIN + F.max((~F.col("is_train")).cast("int")) * EVAL
    classes = written(hashed.groupBy(*key).agg(F.min("text").alias("text"), side.alias("side"), F.first("words").alias("n"), F.count_if("is_train").alias("trains"), F.count_if(~F.col("is_train")).alias("evals")).withColumn("class", F.monotonically_increasing_id()), "classes")
    members = hashed.select("pair_id", *keep, "is_train", *key, "words").join(classes.select(*key, "class"), key).drop("h1", "h2")
    compared = classes.where(~F.col("field").isin(*whole) if whole else F.lit(True)).where(F.col("n") >= size).select("class", "text", "side")
    total = compared.agg(F.sum(F.length("text"))).first()[0] or 0
    slots, hot = sh.sketch_size(total), sh.hot_from(total, sh.HOT)
    counted = compared.select("class", "text").mapInArrow(_pass_one(size, size, slots), "id bigint, n int, h1 bigint, h2 bigint, block int, counts binary")
    codes = spark.sparkContext.broadcast(frequency_codes(counted, slots))
    parts = sh.partitions_for(total / 6, least, 500_000)
    entered = compared.mapInArrow(_suffixes(size, codes, parts, hot), "part int, blob binary")
    spans = entered.repartitionById(parts, "part").mapInArrow(_shared_spans(size, parts), "part int, blob binary")
    merged = written(spans.repartitionById(parts, "part").mapInArrow(_coverage(size, threshold, parts, hot), "class bigint, covered int, spans int, longest int, part int, blob binary"), "coverage")
    coverage = merged.where("class is not null").select("class", "covered", "spans", "longest")
    met = merged.where("part is not null").select("part", "blob").repartitionById(parts, "part").mapInArrow(_meet(threshold, parts), "part int, blob binary")
    close = written(added_up(met, parts, LEAST), "candidates")
    wanted = spark.sparkContext.broadcast(flags(F.col("id"), close.select(F.explode(F.array("a", "b")).alias("id"))))
    marked = compared.select("class", "text", F.pmod(F.xxhash64("class"), F.lit(1 << _FLAG_BITS)).alias("mark"))
    sets = marked.mapInArrow(_sets_of(size, size, wanted), "id bigint, shingles binary")
    similar = exact_pairs(close, sets, threshold).select(F.col("a").alias("eval_class"), F.col("b").alias("train_class"), "similarity")
    # a class with rows on both sides is an overlap with itself: all its words, in the same order
    itself = classes.where(F.col("side") == TRAIN + EVAL).where(F.col("field").isin(*whole) | (F.col("n") >= size) if whole else F.col("n") >= size)
    itself = itself.select(F.col("class").alias("eval_class"), F.col("class").alias("train_class"), F.lit(1.0).alias("similarity"))
    return Overlaps(members, similar.unionByName(itself), classes.select("class", "trains", "evals"), coverage)


def row_pairs(found: Overlaps) -> DataFrame:
    """Every pair of a held-out and a training row: eval_id, train_id, field, similarity."""
    left = found.members.where(~F.col("is_train")).select(F.col("class").alias("a"), F.col("pair_id").alias("a_id"), "field")
    right = found.members.where("is_train").select(F.col("class").alias("b"), F.col("pair_id").alias("b_id"))
    large = [found.classes.where(F.col(n) > SPAN).select("class", F.col(n).alias("n")) for n in ("evals", "trains")]
    both = pair_rows(found.pairs.withColumnsRenamed({"eval_class": "a", "train_class": "b"}), left, right, *large)
    return both.select(F.col("a_id").alias("eval_id"), F.col("b_id").alias("train_id"), "field", "similarity")
