"""The best k documents of each query by BM25, exactly, without a row for each query and document that share a term."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import small, written

K1, B = 1.2, 0.75
#: Scores are rounded to nine places: bounds are compared with more room than that.
_MARGIN = 1e-6
#: Rows of lists that a cell holds, terms that are sent to every task.
_WAITING, _KNOWN = 200_000, 1_000_000


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def postings_of(docs: DataFrame, wanted: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Postings (pid, length, term, tf) of the wanted terms, and n and mean_length of the documents, both for each ``by``.

    Texts are taken apart once: every document has one row more, of the empty term, which is no document's; the size of
    the corpus is read off these rows.  What is not wanted is left out before anything is shuffled.
    """
    rows = docs.select("pid", *by, F.size("terms").alias("length"), F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
    none = wanted.sparkSession.createDataFrame([("",)], "term string")
    if by:
        none = none.crossJoin(wanted.select(*by).distinct())
    held = rows.join(small(wanted.select(*by, "term").unionByName(none).distinct()), [*by, "term"], "left_semi")
    postings = written(held.groupBy("pid", *by, "length", "term").agg(F.count("*").alias("tf")), "postings")
    size = postings.where("term = ''").groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean_length"))
    return postings.where("term != ''"), size


class Best(NamedTuple):
    """``sets``: key and known, the hash of the terms of the set that some record has; ``lists``: known and best, an array of
    less (score below zero), pid and mark."""

    sets: DataFrame
    lists: DataFrame


def _weighed(known: Broadcast | None, mean: dict, k1: float, b: float):
    """For each record its different terms that are asked for, each with its BM25 weight (without idf)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            length = lists.value_lengths().to_numpy()
            doc, term = np.repeat(np.arange(len(length)), length), lists.flatten().to_numpy()
            if known is not None:
                wanted = known.value
                keep = wanted[np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)] == term if len(wanted) else np.zeros(len(term), bool)
                doc, term = doc[keep], term[keep]
            order = np.lexsort((term, doc))
            doc, term = doc[order], term[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])) if len(doc) else np.zeros(0, np.int64)
            tf = np.diff(first, append=len(doc)).astype(np.float64)
            doc, term = doc[first], term[first]
            means = np.array([max(mean[x], 1e-9) for x in batch.column(1).to_pylist()])
            norm = k1 * (1.0 - b + b * length / means)
            weight = tf * (k1 + 1.0) / (tf + norm[doc])
            ends = pa.array(np.searchsorted(doc, np.arange(len(length) + 1)), pa.int32())
            columns = [*(batch.column(i) for i in range(3)), pa.ListArray.from_arrays(ends, pa.array(term, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["pid", "split", "mark", "terms", "weights"])

    return run


class _Sums:
    """Sums of all records of a block over the common terms of one set after another, and the ``k`` best by them.

    Sets come in the order of their terms, most frequent first.  What the next set has not in common with the last is
    taken back, what it has besides is added: a step touches only the records of its term.  Of the other records only
    those that were among the best before can be among the best after it.
    """

    def __init__(self, records: int, k: int, edge: np.ndarray, place: np.ndarray, weight: np.ndarray):
        self.score, self.k, self.edge, self.place, self.weight = np.zeros(records), k, edge, place, weight
        self.path: list[tuple[int, np.ndarray]] = []
        self.best = [(np.zeros(0, place.dtype), np.zeros(0))]

    def turn_to(self, terms: list[int], idfs: list[float]) -> None:
        same = 0
        while same < min(len(terms), len(self.path)) and self.path[same][0] == terms[same]:
            same += 1
        while len(self.path) > same:
            term, held = self.path.pop()
            self.score[self.place[self.edge[term] : self.edge[term + 1]]] = held
            self.best.pop()
        for term, idf in zip(terms[same:], idfs[same:], strict=True):
            self._add(term, idf)

    def _add(self, term: int, idf: float) -> None:
        lo, hi = self.edge[term], self.edge[term + 1]
        on, (old, old_got) = self.place[lo:hi], self.best[-1]
        held = self.score[on]
        got = held + idf * self.weight[lo:hi]
        self.score[on] = got
        self.path.append((term, held))
        least = old_got[-1] if len(old) == self.k else 0.0
        if least > _MARGIN:
            some = np.flatnonzero(got >= least - _MARGIN)
            on, got = on[some], got[some]
        if len(got) > 64 * self.k:
            some = np.flatnonzero(got >= np.partition(got, -self.k)[-self.k] - _MARGIN)
            on, got = on[some], got[some]
        as_before = self.score[old] == old_got  # those that have the term are among the new ones
        on, got = np.concatenate([old[as_before], on]), np.concatenate([old_got[as_before], got])
        first = np.lexsort((on, -np.round(got, 9)))[: self.k]
        self.best.append((on[first], got[first]))


def _spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each of ``begin``, as many as ``many`` says, one after the other."""
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())


def _best_of_block(k: int, entries: int):
    """One cell: the ``k`` best of a block's records (kind 0) for each set of terms of a group (kind 1), by whole BM25 sums.

    Sets with the same common terms (``part``) are taken together: these are added up once for all records (see ``_Sums``).
    A record without a rare term of a set keeps that sum, so only the ``k`` best by it can be among the set's best; the
    records with a rare term are looked up in it, those left out that can't reach its ``k``-th.
    """

    def run(batches):
        docs, sets = [], []
        for batch in batches:
            kind = batch.column(0).to_numpy()
            for rows, to, columns in ((kind == 0, docs, (2, 3, 6, 7)), (kind == 1, sets, (1, 4, 5, 6, 7))):
                if rows.any():
                    part = batch.filter(pa.array(rows))
                    to.append([part.column(c) for c in columns])
        if not docs or not sets:
            return
        names, marks = (pa.chunked_array([d[i] for d in docs]).combine_chunks() for i in (0, 1))
        keys, parts, shared, size = (np.concatenate([x[i].to_numpy() if i < 3 else x[3].value_lengths().to_numpy() for x in sets]) for i in range(4))
        asked, idfs = (np.concatenate([x[i].flatten().to_numpy() for x in sets]) for i in (3, 4))
        del sets
        held, asked = np.unique(asked, return_inverse=True)
        by_name = pc.sort_indices(names).to_numpy()  # equal scores are ordered by place
        rank = np.empty(len(names), np.int32)
        rank[by_name] = np.arange(len(names), dtype=np.int32)
        which, place, weight, at = [], [], [], 0
        for _, _, terms, weights in docs:
            term = terms.flatten().to_numpy()
            to = np.minimum(np.searchsorted(held, term), len(held) - 1).astype(np.int32)
            keep = held[to] == term
            which.append(to[keep])
            place.append(np.repeat(rank[at : at + len(terms)], terms.value_lengths().to_numpy())[keep])
            weight.append(weights.flatten().to_numpy()[keep])
            at += len(terms)
        del docs
        which, place, weight = (np.concatenate(x) for x in (which, place, weight))
        order = np.lexsort((place, which))
        edge = np.searchsorted(which[order], np.arange(len(held) + 1))
        place, weight = place[order], weight[order]
        del which, order
        most = np.zeros(len(held))
        some = np.flatnonzero(np.diff(edge))
        if not len(some):
            return
        most[some] = np.maximum.reduceat(weight, edge[some])
        begin = np.cumsum(size) - size
        before = np.append(0, np.cumsum(np.diff(edge)[asked]))
        _, one, part = np.unique(parts, return_index=True, return_inverse=True)
        paths = np.full((len(one), shared[one].max(initial=0)), -1, np.int32)  # most frequent first, so that sets share their beginnings
        for i in range(paths.shape[1]):
            some = np.flatnonzero(shared[one] > i)
            paths[some, i] = asked[begin[one[some]] + size[one[some]] - 1 - i]
        at_part = np.empty(len(one), np.int64)
        at_part[np.lexsort((one, *paths.T[::-1]))] = np.arange(len(one))
        by_part = np.argsort(at_part[part], kind="stable")
        del paths, at_part
        sums = _Sums(len(names), k, edge, place, weight)
        taken = names.take(pa.array(by_name)), marks.take(pa.array(by_name))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def lists():
            q, on, got = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            on = pa.array(on)
            best = pa.StructArray.from_arrays([pa.array(-got), taken[0].take(on), taken[1].take(on)], ["less", "pid", "mark"])
            return pa.record_batch({"known": pa.array(keys[q[first]]), "best": pa.ListArray.from_arrays(pa.array(np.append(first, len(q)), pa.int32()), best)})

        waiting = 0
        ends = begin + size - shared
        to = np.append(0, np.cumsum((before[ends] - before[begin])[by_part]))
        a = 0
        while a < len(by_part):
            b = max(a + 1, min(int(np.searchsorted(to, to[a] + entries, side="right")) - 1, a + _WAITING // k))
            some, a = by_part[a:b], b
            rare = ends[some] - begin[some]
            x, own = _spread(begin[some], rare), np.repeat(np.arange(len(some)), rare)
            many = edge[asked[x] + 1] - edge[asked[x]]
            at = _spread(edge[asked[x]], many)
            on = place[at]
            got = np.repeat(idfs[x], many) * weight[at]
            del at
            cut = np.flatnonzero(np.concatenate([[True], np.diff(part[some]) != 0, [True]]))
            upto = np.append(0, np.cumsum(np.bincount(own, many, len(some)).astype(np.int64)))[cut].tolist()
            base, usual = [], np.empty(len(on))
            for s, lo, hi in zip(some[cut[:-1]].tolist(), upto[:-1], upto[1:], strict=True):
                its = slice(ends[s], begin[s] + size[s])
                sums.turn_to(asked[its][::-1].tolist(), idfs[its][::-1].tolist())
                usual[lo:hi] = sums.score[on[lo:hi]]
                base.append(sums.best[-1])
            lengths = np.array([len(q) for q, _ in base])
            least = np.array([v[-1] if len(v) == k else 0.0 for _, v in base])
            group = np.repeat(np.arange(len(base)), np.diff(cut))
            least = least[group] - _MARGIN
            bound = idfs[x] * most[asked[x]]
            room = least[own] - (np.bincount(own, bound, len(some))[own] - bound)  # what this term must bring the record to
            keep = usual + got >= np.repeat(room, many)
            code = np.repeat(own * len(names), many)[keep] + on[keep]
            got, usual = got[keep], usual[keep]
            order = np.argsort(code, kind="stable")
            code, got, usual = code[order], got[order], usual[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            code, got = code[first], (np.add.reduceat(got, first) if len(first) else got) + usual[first]
            keep = got >= least[code // len(names)]
            code, got = code[keep], got[keep]
            lists_of = lengths[group]
            from_base = _spread((np.cumsum(lengths) - lengths)[group], lists_of)
            rest = np.repeat(np.arange(len(some)) * len(names), lists_of) + np.concatenate([q for q, _ in base])[from_base]
            other = code[np.minimum(np.searchsorted(code, rest), len(code) - 1)] != rest if len(code) else np.ones(len(rest), bool)
            code, got = np.concatenate([code, rest[other]]), np.round(np.concatenate([got, np.concatenate([v for _, v in base])[from_base][other]]), 9)
            q, on = code // len(names), code % len(names)
            order = np.lexsort((on, -got, q))
            q, on, got = q[order], on[order], got[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            if keep.any():
                found.append((some[q[keep]], on[keep], got[keep]))
                waiting += len(found[-1][0])
            if waiting > _WAITING:
                yield lists()
                waiting = 0
        if found:
            yield lists()

    return run


def best_records(sets: DataFrame, docs: DataFrame, k: int, common: int = 200, champions: int = 50, block: int = 196_608, group: int = 200_000, k1: float = K1, b: float = B) -> tuple[Best, DataFrame]:
    """The ``k`` best records of the split by BM25 for each set of terms (see ``Best``), and split, term, df, idf of the
    terms asked for.  Equal scores are ordered by pid.

    ``sets`` has key, split and terms (different ones), ``docs`` pid, split, terms and, if wanted, mark, a number that is
    handed on.  Every posting counts.  Sets that differ only by terms that no record has are one.  Blocks of records meet
    groups of sets in a grid of cells; the best of each block are merged.  A term is a common one in more than ``common``
    records or one of 256, if these are more; ``common`` and ``champions`` (thousands of entries that a cell looks up at
    once) steer only how the work is done, never which are the best.
    """
    spark = docs.sparkSession
    kind = docs.schema["pid"].dataType.simpleString()
    hashed = F.transform("terms", lambda x: F.xxhash64(x))
    mark = F.col("mark") if "mark" in docs.columns else F.lit(0).cast("bigint").alias("mark")
    held = written(docs.select("pid", "split", mark, hashed.alias("terms")), "terms")
    size = held.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean_length"))
    sizes = {r.split: r for r in size.collect()}
    frequency = held.select("split", F.explode(F.array_distinct("terms")).alias("t")).groupBy("split", "t").agg(F.count("*").alias("df"))
    spread = sets.select("key", "split", F.explode("terms").alias("term")).withColumn("t", F.xxhash64("term"))
    totals = F.broadcast(spark.createDataFrame([(r.split, r.n) for r in sizes.values()], "split string, n bigint"))
    weights = written(spread.select("split", "term", "t").distinct().join(frequency, ["split", "t"]).join(totals, "split").select("split", "term", "t", "df", "n", idf(F.col("n"), F.col("df")).alias("idf")), "weights")
    few = weights.count() <= _KNOWN
    known = spark.sparkContext.broadcast(np.unique(np.array([r.t for r in weights.select("t").distinct().toLocalIterator()], np.int64))) if few else None
    facts = weights.select("split", "t", "df", "idf", (F.col("df") > F.greatest(F.lit(common), F.col("n") / 256)).alias("common"))
    rarest = F.array_sort(F.collect_list(F.struct("df", "t", "idf", "common")))
    ordered = spread.join(F.broadcast(facts) if few else facts, ["split", "t"]).groupBy("key", "split").agg(rarest.alias("x"))
    usual = F.filter("x", lambda y: y["common"])
    ordered = written(ordered.withColumns({"known": F.xxhash64("split", "x.t"), "part": F.xxhash64("split", F.transform(usual, lambda y: y["t"])), "shared": F.size(usual)}), "asked")
    different = written(ordered.groupBy("known").agg(F.first(F.struct("split", "part", "shared", "x")).alias("y")).select("known", "y.*"), "different")
    asked = {r.split: r.n for r in different.groupBy("split").agg(F.count("*").alias("n")).collect()}
    cells, plan = 0, []
    for name in sorted(x for x in asked if x in sizes):
        blocks = -(-sizes[name].n // block)
        groups = max(-(-asked[name] // group), -(-spark.sparkContext.defaultParallelism // blocks))
        plan.append((name, cells, blocks, groups))
        cells += blocks * groups
    grid = F.broadcast(spark.createDataFrame(plan, "split string, base int, blocks int, groups int"))
    weighed = held.mapInArrow(_weighed(known, {x: r.mean_length or 0.0 for x, r in sizes.items()}, k1, b), f"pid {kind}, split string, mark bigint, terms array<bigint>, weights array<double>")
    mine = F.col("base") + F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int") * F.col("groups")
    none = F.lit(None).cast("bigint")
    left = weighed.where(F.size("terms") > 0).join(grid, "split").select(F.explode(F.sequence(mine, mine + F.col("groups") - 1)).alias("cell"), F.lit(0).alias("kind"), none.alias("known"), F.col("pid").alias("name"), "mark", none.alias("part"), F.lit(0).alias("shared"), "terms", "weights")
    to = F.when(F.col("shared") > 0, F.col("part")).otherwise(F.col("known"))  # the sets without a common term are no group of their own
    mine = F.col("base") + F.pmod(F.xxhash64(to), F.col("groups")).cast("int")
    right = different.join(grid, "split").select(F.explode(F.sequence(mine, mine + (F.col("blocks") - 1) * F.col("groups"), F.col("groups"))).alias("cell"), F.lit(1).alias("kind"), "known", F.lit(None).cast(kind).alias("name"), none.alias("mark"), "part", "shared", F.col("x.t").alias("terms"), F.col("x.idf").alias("weights"))
    dealt = left.unionByName(right).repartitionById(max(1, cells), "cell").select("kind", "known", "name", "mark", "part", "shared", "terms", "weights")
    best = dealt.mapInArrow(_best_of_block(k, champions * 10_000), f"known bigint, best array<struct<less: double, pid: {kind}, mark: bigint>>")
    merged = best.groupBy("known").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return Best(ordered.select("key", "known"), merged), weights
