"""Mixing sources to target weights: budgets handed down a tree, then seeded epochs up to each budget.

The tree is domain, language, source: a source is a leaf in each language that it has documents of, and its weight is
shared among these leaves as its tokens are.  Each node hands its tokens to its children by weight; what a child can't
use (its documents times the permitted repeats) goes to its siblings first, and to the node's own siblings only when all
of the node is used up.  A leaf then takes whole epochs of its documents and of one more epoch, in an order that the seed
gives, the documents up to the rest of its budget.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import limited

#: Rows of a table of targets; budgets are worked out on the driver.
MOST_SOURCES = 100_000


def source_key(value: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " "))), F.lit(""))


@dataclass
class Node:
    name: str
    weight: float = 0.0
    room: int = 0
    children: dict[str, Node] = field(default_factory=dict)
    budget: int = 0

    def add(self, path: tuple[str, ...], weight: float, room: int) -> None:
        self.weight += weight
        self.room += room
        if path:
            self.children.setdefault(path[0], Node(path[0])).add(path[1:], weight, room)

    def hand_down(self, amount: int) -> None:
        self.budget = amount = min(amount, self.room)
        open_ones, given = list(self.children.values()), {}
        while open_ones and amount > 0:
            total = sum(c.weight for c in open_ones)
            part = {c.name: amount * c.weight / total if total else amount / len(open_ones) for c in open_ones}
            full = [c for c in open_ones if part[c.name] >= c.room]
            if not full:
                given.update({n: int(x) for n, x in part.items()})
                break
            for c in full:
                given[c.name] = c.room
                amount -= c.room
            open_ones = [c for c in open_ones if c not in full]
        for c in self.children.values():
            c.hand_down(given.get(c.name, 0))

    def leaves(self, path: tuple[str, ...] = ()):
        if not self.children:
            yield path, self.budget
        for c in self.children.values():
            yield from c.leaves((*path, c.name))


@dataclass
class Mixture:
    """``documents``: id, source, lang, tokens, copies (0 never comes out); ``shares``: one row per target, with what it
    got; ``leaves``: one row per domain, language and source, with its budget and what it got."""

    documents: DataFrame
    shares: DataFrame
    leaves: DataFrame


def mix(documents: DataFrame, targets: DataFrame, domains: DataFrame | None = None, total: int | None = None, seed: int = 0, bucket_rows: int = 10_000) -> Mixture:
    """Choose documents (id, source, lang, tokens) so that sources get their target_share of ``total`` tokens.

    ``targets`` has source, target_share and max_repeats, ``domains`` source and domain; sources are compared without
    letter case and outer blanks, languages too.  A source without a domain is of the domain that its name's first word
    gives.  ``total`` is by default the number of tokens that the targeted sources have.  Documents without source, target
    or tokens never come out; a null language is ``und``, a null share 0, null repeats are 1; a target without documents
    comes out in ``shares`` with 0.  A leaf meets its budget up to half a document.
    """
    spark = documents.sparkSession
    key = source_key(F.col("source"))
    wanted = targets.groupBy(key.alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")).where("source is not null")
    settings = sorted(limited(wanted, MOST_SOURCES, "sources with a target"))
    known = {} if domains is None else {r.source: r.domain for r in limited(domains.groupBy(key.alias("source")).agg(F.min("domain").alias("domain")), MOST_SOURCES, "sources with a domain")}
    names = spark.createDataFrame([(r.source,) for r in settings], "source string")
    rows = documents.select("id", key.alias("source"), F.coalesce(source_key(F.col("lang")), F.lit("und")).alias("lang"), "tokens").where("tokens > 0").join(F.broadcast(names), "source")
    held: dict[str, list] = {}
    for r in limited(rows.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).orderBy("source", "lang"), 10 * MOST_SOURCES, "languages of sources"):
        held.setdefault(r.source, []).append(r)
    if total is None:
        total = sum(r.tokens for leaves in held.values() for r in leaves)
    root = Node("")
    for r in settings:
        leaves = held.get(r.source, [])
        domain, have = known.get(r.source) or re.split(r"[\W_]", r.source)[0], sum(x.tokens for x in leaves)
        for x in leaves:
            root.add((domain, x.lang, r.source), r.target_share * x.tokens / have, x.tokens * max(0, r.max_repeats))
    root.hand_down(total)
    sizes, plan = {(x.source, x.lang): x for leaves in held.values() for x in leaves}, []
    for path, budget in root.leaves():
        if path:
            have = sizes[path[2], path[1]]
            plan.append((*path, have.tokens, budget, *divmod(budget, have.tokens), max(1, -(-have.n // bucket_rows))))
    planned = spark.createDataFrame(plan, "domain string, lang string, source string, available bigint, budget bigint, epochs bigint, rest bigint, buckets bigint")
    leaf = ["source", "lang"]
    placed = rows.join(F.broadcast(planned.select(*leaf, "epochs", "rest", "buckets")), leaf)
    # the order of the last epoch: buckets are summed first, so that no leaf is ordered in one task
    placed = placed.withColumn("order", F.xxhash64("id", F.lit(seed), "epochs")).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.col("buckets")))
    sums = placed.groupBy(*leaf, "bucket").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*leaf, "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*leaf, "bucket").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.sum("tokens").over(inside)).join(offsets, [*leaf, "bucket"])
    chosen = F.col("offset") + F.col("upto") - F.col("tokens") / 2 < F.col("rest")
    documents = placed.select("id", *leaf, "tokens", (F.col("epochs") + chosen.cast("bigint")).alias("copies")).where("copies > 0")
    got = documents.groupBy(*leaf).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    zero = lambda *names: [F.coalesce(n, F.lit(0)).alias(n) for n in names]
    leaves = planned.select("domain", "lang", "source", "available", "budget").join(got, leaf, "left").select("domain", *leaf, "available", "budget", *zero("tokens", "documents", "most_copies"))
    by_source = leaves.groupBy("source").agg(F.count("*").alias("languages"), *[F.sum(n).alias(n) for n in ("available", "budget", "tokens", "documents")], F.max("most_copies").alias("most_copies"))
    asked = spark.createDataFrame([(r.source, float(r.target_share), int(r.max_repeats)) for r in settings], "source string, target_share double, max_repeats int")
    shares = asked.join(by_source, "source", "left").crossJoin(F.broadcast(by_source.agg(F.sum("tokens").alias("all"))))
    filled = zero("languages", "available", "budget", "tokens", "documents", "most_copies")
    shares = shares.select("source", "target_share", "max_repeats", *filled, F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("reached_share"))
    return Mixture(documents, shares, leaves)
