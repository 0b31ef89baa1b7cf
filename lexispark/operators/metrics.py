"""Evaluation metrics over (label, score) rows, for any grouping, as aggregations."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Edges of ten equal bins, as floating point gives them.
BIN_EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def roc_auc(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Chance that a positive outscores a negative, ties one half; null where a group has one class only.

    Rows are first counted per distinct score.  How many negatives lie below a score is summed up in two steps: scores
    fall into ranges (which grow with the score's size), whose sums are added up first, so that no task orders all the
    distinct scores of a group.  Rows without a label or score are left out.
    """
    s = F.col("_s")
    counts = rows.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    counts = counts.select(*by, "_s", *[F.when(s.isNotNull(), F.col(n)).otherwise(0).alias(n) for n in ("_p", "_n")])  # a filter would work the scores out twice
    counts = counts.withColumn("_r", F.floor(F.signum(s) * F.log2(1 + F.abs(s)) * 1024).cast("bigint"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_below", F.coalesce(F.sum("_n").over(before(*by, "_r", "_s")), F.lit(0)))
    ranges = inside.groupBy(*by, "_r").agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_won"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    won = F.col("_won") + F.col("_p") * F.coalesce(F.sum("_n").over(before(*by, "_r")), F.lit(0))
    pairs = F.sum("_p") * F.sum("_n")
    return ranges.withColumn("_won", won).groupBy(*by).agg(F.when(pairs > 0, F.sum("_won") / pairs).alias("auc"))


def query_auc(rows: DataFrame, by: list[str], query: str, label: str = "label", score: str = "score") -> DataFrame:
    """Mean over queries of the AUC within each; queries of one class are left out."""
    return roc_auc(rows, [*by, query], label, score).groupBy(*by).agg(F.avg("auc").alias("query_auc"))


def binary_metrics(rows: DataFrame, by: list[str], threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    yes, true = F.col(score) >= threshold, F.col(label) == 1
    counted = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(yes & true).alias("tp"),
        F.count_if(yes & ~true).alias("fp"),
        F.count_if(~yes & ~true).alias("tn"),
        F.count_if(~yes & true).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counted.select(*by, "n", "tp", "fp", "tn", "fn", _ratio(tp + tn, F.col("n")).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def calibration_error(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Expected and largest gap between mean score and share of positives over ten bins, and the Brier score."""
    s = F.col(score)
    bin_of = F.lit(len(BIN_EDGES))
    for k in range(len(BIN_EDGES) - 1, -1, -1):
        bin_of = F.when(s < BIN_EDGES[k], k).otherwise(bin_of)
    y = F.col(label).cast("double")
    bins = rows.groupBy(*by, bin_of.alias("_bin")).agg(F.count("*").alias("_n"), F.sum(y).alias("_y"), F.sum(s).alias("_s"), F.sum((s - y) * (s - y)).alias("_b"))
    gap = F.abs(F.col("_y") - F.col("_s"))
    return bins.groupBy(*by).agg((F.sum(gap) / F.sum("_n")).alias("ece"), F.max(gap / F.col("_n")).alias("mce"), (F.sum("_b") / F.sum("_n")).alias("brier"))


def category_accuracy(rows: DataFrame, by: list[str], category: str, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    right = (F.col(score) >= threshold) == (F.col(label) == 1)
    return rows.groupBy(*by, F.col(category).alias("category")).agg(F.count_if(right).alias("correct"), F.count("*").alias("n"))


def traps_fooled(rows: DataFrame, by: list[str], category: str, threshold: float = 0.5, score: str = "score") -> DataFrame:
    """Of the cases whose category names a trap, how many score as relevant."""
    return rows.where(F.contains(F.col(category), F.lit("trap"))).groupBy(*by).agg(F.count_if(F.col(score) >= threshold).alias("fooled"), F.count("*").alias("traps"))


def log_loss(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    p = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), F.col(score)))
    y = F.col(label).cast("double")
    return rows.groupBy(*by).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def bootstrap_accuracy(rows: DataFrame, by: list[str], threshold: float = 0.5, resamples: int = 1000, seed: int = 0, alpha: float = 0.05, label: str = "label", score: str = "score") -> DataFrame:
    """Percentile interval of the accuracy over resamples with replacement.

    A resample of n rows has Binomial(n, accuracy) right ones, so each is one draw from the group's two counts: the rows
    are aggregated once, and the work doesn't grow with resamples times rows.
    """
    right = (F.col(score) >= threshold) == (F.col(label) == 1)
    counts = rows.groupBy(*by).agg(F.count_if(right).alias("_right"), F.count("*").alias("_n"))

    @F.pandas_udf("low double, high double")
    def interval(right_count: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for r, m in zip(right_count, n, strict=True):
            rng = random.Random(seed)
            values = sorted(rng.binomialvariate(int(m), r / m) / m for _ in range(resamples))
            last = len(values) - 1
            out.append((values[int(alpha / 2 * last)], values[-int(-(1 - alpha / 2) * last // 1)]))
        return pd.DataFrame(out, columns=["low", "high"])

    return counts.select(*by, (F.col("_right") / F.col("_n")).alias("accuracy"), interval("_right", "_n").alias("_i")).select(*by, "accuracy", "_i.low", "_i.high")


def bootstrap_auc(rows: DataFrame, by: list[str], resamples: int = 1000, seed: int = 0, alpha: float = 0.05, places: int = 4, label: str = "label", score: str = "score") -> DataFrame:
    """AUC of each group and its percentile interval over resamples with replacement: by, auc, low, high.

    A resample of n rows is a multinomial draw over the group's counts of (score, label), so rows are aggregated once and
    never drawn one by one.  Scores are rounded to ``places``, which bounds what a group's task holds (20,002 counts for
    scores from 0 to 1).  Resamples of one class are left out; a group that has no other gives nulls.
    """
    counts = rows.groupBy(*by, F.round(score, places).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    kinds = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in by)

    def intervals(group: pd.DataFrame) -> pd.DataFrame:
        keys, group = [group[k].iloc[0] for k in by], group.dropna(subset=["_s"]).sort_values("_s")
        cells = np.concatenate([group["_p"].to_numpy(), group["_n"].to_numpy()])
        half, rng, values = len(group), np.random.default_rng(seed), []

        def auc(drawn):
            p, n = drawn[:half], drawn[half:]
            return (p * (np.cumsum(n) - n / 2)).sum() / (p.sum() * n.sum()) if p.any() and n.any() else None

        for _ in range(resamples if cells.any() else 0):
            values.append(auc(rng.multinomial(cells.sum(), cells / cells.sum())))
        values = sorted(v for v in values if v is not None)
        last = len(values) - 1
        ends = (values[math.floor(alpha / 2 * last)], values[math.ceil((1 - alpha / 2) * last)]) if values else (None, None)
        return pd.DataFrame([(*keys, auc(cells), *ends)], columns=[*by, "auc", "low", "high"])

    return counts.groupBy(*by).applyInPandas(intervals, f"{kinds}, auc double, low double, high double")


def report(scored: DataFrame, by: list[str], query: str, threshold: float | None = 0.5, resamples: int = 0) -> DataFrame:
    """All metrics of each group (say, suite and scorer) in one row.

    Without a ``threshold`` only those of the ranking (for scores that aren't probabilities); with ``resamples`` the
    intervals of the AUC and, with a threshold, of the accuracy as well.
    """
    parts = [scored.groupBy(*by).agg(F.count("*").alias("n")), roc_auc(scored, by), query_auc(scored, by, query)]
    if threshold is not None:
        parts[0] = binary_metrics(scored, by, threshold)
        parts.append(calibration_error(scored, by))
    if resamples:
        parts.append(bootstrap_auc(scored, by, resamples).withColumnsRenamed({"low": "auc_low", "high": "auc_high"}).drop("auc"))
        if threshold is not None:
            parts.append(bootstrap_accuracy(scored, by, threshold, resamples).withColumnsRenamed({"low": "accuracy_low", "high": "accuracy_high"}).drop("accuracy"))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, by, "left")
    return out
