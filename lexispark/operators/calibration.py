"""Turning scores into probabilities: logistic scaling and temperature, fitted by a few aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sigmoid


def grouped_scores(rows: DataFrame, label: str = "label", score: str = "score", places: int | None = None) -> DataFrame:
    """Rows counted by (score, label): what the fits read, so that their passes are short on repeated scores."""
    s = F.col(score).cast("double")
    return rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy((F.round(s, places) if places is not None else s).alias("s"), F.col(label).cast("double").alias("y")).agg(F.count("*").alias("n"))


def fit_platt(rows: DataFrame, label: str = "label", score: str = "score", l2: float = 1.0, iterations: int = 100) -> tuple[float, float]:
    """(a, b) of sigmoid(a * score + b): logistic regression on standardised scores, Newton steps, slope penalised.

    Each step is one aggregation of five sums; the 2 x 2 system is solved on the driver.
    """
    counted = grouped_scores(rows, label, score).persist()
    try:
        m = counted.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("s")).alias("s"), F.min("y").alias("low"), F.max("y").alias("high")).first()
        if not m.n or m.low == m.high:
            raise ValueError("both classes are needed")
        mean = m.s / m.n
        spread = counted.agg(F.sum(F.col("n") * (F.col("s") - mean) * (F.col("s") - mean)).alias("v")).first().v
        sd = math.sqrt(spread / m.n) or 1.0
        w0 = w1 = 0.0
        x = (F.col("s") - mean) / sd
        for _ in range(iterations):
            p = sigmoid(x * w0 + w1)
            e, h = F.col("n") * (p - F.col("y")), F.col("n") * p * (1.0 - p)
            g = counted.agg(F.sum(e * x).alias("g0"), F.sum(e).alias("g1"), F.sum(h * x * x).alias("h00"), F.sum(h * x).alias("h01"), F.sum(h).alias("h11")).first()
            g0, h00 = g.g0 + l2 * w0, g.h00 + l2
            det = h00 * g.h11 - g.h01 * g.h01
            d0, d1 = (g0 * g.h11 - g.g1 * g.h01) / det, (g.g1 * h00 - g0 * g.h01) / det
            w0, w1 = w0 - d0, w1 - d1
            if max(abs(d0), abs(d1)) < 1e-10:
                break
        return w0 / sd, w1 - w0 * mean / sd
    finally:
        counted.unpersist()


def apply_platt(score: Column, a: float, b: float) -> Column:
    return sigmoid(score * a + b)


def fit_temperature(rows: DataFrame, label: str = "label", logit: str = "logit", bounds: tuple[float, float] = (0.05, 20.0), steps: int = 100, points: int = 16) -> float:
    """Temperature with the least mean loss of sigmoid(logit / T); 1 without rows.

    The loss has one minimum in log T: each pass evaluates a grid of points inside the bracket in one aggregation, and
    goes on between the best one's neighbours.
    """
    counted = grouped_scores(rows, label, logit).persist()
    try:
        if counted.isEmpty():
            return 1.0
        low, high = math.log(bounds[0]), math.log(bounds[1])
        for _ in range(steps):
            grid = [low + (high - low) * k / (points - 1) for k in range(points)]
            z = [F.col("s") / math.exp(t) for t in grid]
            loss = [F.sum(F.col("n") * (F.greatest(v, F.lit(0.0)) - v * F.col("y") + F.log1p(F.exp(-F.abs(v))))).alias(f"l{k}") for k, v in enumerate(z)]
            values = list(counted.agg(*loss).first())
            best = values.index(min(values))
            low, high = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
            if high - low < 1e-6:
                break
        return math.exp((low + high) / 2)
    finally:
        counted.unpersist()


def apply_temperature(logit: Column, temperature: float) -> Column:
    return sigmoid(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit / max(1e-4, temperature))))


def blended_target(label: Column, teacher: Column, weight: float = 0.5) -> Column:
    """Training target: label and teacher's probability blended, the label alone where there is no teacher."""
    return F.when(teacher.isNotNull(), (1.0 - weight) * label + weight * teacher).otherwise(label.cast("double"))
