"""Evaluation of several scorers over labelled suites, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lexical import Bm25, coverage, term_stats
from ..operators.metrics import report
from ..operators.scoring import decide, keyword_score, overlap_share
from ..storage import written


def scored_cases(cases: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per case and scorer: constant, keyword rule, overlap, coverage, BM25, and the cascade of the first two.

    ``cases`` has id, suite, category, query, doc and label.  Coverage weighs terms by all docs of the suite table,
    repeated ones too; BM25 runs over the distinct docs, and a case scores what its doc scores, 0 if not found.
    """
    base = coverage(cases, "query", "doc", term_stats(cases, "doc")).select("id", "suite", "category", "query", "doc", "label", "coverage")
    docs = cases.groupBy("doc").agg(F.min("id").alias("pid")).where("doc is not null")
    asked = cases.groupBy("query").agg(F.min("id").alias("qid"))
    found = Bm25(docs, "pid", "doc").scores(asked, "qid", "query")
    base = base.join(docs, "doc", "left").join(asked, "query", "left").join(found, ["qid", "pid"], "left")
    base = base.withColumn("keyword", keyword_score(F.col("query"), F.col("doc"))).withColumn("overlap", overlap_share(F.col("query"), F.col("doc")))
    base = decide(base, "keyword", "overlap")
    flat = {f"cascade_flat_{int(100 * t)}": F.when(F.col("overlap") > 0, t).otherwise(0.0) for t in (0.5, 0.72)}  # tier 1 always the same
    scorers = {"always": F.lit(1.0), "keyword": F.col("keyword"), "overlap": F.col("overlap"), "coverage": F.col("coverage"), "bm25": F.coalesce("bm25", F.lit(0.0)), "cascade": F.when(F.col("kept"), F.col("final_score")).otherwise(0.0), **flat, **(extra or {})}
    spread = F.explode(F.array(*[F.struct(F.lit(n).alias("scorer"), c.cast("double").alias("score")) for n, c in scorers.items()])).alias("x")
    return base.select("id", "suite", "category", "query", "label", spread).select("id", "suite", "category", "query", "label", "x.scorer", "x.score")


def suite_report(cases: DataFrame, threshold: float = 0.5) -> DataFrame:
    return report(written(scored_cases(cases), "scored"), ["suite", "scorer"], "query", threshold)


def as_markdown(rows: DataFrame, columns: list[str], most: int = 10_000) -> str:
    """The report as a table in Markdown (one row for each suite and scorer); more rows than ``most`` are refused."""
    found = rows.select(*columns).orderBy(*columns[:2]).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for a table in Markdown")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in found:
        lines.append("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines)
