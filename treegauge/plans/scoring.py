"""Findings to scores, grades and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.functions import rules as R
from treegauge.functions import text as T


def category_scores(findings: DataFrame) -> DataFrame:
    """(repo_id, category, penalty, score) for findings (repo_id, id, category, severity, penalty).

    100 less the penalties, at most 55 with one critical finding, 35 with more, 12 without a README.
    """
    g = findings.groupBy("repo_id", "category").agg(F.sum("penalty").alias("points"), F.sum(F.when(F.col("severity") == "critical", 1).otherwise(0)).alias("critical"), F.bool_or(F.col("id") == "documentation.readme").alias("bare"))
    score = 100 - F.least(F.lit(100), F.col("points"))
    score = F.when(F.col("critical") >= 2, F.least(score, F.lit(35))).when(F.col("critical") == 1, F.least(score, F.lit(55))).otherwise(score)
    score = F.when(F.col("bare"), F.least(score, F.lit(12))).otherwise(score)
    return g.select("repo_id", "category", F.col("points").cast("long").alias("penalty"), score.cast("long").alias("score"))


def test_curve(test_loc: str = "test_loc", source_loc: str = "source_loc") -> Column:
    """Points that testing loses by its share of test lines: none from six tenths of the source lines on."""
    ratio = F.try_divide(F.col(test_loc), F.col(source_loc))
    return F.when(F.col(source_loc) == 0, 0).otherwise(F.greatest(F.lit(0), 100 - F.least(F.lit(100), F.floor(ratio / 0.6 * 100 + 0.5))))


def testing_score(test_loc: str = "test_loc", source_loc: str = "source_loc") -> Column:
    """The testing category's score before other penalties."""
    return F.greatest(F.lit(5), F.least(F.lit(100), 100 - test_curve(test_loc, source_loc))).cast("long")


def overall(scores: DataFrame) -> DataFrame:
    """(repo_id, overall, grade); a category without findings scores 100."""
    held = scores.groupBy("repo_id").pivot("category", list(R.WEIGHTS)).agg(F.first("score"))
    total = sum((F.coalesce(F.col(c), F.lit(100)) * w for c, w in R.WEIGHTS.items()), F.lit(0.0))
    return held.select("repo_id", F.floor(F.round(total, 6) + 0.5).cast("long").alias("overall")).withColumn("grade", T.grade(F.col("overall")))


def compare(scores: DataFrame, a: object, b: object) -> DataFrame:
    """(category, score_a, score_b, diff, winner) of two repositories."""
    l = scores.where(F.col("repo_id") == a).select("category", F.col("score").alias("score_a"))
    r = scores.where(F.col("repo_id") == b).select("category", F.col("score").alias("score_b"))
    out = l.join(r, "category").withColumn("diff", F.col("score_a") - F.col("score_b"))
    return out.withColumn("winner", F.when(F.col("diff") > 0, "a").when(F.col("diff") < 0, "b").otherwise("tie"))
