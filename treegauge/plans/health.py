"""The health report: files to findings to scores to one graded row a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treegauge.functions import text as T
from treegauge.operators import files as O
from treegauge.operators import secrets as S
from treegauge.scratch import written

from . import scoring


def findings(files: DataFrame) -> DataFrame:
    """(repo_id, id, category, severity, penalty) for files (repo_id, path, raw, lines, is_test)."""
    kept = lambda df, id_, category, severity: df.select("repo_id", (F.lit(id_) if isinstance(id_, str) else id_).alias("id"), F.lit(category).alias("category"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))
    secret = S.secret_findings(S.secret_matches(files))
    secret = kept(secret, F.col("pattern"), "security", F.col("severity"))
    ratio = O.clone_ratio(files).where("ratio > 0.05")
    clone = kept(ratio, "quality.duplication", "quality", F.when(F.col("ratio") > 0.20, "major").otherwise("minor"))
    loc = files.groupBy("repo_id").agg(F.sum(F.when(F.col("is_test"), F.col("lines")).otherwise(0)).alias("t"), F.sum(F.when(F.col("is_test"), 0).otherwise(F.col("lines"))).alias("s"), F.max("lines").alias("longest"), F.bool_or(T.base_name(F.lower("path")).rlike(r"^readme(\.md|\.rst|\.txt)?\z")).alias("readme"))
    long = kept(loc.where("longest > 400"), F.when(F.col("longest") > 800, "quality.godfiles").otherwise("quality.longfiles"), "quality", F.when(F.col("longest") > 800, "major").otherwise("minor"))
    share = F.coalesce(F.try_divide("t", "s"), F.lit(0.0))
    thin = kept(loc.where(share < 0.20), "testing.ratio", "testing", F.when(share < 0.05, "major").otherwise("minor"))
    bare = kept(loc.where("not readme"), "documentation.readme", "documentation", "critical")
    out = secret
    for more in (clone, long, thin, bare):
        out = out.unionByName(more)
    return out.withColumn("penalty", T.penalty(F.col("severity")))


def report(files: DataFrame) -> DataFrame:
    """(repo_id, files, loc, findings, overall, grade), one row a repository.

    Files are written once to the shared folder, since every rule reads them, and so are the findings.
    """
    files = written(files.select("repo_id", "path", "raw", "lines", "is_test"))
    found = written(findings(files))
    scores = scoring.category_scores(found.where("category <> 'testing'"))
    tests = files.groupBy("repo_id").agg(F.sum(F.when(F.col("is_test"), F.col("lines")).otherwise(0)).alias("test_loc"), F.sum(F.when(F.col("is_test"), 0).otherwise(F.col("lines"))).alias("source_loc"), F.count(F.lit(1)).alias("files"), F.sum("lines").alias("loc"))
    testing = tests.select("repo_id", F.lit("testing").alias("category"), (100 - scoring.testing_score()).alias("penalty"), scoring.testing_score().alias("score"))
    graded = scoring.overall(scores.unionByName(testing))
    count = found.groupBy("repo_id").agg(F.count(F.lit(1)).alias("findings"))
    return tests.select("repo_id", "files", "loc").join(count, "repo_id", "left").join(graded, "repo_id").select("repo_id", "files", "loc", F.coalesce("findings", F.lit(0)).alias("findings"), "overall", "grade")
