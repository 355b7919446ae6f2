"""References between files: imports in JavaScript and Python texts, resolved to files or packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.functions import rules as R
from treegauge.functions import text as T


def _all(pattern: str, group: int) -> Column:
    return F.regexp_extract_all("raw", F.lit(pattern), F.lit(group))


def imported(files: DataFrame) -> DataFrame:
    """(repo_id, path, analysis, spec): every import of files (repo_id, path, raw, analysis).

    The four JavaScript forms are looked for independently, so a text may count in two of them.
    """
    js = F.concat(*[_all(p, 1) for p in R.JS_IMPORTS])
    listed = F.flatten(F.transform(_all(R.PY_IMPORT, 2), lambda x: F.split(x, ",")))
    py = F.concat(_all(R.PY_IMPORT, 1), F.transform(listed, lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")))
    spec = F.when(F.col("analysis") == "js", js).when(F.col("analysis") == "python", F.filter(py, lambda x: x != ""))
    return files.select("repo_id", "path", "analysis", F.explode(spec).alias("spec"))


def joined(folder: Column, spec: Column) -> Column:
    """spec from folder with . and .. followed; .. at the root stays there."""
    steps = F.filter(F.split(F.concat_ws("/", folder, spec), "/"), lambda s: (s != ".") & (s != ""))
    walk = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(walk, "/")


def is_package(analysis: Column, spec: Column) -> Column:
    return (analysis == "js") & ~F.startswith(spec, F.lit("."))


def packages(refs: DataFrame) -> DataFrame:
    """(repo_id, package, n) of JavaScript imports that name a package."""
    parts = F.split("spec", "/")
    name = F.when(F.startswith("spec", F.lit("@")), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))
    out = refs.where(is_package(F.col("analysis"), F.col("spec"))).groupBy("repo_id", name.alias("package")).agg(F.count(F.lit(1)).alias("n"))
    return out.where("package <> ''")


def links(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, spec, n, target): references to files; target is null where no file of the repository answers.

    Candidates are tried in a fixed order and without regard to case; equal references are one row
    with their count, so the join sees each of them once.
    """
    once = refs.where(~is_package(F.col("analysis"), F.col("spec"))).groupBy("repo_id", "path", "analysis", "spec").agg(F.count(F.lit(1)).alias("n"))
    base = F.when(F.col("analysis") == "js", joined(F.regexp_extract("path", "^(.*)/", 1), F.col("spec"))).otherwise(F.replace("spec", F.lit("."), F.lit("/")))
    js = F.transform(F.array(*map(F.lit, R.JS_TAILS)), lambda t: F.lower(F.concat("base", t)))
    py = F.array(*[F.lower(F.concat(F.lit(head), "base", F.lit(tail))) for head, tail in R.PY_FORMS])
    tried = once.withColumn("base", base).select("repo_id", "path", "spec", "n", F.posexplode(F.when(F.col("analysis") == "js", js).otherwise(py)).alias("rank", "low"))
    known = files.groupBy("repo_id", F.lower("path").alias("low")).agg(F.max("path").alias("target"))
    hit = tried.join(known, ["repo_id", "low"], "left")
    first = F.min(F.when(F.col("target").isNotNull(), F.struct("rank", "target")))["target"]
    return hit.groupBy("repo_id", "path", "spec", "n").agg(first.alias("target"))


def file_edges(found: DataFrame) -> DataFrame:
    """(repo_id, src, dst, weight) between different files."""
    held = found.where("target is not null and target <> path")
    return held.groupBy("repo_id", F.col("path").alias("src"), F.col("target").alias("dst")).agg(F.sum("n").alias("weight"))


def module_edges(edges: DataFrame) -> DataFrame:
    """(repo_id, src, dst, weight) between different modules."""
    m = edges.select("repo_id", T.module_of(F.col("src")).alias("src"), T.module_of(F.col("dst")).alias("dst"), "weight")
    # a filter before the sums would have every module worked out again, and its path with it
    return m.groupBy("repo_id", "src", "dst").agg(F.sum(F.when(F.col("src") != F.col("dst"), F.col("weight"))).alias("weight")).where("weight is not null")
