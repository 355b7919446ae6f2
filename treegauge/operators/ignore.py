"""The rules of a tree's own ignore file, and the files that they leave out.

A rule is a row (repo_id, kind, pattern), and what a path offers to be matched is a row too, so that
leaving files out is one anti join on equal values, however many rules a tree has:

    dir       the name of any folder above the file
    suffix    the end of the path from any of its dots on
    path      the path itself or any folder above it

As in the rules' compatible mode, only the root's ignore file counts, negation is dropped, a star
works only in `*.end`, and a name with a dot inside (`name.ext`) matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.functions import rules as R
from treegauge.functions import text as T


def ignore_rules(ignore_files: DataFrame, fixed: bool = False) -> DataFrame:
    """Distinct (repo_id, kind, pattern) of the root's ignore files (repo_id, path, raw); with fixed, a plain name.ext is a path at any depth."""
    line = ignore_files.where((F.col("path") == ".gitignore") & F.col("raw").isNotNull()).select("repo_id", F.explode(F.split("raw", "\n")).alias("x"))
    line = line.select("repo_id", F.regexp_replace("x", r"^\s+|\s+\z", "").alias("x")).where(~F.col("x").rlike("^[#!]") & (F.col("x") != ""))
    p = F.lower(F.regexp_replace(F.regexp_replace("x", "^/", ""), r"/\z", ""))
    plain = F.struct(F.lit("name" if fixed else "path").alias("kind"), (p if fixed else F.concat(F.lit("*"), p)).alias("pattern"))
    as_path, as_dir = F.struct(F.lit("path").alias("kind"), p.alias("pattern")), F.struct(F.lit("dir").alias("kind"), p.alias("pattern"))
    rule = F.when(F.contains(p, F.lit("*")) | F.contains(p, F.lit("/")), as_path).when(F.contains(p, F.lit(".")), plain).otherwise(as_dir)
    kept = line.where(p != "").select("repo_id", rule.alias("r")).select("repo_id", "r.kind", "r.pattern")
    # `*.end`, as written or made of a name that begins with a dot, is a suffix
    end = F.col("pattern").startswith("*.") & (F.col("kind") == "path")
    return kept.select("repo_id", F.when(end, "suffix").otherwise(F.col("kind")).alias("kind"), F.when(end, F.substring("pattern", 2, 1 << 20)).otherwise(F.col("pattern")).alias("pattern")).distinct()


def default_rules(repos: DataFrame) -> DataFrame:
    """The default folders as rules of each repository (repo_id), for a union with its own."""
    return repos.select("repo_id", F.lit("dir").alias("kind"), F.explode(F.array(*map(F.lit, R.IGNORED_DIRS))).alias("pattern"))


def _offers(path: Column) -> Column:
    low = F.lower(path)
    parts = F.split(low, "/")
    dots = F.split(low, r"\.")
    kind = lambda name, xs: F.transform(xs, lambda x: F.struct(F.lit(name).alias("kind"), x.alias("pattern")))
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ends = F.when(F.size(dots) > 1, F.transform(F.sequence(F.lit(2), F.size(dots)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(dots, i, F.size(dots)), ".")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(kind("dir", F.slice(parts, F.lit(1), F.size(parts) - 1)), kind("suffix", ends), kind("path", above), kind("name", F.array(F.element_at(parts, -1)))))


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo_id, path) of the files that a rule of their repository matches."""
    offers = files.select("repo_id", "path", F.explode(_offers(F.col("path"))).alias("o")).select("repo_id", "path", "o.kind", "o.pattern")
    return offers.join(rules, ["repo_id", "kind", "pattern"], "left_semi").select("repo_id", "path").distinct()


def unignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files without those that the default rules or a rule of their repository matches."""
    kept = files.where(~T.is_ignored(F.col("path")))
    return kept.join(ignored(kept, rules), ["repo_id", "path"], "left_anti")


def walk_stats(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo_id, files_total, skipped): files outside ignored folders, and the ignored files and topmost ignored folders among all."""
    parts = F.split(F.lower("path"), "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    own = rules.where("kind = 'dir'").groupBy("repo_id").agg(F.collect_set("pattern").alias("own"))
    some = files.select("repo_id", "path").join(own, "repo_id", "left")
    names = F.concat(F.array(*map(F.lit, R.IGNORED_DIRS)), F.coalesce("own", F.array().cast("array<string>")))
    first = F.array_position(F.transform(folders, lambda x: F.array_contains(names, x)), True)
    at = some.select("repo_id", "path", first.alias("first"), F.when(first > 0, F.array_join(F.slice(F.split("path", "/"), F.lit(1), first.cast("int")), "/")).alias("folder"))
    gone = at.where("first = 0").select("repo_id", "path").join(unignored(files.select("repo_id", "path"), rules), ["repo_id", "path"], "left_anti")
    n = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    counted = at.groupBy("repo_id").agg(n(F.when(F.col("first") == 0, 1)).alias("files_total"), F.count_distinct("folder").alias("folders"))
    single = gone.groupBy("repo_id").agg(F.count(F.lit(1)).alias("single"))
    return counted.join(single, "repo_id", "left").select("repo_id", "files_total", (F.col("folders") + F.coalesce("single", F.lit(0))).alias("skipped"))
