"""Operators over files (repo_id, path, raw): classification, lines, budgets, dangerous lines, clones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegauge.functions import rules as R
from treegauge.functions import text as T
from treegauge.scratch import written


def language_dim(spark: SparkSession) -> DataFrame:
    """(ext, lang, analysis): a fixed table of some dozens of rows."""
    rows = [(e, name, kind) for name, kind, exts in R.LANGUAGES for e in exts.split()]
    return spark.createDataFrame(rows, "ext string, lang string, analysis string")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where it has fewer: a table of few row groups would keep the others idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def classify(files: DataFrame) -> DataFrame:
    """files with ext, is_binary, is_test, is_lock, lang, analysis."""
    ext = files.withColumn("ext", T.extension(F.col("path")))
    flagged = ext.withColumn("is_binary", T.is_binary(F.col("ext"))).withColumn("is_test", T.is_test(F.col("path"))).withColumn("is_lock", T.is_lock(F.col("path")))
    return flagged.join(F.broadcast(language_dim(files.sparkSession)), "ext", "left")


def file_cap(files: DataFrame, most: int) -> DataFrame:
    """The first files of each repository in file order, for callers who want no more; audits take every file.

    Only keys are ranked; whole rows then follow them, so no task sorts a repository's texts.
    """
    w = Window.partitionBy("repo_id").orderBy(T.file_order())
    first = files.select("repo_id", "path").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return files.join(first.drop("place"), ["repo_id", "path"], "left_semi")


def text_budget(files: DataFrame, most: int) -> DataFrame:
    """Files in file order until the units of their texts pass `most`; the crossing file is kept. before: the units until then.

    Prefix sums of two levels: keys are dealt to tasks by ranges of the file order, each range adds up inside
    itself, and what comes before it are the sums of the ranges before. So a task holds a range, however
    large a repository is. The ranges are written, so that a task that runs again finds the same ones.
    """
    order = T.file_order().alias("order")
    light = files.select("repo_id", "path", order, T.units(F.col("raw")).alias("units"))
    dealt = written(light.repartitionByRange("repo_id", "order").withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("repo_id", "range").agg(F.sum("units").alias("units"))
    ahead = lambda w: F.coalesce(F.sum("units").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = sums.select("repo_id", "range", ahead(Window.partitionBy("repo_id").orderBy("range")).alias("above")).where(F.col("above") <= most)
    inside = dealt.select("repo_id", "path", "range", ahead(Window.partitionBy("repo_id", "range").orderBy("order")).alias("inside"))
    kept = inside.join(above, ["repo_id", "range"]).select("repo_id", "path", (F.col("above") + F.col("inside")).alias("before"))
    return files.join(kept.where(F.col("before") <= most), ["repo_id", "path"])


def lines(files: DataFrame, text: str = "raw") -> DataFrame:
    """(repo_id, path, line from 1, text) of every line."""
    return files.where(F.length(text) > 0).select("repo_id", "path", F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def pattern_lines(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, pattern, severity) of dangerous lines; files need analysis and is_test."""
    checks = F.filter(
        F.array(*[F.struct(F.lit(name).alias("pattern"), F.lit(sev).alias("severity"), (F.col("analysis").isin(*langs.split()) & F.col("text").rlike(T.java(p))).alias("hit")) for name, p, langs, sev in R.DANGEROUS]),
        lambda x: x["hit"],
    )
    rows = files.where(~F.col("is_test")).select("repo_id", "path", "analysis", F.posexplode(F.split("raw", "\n")).alias("line", "text"))
    return rows.select("repo_id", "path", (F.col("line") + 1).alias("line"), F.explode(checks).alias("x")).select("repo_id", "path", "line", "x.pattern", "x.severity")


def first_lines(found: DataFrame, shown: int = 12) -> DataFrame:
    """pattern_lines with place: the first `shown` of each pattern of a repository, in file order."""
    w = Window.partitionBy("repo_id", "pattern").orderBy(T.file_order(), "line")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= shown)


def clone_lines(files: DataFrame, text: str = "raw") -> DataFrame:
    """(repo_id, path, line, text) of the lines that clone detection compares."""
    return lines(files, text).withColumn("text", T.squeezed(F.col("text"))).where((F.length("text") >= R.CLONE_LEAST) & ~F.col("text").rlike(R.CLONE_SKIP.replace("$", r"\z")))


def _runs(files: DataFrame, text: str) -> DataFrame:
    """(repo_id, path, line, key) of the compared lines; key is of the seven lines up to this one, null where there are fewer."""
    w = Window.partitionBy("repo_id", "path").orderBy("line")
    held = clone_lines(files, text).withColumn("run", F.collect_list("text").over(w.rowsBetween(1 - R.CLONE_LINES, 0)))
    return held.select("repo_id", "path", "line", F.when(F.size("run") == R.CLONE_LINES, F.md5(F.array_join("run", "\n"))).alias("key"))


def clone_windows(files: DataFrame, text: str = "raw") -> DataFrame:
    """(repo_id, path, line, key): every run of seven compared lines, by its last line."""
    return _runs(files, text).where("key is not null")


def clone_groups(files: DataFrame, text: str = "raw") -> DataFrame:
    """(repo_id, key, n, first_path, first_line) of windows that a repository holds twice or more."""
    first = F.min(F.struct(T.file_order().alias("order"), "line", "path"))
    g = clone_windows(files, text).groupBy("repo_id", "key").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    return g.where("n > 1").select("repo_id", "key", "n", F.col("first.path").alias("first_path"), (F.col("first.line") - (R.CLONE_LINES - 1)).alias("first_line"))


def clone_ratio(files: DataFrame, text: str = "raw") -> DataFrame:
    """(repo_id, eligible, duplicated, ratio, blocks); overlapping windows count at full weight, blocks are clone_groups. One pass over the lines gives all."""
    n = _runs(files, text).groupBy("repo_id", "key").agg(F.count(F.lit(1)).alias("n"))
    again = F.when(F.col("key").isNotNull(), (F.col("n") - 1) * R.CLONE_LINES).otherwise(0)
    out = n.groupBy("repo_id").agg(F.sum("n").alias("eligible"), F.sum(again).alias("duplicated"), F.count(F.when(F.col("key").isNotNull() & (F.col("n") > 1), 1)).alias("blocks"))
    return out.withColumn("ratio", F.try_divide("duplicated", "eligible"))


def top_clone_groups(groups: DataFrame, most: int = 6, shown: int = 4) -> DataFrame:
    """clone_groups with place: those with the most places first, counted up to `shown`; then in file order."""
    w = Window.partitionBy("repo_id").orderBy(F.desc(F.least("n", F.lit(shown))), T.file_order("first_path"), "first_line", "key")
    return groups.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def clone_places(files: DataFrame, most: int = 6, shown: int = 4, text: str = "raw") -> DataFrame:
    """(repo_id, key, n, place, k, path, line): the first `shown` places of a repository's top groups; line is where a window begins."""
    top = top_clone_groups(clone_groups(files, text), most, shown).select("repo_id", "key", "n", "place")
    w = Window.partitionBy("repo_id", "key").orderBy(T.file_order(), "line")
    each = clone_windows(files, text).join(top, ["repo_id", "key"]).withColumn("k", F.row_number().over(w)).where(F.col("k") <= shown)
    return each.select("repo_id", "key", "n", "place", "k", "path", (F.col("line") - (R.CLONE_LINES - 1)).alias("line"))
