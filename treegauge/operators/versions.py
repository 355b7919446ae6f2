"""Versions that sort, and dependencies inside the version ranges of advisories.

A version is numbers with dots, then nothing, a pre-release or a post-release, then build data behind `+`,
which don't count. Trailing zero numbers don't count either. Pre-releases come before their release, by
their parts: numbers by size and before words, words by code point, fewer parts first. `1.0rc1` is read like `1.0-rc1`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegauge.operators.deps import advice_name
from treegauge.scratch import met, written

#: Keys of so many texts at most are sent to all tasks.
FEW_TEXTS = 100_000


def _number(x: Column) -> Column:
    """Digits as text that sorts by size: their count, then they."""
    plain = F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.concat(F.lpad(F.char_length(plain).cast("string"), 3, "0"), plain)


def version_key(version: Column) -> Column:
    """A text that sorts, by code point, as the version does; null for what begins with no number."""
    plain = F.regexp_replace(F.trim(version), r"^[vV=]+|\+.*$", "")
    numbers = F.regexp_extract(plain, r"^[0-9]+(?:\.[0-9]+)*", 0)
    rest = F.regexp_replace(F.substr(plain, F.char_length(numbers) + 1), "^[-._]+", "")
    # what follows the numbers: a pre-release, nothing, a post-release or another number, in this order
    head = F.array_join(F.transform(F.split(F.regexp_replace(numbers, r"(?:\.0+)+$", ""), r"\."), _number), ".")
    ids = F.transform(F.split(F.regexp_replace(rest, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", "."), r"[._-]+"), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), _number(x))).otherwise(F.concat(F.lit("1"), x)))
    tail = F.when(rest == "", F.lit("#")).when(rest.rlike("^(?i:post|rev|r)[0-9.]*$"), F.concat(F.lit("$"), F.array_join(ids, " "))).otherwise(F.concat(F.lit("!"), F.array_join(ids, " ")))
    return F.when(numbers != "", F.concat(head, tail))


def in_ranges(deps: DataFrame, ranges: DataFrame, most: int = 8) -> DataFrame:
    """(repo_id, ecosystem, name, version, vulns): dependencies whose version lies in a range of an advisory.

    ranges (ecosystem, name, vuln_id, introduced, fixed, last_affected): from introduced on (null or 0: from the first
    version on), before fixed, or up to last_affected; both null: without end. Ranges of one advisory add up.

    The bounds of a package's ranges cut its versions into buckets, and a version lies in one. What holds a bucket is
    settled among the ranges alone and goes with its lower bound, so that each version takes the list of the last bound at
    or below it, in one sorted pass over a package's bounds and versions: no version meets a range. Texts of versions
    repeat from package to package, so each is made a key once; the keys are broadcast if they are few, by their count. Only distinct versions are
    placed, so a dependency that a third of all rows pin weighs no more than another. Versions without a number,
    and ranges with a bound that has none, match nothing. The first `most` advisories by id are listed.
    """
    package = ["service", "name"]
    named = deps.withColumn("service", advice_name(F.col("ecosystem")))
    once = named.where("name is not null and version is not null").select(*package, "version").distinct()
    texts = once.select("version")
    for c in ("introduced", "fixed", "last_affected"):
        texts = texts.union(ranges.select(c))
    keys = written(texts.where("version is not null").distinct().select("version", version_key(F.col("version")).alias("key")))
    small = keys.count() <= FEW_TEXTS

    def key(df: DataFrame, c: str, name: str) -> DataFrame:
        side = keys.select(F.col("version").alias(c), F.col("key").alias(name))
        return df.join(F.broadcast(side) if small else met(side), c, "left")

    versions = key(once, "version", "key").where("key is not null")
    bounded = key(key(key(ranges, "introduced", "i"), "fixed", "f"), "last_affected", "l")
    from_ = F.when(F.col("introduced").isNull() | (F.col("introduced") == "0"), F.lit("")).otherwise(F.col("i"))
    # the least text above a key is the key and one more character, the smallest
    to = F.when(F.col("fixed").isNotNull(), F.col("f")).when(F.col("last_affected").isNotNull(), F.concat("l", F.lit("\x01"))).otherwise("￿")
    r = bounded.select(advice_name(F.col("ecosystem")).alias("service"), "name", "vuln_id", from_.alias("lo"), to.alias("hi")).where("lo < hi and name is not null").distinct()
    # both bounds of a range in the order of all its package's: their places are the first bucket inside and the first behind
    ends = r.select(*package, "vuln_id", "lo", "hi", F.explode(F.array("lo", "hi")).alias("key"))
    ranked = ends.withColumn("bucket", F.dense_rank().over(Window.partitionBy(*package).orderBy("key")))
    runs = ranked.groupBy(*package, "vuln_id", "lo", "hi").agg(F.min("bucket").alias("first"), F.max("bucket").alias("end"))
    cells = runs.select(*package, F.explode(F.sequence("first", F.col("end") - 1)).alias("bucket"), "vuln_id").distinct()
    few = cells.withColumn("place", F.row_number().over(Window.partitionBy(*package, "bucket").orderBy(F.asc_nulls_last("vuln_id")))).where(F.col("place") <= most)
    held = few.groupBy(*package, "bucket").agg(F.array_sort(F.collect_list("vuln_id")).alias("vulns"))
    bounds = ranked.select(*package, "bucket", "key").distinct().join(met(held), [*package, "bucket"], "left")
    none = F.array().cast("array<string>")
    both = bounds.select(*package, "key", F.lit(None).cast("string").alias("version"), F.coalesce("vulns", none).alias("vulns")).unionByName(versions.withColumn("vulns", F.lit(None).cast("array<string>")))
    # a bound comes before the versions that equal it
    w = Window.partitionBy(*package).orderBy("key", F.asc_nulls_first("version")).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("vulns", F.last("vulns", True).over(w)).where("version is not null and size(vulns) > 0")
    return named.join(met(hit.select(*package, "version", "vulns")), [*package, "version"]).select("repo_id", "ecosystem", "name", "version", "vulns")
