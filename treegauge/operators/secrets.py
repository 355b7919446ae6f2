"""Committed secrets: every match of twelve patterns in whole texts, with its line, in file order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegauge.functions import rules as R
from treegauge.functions import text as T

#: What every match of a pattern contains: a text without it needs no regular expression.
#: Those of the pattern without regard to case are looked for in the lower-cased text.
HOLDS = {
    "security.privatekey": ("PRIVATE KEY",),
    "security.awskeys": ("AKIA", "ASIA"),
    "security.tokens.gh": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
    "security.tokens.google": ("AIza",),
    "security.tokens.slack": ("xox",),
    "security.tokens.stripe": ("sk_live_",),
    "security.tokens.npm": ("npm_",),
    "security.tokens.gitlab": ("glpat-",),
    "security.tokens.openai": ("sk-",),
    "security.tokens.sendgrid": ("SG.",),
    "security.tokens.telegram": (":AA",),
    "security.generic": ("passw", "pwd", "secret", "token", "key"),
}
SHOWN = 12


def _breaks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def _matches(name: str, pattern: str, group: int) -> Column:
    """array<struct<pattern, nth, before, inside, value, rest>> of one pattern, in order.

    Each match begins where the one before it ended and holds the gap between them, so that line
    breaks before it can be added up; rest is the line from the match's first character on.
    """
    plain = pattern.removeprefix("(?i)")
    # a word character comes first in all patterns with a boundary there, so one side is enough
    java = T.java(re.sub(r"^\\b", r"(?<![A-Za-z0-9_])", plain))
    core = f"(?{'i' if plain != pattern else ''}:{java})"
    whole = F.lit(rf"(?s)\G(.*?)({core})(?=([^\n]*))")
    every = lambda g: F.regexp_extract_all("raw", whole, F.lit(g))
    parts = F.arrays_zip(every(1).alias("gap"), every(2).alias("match"), every(2 + group).alias("value"), every(3 + re.compile(pattern).groups).alias("tail"))
    one = lambda x, i: F.struct(
        F.lit(name).alias("pattern"),
        i.alias("nth"),
        _breaks(x["gap"]).alias("before"),
        _breaks(x["match"]).alias("inside"),
        x["value"].alias("value"),
        F.regexp_extract(F.concat(x["match"], x["tail"]), r"^[^\n]*", 0).alias("rest"),
    )
    among = F.lower("raw") if plain != pattern else F.col("raw")
    held = F.lit(False)
    for s in HOLDS[name]:
        held = held | F.contains(among, F.lit(s))
    none = F.array().cast("array<struct<pattern:string,nth:int,before:int,inside:int,value:string,rest:string>>")
    return F.when(held & F.col("raw").rlike(core), F.transform(parts, one)).otherwise(none)


def secret_matches(files: DataFrame) -> DataFrame:
    """(repo_id, path, pattern, nth, line, value, entropy): surviving matches in files (repo_id, path, raw).

    nth counts a pattern's matches in a file. Placeholders, values beside an access to the environment,
    and generic values of fewer than 10 units or little entropy are left out.
    """
    found = files.select("repo_id", "path", F.explode(F.concat(*[_matches(*s) for s in R.SECRETS])).alias("x")).select("repo_id", "path", "x.*")
    w = Window.partitionBy("repo_id", "path", "pattern").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("line", (F.sum(F.col("before") + F.col("inside")).over(w) - F.col("inside") + 1).cast("int"))
    found = found.where(~F.col("value").rlike(T.java(R.PLACEHOLDER)) & ~F.col("rest").rlike(T.java(R.ENV_CONTEXT))).withColumn("entropy", T.entropy(F.col("value")))
    strong = (T.units(F.col("value")) >= 10) & (F.col("entropy") >= 3.0) & ~F.lower("value").isin(*R.RESERVED)
    return found.where((F.col("pattern") != "security.generic") | strong).select("repo_id", "path", "pattern", "nth", "line", "value", "entropy")


def first_matches(matches: DataFrame, shown: int = SHOWN) -> DataFrame:
    """matches with place: the first `shown` of each pattern of a repository, in file order."""
    w = Window.partitionBy("repo_id", "pattern").orderBy(T.file_order(), "nth")
    return matches.withColumn("place", F.row_number().over(w)).where(F.col("place") <= shown)


def secret_findings(matches: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(repo_id, pattern, n, severity): at most `shown` places a pattern; one step down if any of them is in a test path."""
    severity = F.when(F.col("pattern") == "security.generic", "major").otherwise("critical")
    out = first_matches(matches, shown).groupBy("repo_id", "pattern").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("path").rlike(R.SECRET_TEST_PATH)).alias("tested"))
    return out.select("repo_id", "pattern", "n", F.when(F.col("tested"), T.one_step_down(severity)).otherwise(severity).alias("severity"))
