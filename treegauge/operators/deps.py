"""Direct dependencies and pinned versions from manifests (repo_id, path, content); root files only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegauge.functions import rules as R
from treegauge.scratch import written

REQUIREMENTS = R.REQUIREMENTS.replace("$", r"\z")
PAIRS = "array<struct<name:string,version:string>>"


def direct_count(manifests: DataFrame) -> DataFrame:
    """(repo_id, direct): entries of all manifests of a repository."""
    keys = lambda x: F.coalesce(F.size(F.from_json(F.get_json_object("content", x), "map<string,string>")), F.lit(0))
    found = lambda pattern: F.regexp_count("content", F.lit(pattern))
    block = F.regexp_extract("content", R.GO_BLOCK, 1)
    go = F.when(F.col("content").rlike(R.GO_BLOCK), F.regexp_count(block, F.lit(R.GO_BLOCK_LINE))).otherwise(found(R.GO_LINE))
    n = F.when(F.col("path") == "package.json", F.greatest(keys("$.dependencies"), F.lit(0)) + F.greatest(keys("$.devDependencies"), F.lit(0)))
    n = n.when(F.col("path").rlike(REQUIREMENTS), found(R.REQUIRED)).when(F.col("path") == "go.mod", go).when(F.col("path") == "pom.xml", found("<dependency>")).otherwise(0)
    return manifests.groupBy("repo_id").agg(F.sum(n).cast("long").alias("direct"))


def _pairs(pattern: str) -> Column:
    part = lambda i: F.regexp_extract_all("content", F.lit(pattern), F.lit(i))
    return F.zip_with(part(1), part(2), lambda name, version: F.struct(name.alias("name"), version.alias("version")))


def nested_versions(locks: DataFrame) -> DataFrame:
    """(repo_id, name, version) of lock files (repo_id, content) whose entries hold entries of their own, at any depth.

    A level of entries is exploded at a time, of all files together; the loop ends at the deepest file's depth, which is
    all that the driver learns. What is no object has no entries, and texts that are no JSON have none at all.
    """
    member = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    inner = lambda v: F.when(F.schema_of_variant(member(v, "dependencies")).startswith("OBJECT"), member(v, "dependencies"))
    level = locks.select("repo_id", inner(F.try_parse_json("content")).alias("entries")).where("entries is not null")
    found = None
    while True:
        each = level.lateralJoin(locks.sparkSession.tvf.variant_explode(F.col("entries").outer())).select("repo_id", F.col("key").alias("name"), "value")
        held = written(each.where(F.schema_of_variant("value").startswith("OBJECT")))
        named = held.where(F.schema_of_variant(member(F.col("value"), "version")) == "STRING").select("repo_id", "name", F.try_variant_get("value", "$.version", "string").alias("version"))
        found = named if found is None else found.union(named)
        level = held.select("repo_id", inner(F.col("value")).alias("entries")).where("entries is not null")
        if level.isEmpty():
            return found


def _lock() -> Column:
    return F.map_entries(F.from_json(F.get_json_object("content", "$.packages"), "map<string,struct<version:string>>"))


def pins(fixed: bool = False) -> Column:
    """Names and versions in a manifest (path, content), of every form but nested locks; see pinned()."""
    none = F.array().cast(PAIRS)
    plain = F.filter(_lock(), lambda e: ~e["key"].isin("", "node_modules") & ~F.regexp_replace(e["key"], "^node_modules/", "").contains("/node_modules/"))
    npm = F.transform(plain, lambda e: F.struct(F.regexp_replace(e["key"], "^node_modules/", "").alias("name"), e["value"]["version"].alias("version")))
    php = F.concat(*[F.coalesce(F.from_json(F.get_json_object("content", f"$['{s}']"), PAIRS), none) for s in ("packages", "packages-dev")])
    php = F.transform(php, lambda x: F.struct(x["name"].alias("name"), F.regexp_replace(x["version"], "^v", "").alias("version")))
    calm = lambda xs: F.transform(xs, lambda x: F.struct(F.regexp_replace(F.lower(x["name"]), "[-_.]+", "-").alias("name"), x["version"].alias("version")))
    of = F.col("path")
    rows = (
        F.when(of == "package-lock.json", npm)
        .when(of == "pnpm-lock.yaml", _pairs(R.PINS["pnpm"]))
        .when(of.rlike(REQUIREMENTS), calm(_pairs(R.PINS["requirements"])))
        .when(of == "poetry.lock", calm(_pairs(R.PINS["poetry"])))
        .when(of == "Cargo.lock", _pairs(R.PINS["cargo"]))
        .when(of == "composer.lock", php)
    )
    if fixed:
        yarn = _pairs(r'(?m)^"?(@?[^@"\s,]+)@[^\n]*:\r?\n\s+version:? "?([^"\s]+)"?')
        go = _pairs(r"(?m)^(\S+) v([^\s/]+) h1:")
        rows = rows.when(of == "yarn.lock", yarn).when(of == "go.sum", go)
    return F.coalesce(rows, none)


def pinned(manifests: DataFrame, fixed: bool = False) -> DataFrame:
    """(repo_id, ecosystem, name, version): distinct exact versions, which begin with a digit.

    Yarn and Go locks give nothing in the rules' compatible mode; with fixed, they are read too.
    """
    of = F.col("path")
    ecosystem = F.when(of.isin("package-lock.json", "pnpm-lock.yaml", "yarn.lock"), "npm").when(of == "Cargo.lock", "cargo").when(of == "composer.lock", "composer").when(of == "go.sum", "go").otherwise("pip")
    read = manifests.select("repo_id", ecosystem.alias("ecosystem"), F.explode(pins(fixed)).alias("x"))
    # the older form of this lock file nests
    older = manifests.where((of == "package-lock.json") & (F.coalesce(F.size(_lock()), F.lit(0)) <= 0) & F.get_json_object("content", "$.dependencies").isNotNull())
    out = read.select("repo_id", "ecosystem", "x.*").unionByName(nested_versions(older).select("repo_id", F.lit("npm").alias("ecosystem"), "name", "version"))
    return out.where((F.col("name") != "") & F.col("version").rlike("^[0-9]") & ~F.col("version").contains("*")).distinct()


def advice_name(ecosystem: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in R.ECOSYSTEMS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, ecosystem), ecosystem)


def vulnerable(deps: DataFrame, advisories: DataFrame, most: int = 8) -> DataFrame:
    """(repo_id, ecosystem, name, version, vulns): dependencies with advisories (ecosystem, name, version, vuln_id).

    Advisories may name ecosystems as the advisory service does, or as we do; ours stay in the result.
    """
    w = Window.partitionBy("ecosystem", "name", "version").orderBy("vuln_id")
    few = advisories.withColumn("ecosystem", advice_name(F.col("ecosystem"))).distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    ids = few.groupBy("ecosystem", "name", "version").agg(F.array_sort(F.collect_list("vuln_id")).alias("vulns")).withColumnRenamed("ecosystem", "service")
    return deps.withColumn("service", advice_name(F.col("ecosystem"))).join(ids, ["service", "name", "version"]).select("repo_id", "ecosystem", "name", "version", "vulns")


def top_vulnerable(bad: DataFrame, most: int = 8) -> DataFrame:
    """vulnerable() with place: those with the most advisories first."""
    w = Window.partitionBy("repo_id").orderBy(F.desc(F.size("vulns")), "ecosystem", "name", "version")
    return bad.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def advice_requests(deps: DataFrame, size: int = 100) -> DataFrame:
    """(repo_id, request, n, body): what to send to an advisory service, `size` exact versions a request."""
    w = Window.partitionBy("repo_id").orderBy("ecosystem", "name", "version")
    each = F.struct("place", F.struct(F.struct("name", advice_name(F.col("ecosystem")).alias("ecosystem")).alias("package"), "version").alias("q"))
    dealt = deps.withColumn("place", F.row_number().over(w) - 1).groupBy("repo_id", F.floor(F.col("place") / size).cast("int").alias("request")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(each)).alias("qs"))
    return dealt.select("repo_id", "request", "n", F.to_json(F.struct(F.transform("qs", lambda x: x["q"]).alias("queries"))).alias("body"))
