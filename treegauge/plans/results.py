"""The whole result document of every repository, and the way there from trees, folders or archives.

A document's members are made apart, each one JSON text a repository, then brought together by one union and
one aggregate: a member costs no join of its own. sources/landed.py has the schema that reads them all back.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treegauge.functions import rules as R
from treegauge.functions import text as T
from treegauge.operators import ignore as IG
from treegauge.sources import landed as LA
from treegauge.sources.tree import SourceTree

from . import architecture as A
from . import audit, outputs, scoring

#: Members in the order in which they are written.
MEMBERS = ("id", "repo", "meta", "scores", "findings", "architecture", "fileGraph", "plan", "stats", "vulnerableDeps", "notes", "analyzedAt", "prescription")
#: What a member of a repository without rows of it is.
EMPTY = {"findings": "[]", "plan": "[]", "vulnerableDeps": "[]", "notes": "[]", "prescription": "null"}
TESTING_NOTE = "led by the share of test lines, less what checks and coverage lack"


def _rows(df: DataFrame, *by: Column, row: Column) -> DataFrame:
    """(repo_id, x): rows of a repository as an array, in the order of by."""
    each = F.array_sort(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)], row.alias("row"))))
    return df.groupBy("repo_id").agg(F.transform(each, lambda s: s["row"]).alias("x"))


def categories(scores: DataFrame, made_of: DataFrame) -> DataFrame:
    """(repo_id, x): all categories in their fixed order, 100 where there are no findings, with what each score is made of."""
    every = scores.select("repo_id").distinct().select("repo_id", F.explode(F.array(*map(F.lit, outputs.ORDER))).alias("category"))
    parts = made_of.groupBy("repo_id", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct("title", "penalty").alias("c")))), lambda s: s["c"]).alias("contributions"))
    each = every.join(scores.select("repo_id", "category", "score"), ["repo_id", "category"], "left").fillna(100, ["score"]).join(parts, ["repo_id", "category"], "left")
    label = F.create_map(*[F.lit(x) for pair in R.LABELS.items() for x in pair])[F.col("category")]
    none = F.array().cast("array<struct<title:string,penalty:int>>")
    row = F.struct(F.col("category").alias("key"), label.alias("label"), "score", (100 - F.col("score")).alias("penalty"), F.coalesce("contributions", none).alias("contributions"), F.when(F.col("category") == "testing", TESTING_NOTE).alias("note"))
    return _rows(each, F.array_position(F.array(*map(F.lit, outputs.ORDER)), F.col("category")), row=row)


def by_language(code: DataFrame) -> DataFrame:
    """(repo_id, by_language, names): files and lines of each language analysed; names in the order in which files show them."""
    each = code.groupBy("repo_id", F.coalesce("lang", F.lit(R.KEY_FILES)).alias("lang")).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("loc"), F.min(T.file_order()).alias("first"))
    own = F.array_sort(F.collect_list(F.struct("first", "lang", F.struct("files", "loc").alias("n"))))
    return each.groupBy("repo_id").agg(own.alias("o")).select("repo_id", F.map_from_arrays("o.lang", "o.n").alias("by_language"), F.col("o.lang").alias("names"))


def graph(level: str, nodes: DataFrame, edges: DataFrame, loops: DataFrame, packages: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(repo_id, x): a graph of modules or files, the largest nodes first, with its cycles, its most used nodes and packages."""
    label = F.element_at(F.split("id", "/"), -1) if level == "file" else F.col("id")
    node = F.struct("id", label.alias("label"), F.lit(level).alias("kind"), "loc", "complexity", F.col("fan_in").alias("fanIn"), F.col("fan_out").alias("fanOut"), F.col("in_cycle").alias("inCycle"))
    top = A.top_fan_in(nodes)
    out = _rows(nodes, -F.col("loc"), F.col("id"), row=node).withColumnRenamed("x", "nodes")
    members = loops.groupBy("repo_id", "cycle").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    for df, name, by, row in (
        (edges, "edges", [-F.col("weight"), F.col("src"), F.col("dst")], F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")),
        (members, "cycles", [F.col("cycle")], F.col("ids")),
        (top, "topFanIn", [F.col("place")], F.struct("id", F.col("fan_in").alias("fanIn"))),
        (packages, "externalDeps", [F.col("place")], F.struct(F.col("package").alias("name"), F.col("n").alias("count"))),
    ):
        out = out.join(_rows(df, *by, row=row).withColumnRenamed("x", name), "repo_id", "left")
    out = out.join(unresolved, "repo_id", "left")
    kind = dict(out.dtypes)
    held = [F.coalesce(c, F.array().cast(kind[c])).alias(c) for c in ("nodes", "edges", "cycles", "topFanIn", "externalDeps")]
    return out.select("repo_id", F.struct(F.lit(level).alias("level"), *held, F.coalesce("unresolved", F.lit(0)).alias("unresolvedImports")).alias("x"))


@dataclass
class Analysis:
    """All tables of one run."""

    parts: audit.Parts
    facts: DataFrame
    findings: DataFrame
    scores: DataFrame
    graded: DataFrame
    plan: DataFrame
    notes: DataFrame
    meta: DataFrame
    refs: DataFrame

    def documents(self, at: str, took_ms: int | None = None) -> DataFrame:
        """(id, document): one JSON text a repository, with all members."""
        p, name = self.parts, F.col("repo_id").cast("string")
        script = p.code.where(F.col("analysis").isin("js", "python"))
        packages, unresolved = A.top_packages(p.refs), A.unresolved(p.links)
        mods, files = A.module_graph(script, p.functions, p.edges), A.file_graph(script, p.functions, p.edges)
        n = self.facts.select("repo_id", "analysed", "files", "loc").join(self.notes, "repo_id", "left").join(by_language(p.code), "repo_id", "left").join(self.meta.select("repo_id", "languages"), "repo_id", "left")
        none = F.array().cast("array<string>")
        told = n.withColumn("spoken", F.coalesce(F.when(F.size("names") > 0, F.col("names")), F.slice("languages", 1, 3), none))
        confidence = F.struct(F.col("analysed").alias("filesAnalyzed"), F.coalesce("files_total", "files").alias("filesTotal"), F.col("spoken").alias("languages"), F.coalesce("partial", F.lit(False)).alias("partial"))
        rated = self.graded.join(categories(self.scores, audit.contributions(self.facts, self.findings)), "repo_id").join(told, "repo_id")
        day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        about = F.struct("owner", "name", "description", "stars", "forks", F.col("open_issues").alias("openIssues"), F.col("default_branch").alias("defaultBranch"), F.col("primary_language").alias("primaryLanguage"), F.col("language_bytes").alias("languages"), "license", day("created_at").alias("createdAt"), day("pushed_at").alias("pushedAt"), "contributors", F.col("bus_factor").alias("busFactor"), "archived")
        found = audit.detailed(self.findings, audit.places(p))
        finding = F.struct("id", "category", "severity", "title", "detail", "file", "line", "metric", "penalty", F.lit(None).cast("string").alias("link"))
        item = F.struct(F.col("place").alias("rank"), "title", F.col("advice").alias("detail"), "impact", "effort", F.array("id").alias("relatedFindings"))
        advice = F.create_map(*[F.lit(x) for id_, _, _, words in R.PLAN for x in (id_, words)])
        vuln = F.struct("name", "version", "ecosystem", F.transform("vulns", lambda v: F.struct(v.alias("id"), F.concat(F.lit(R.ADVICE_PAGE), v).alias("url"))).alias("vulns"))
        stats = F.struct(F.col("analysed").alias("filesAnalyzed"), F.coalesce("files_total", "files").alias("filesTotal"), F.col("loc").alias("totalLoc"), F.lit(took_ms).cast("long").alias("durationMs"), F.coalesce("by_language", F.create_map().cast("map<string,struct<files:bigint,loc:bigint>>")).alias("byLanguage"))
        full = {"ignoreNullFields": "false"}
        member = lambda df, key, x, **options: df.select("repo_id", F.lit(key).alias("key"), F.to_json(x, options).alias("x"))
        made = [
            member(self.refs, "repo", F.struct("url", "owner", "name", "ref"), **full),
            member(self.meta, "meta", about, **full),
            member(rated, "scores", F.struct("overall", "grade", F.col("x").alias("categories"), confidence.alias("confidence"))),
            member(_rows(found, F.col("seq"), row=finding), "findings", F.col("x")),
            member(graph("module", *mods, p.loops, packages, unresolved), "architecture", F.col("x")),
            member(graph("file", *files, A.G.cycles(files[1]), packages, unresolved), "fileGraph", F.col("x")),
            member(_rows(self.plan.withColumn("advice", F.try_element_at(advice, F.col("id"))), F.col("place"), row=item), "plan", F.col("x")),
            member(told, "stats", stats),
            member(_rows(p.bad, -F.size("vulns"), F.col("ecosystem"), F.col("name"), F.col("version"), row=vuln), "vulnerableDeps", F.col("x")),
            member(self.notes, "notes", F.col("notes")),
            self.facts.select("repo_id", F.lit("analyzedAt").alias("key"), F.to_json(F.array(F.lit(at))).alias("x")).withColumn("x", F.expr("substring(x, 2, length(x) - 2)")),
            self.facts.select("repo_id", F.lit("id").alias("key"), F.to_json(F.array(name)).alias("x")).withColumn("x", F.expr("substring(x, 2, length(x) - 2)")),
        ]
        every = made[0]
        for more in made[1:]:
            every = every.unionByName(more)
        held = every.groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "x"))).alias("m"))
        text = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(EMPTY.get(k)))) for k in MEMBERS]
        whole = F.concat(F.lit("{"), F.concat_ws(",", *text), F.lit("}"))
        return held.join(self.facts.select("repo_id"), "repo_id", "left_semi").select(name.alias("id"), whole.alias("document"))


def analysed(tree: DataFrame, meta: DataFrame, advisories: DataFrame, now: datetime, fixed: bool = False, progress: audit.Progress | None = None, refs: DataFrame | None = None) -> Analysis:
    """Everything about the repositories of a tree (repo_id, path, size, raw), each step's message after its rows are there.

    refs (repo_id, url, owner, name, ref): where trees come from; without it, from meta, without an address.
    """
    say = progress or (lambda stage, percent, message: None)
    p = audit.parts(tree, advisories, fixed, progress)
    known = audit.known(p, meta, now, fixed)
    found = audit.findings(known, p.code, fixed, p)
    say("scoring", 90, f"{found.count()} findings are scored")
    scores = audit.scores(known, found)
    stats = IG.walk_stats(tree, IG.ignore_rules(tree.select("repo_id", "path", "raw"), fixed))
    notes = audit.notes(known, stats, found).join(stats.select("repo_id", "files_total"), "repo_id", "left")
    if refs is None:
        refs = meta.select("repo_id", F.lit(None).cast("string").alias("url"), "owner", "name", F.col("default_branch").alias("ref"))
    return Analysis(p, known, found, scores, scoring.overall(scores), audit.plan(found), notes, meta, refs)


def run(tree: DataFrame, meta: DataFrame, advisories: DataFrame, now: datetime, fixed: bool = False, progress: audit.Progress | None = None, refs: DataFrame | None = None) -> DataFrame:
    """(id, document) for every repository of a tree: the one way from files to documents."""
    began = time.time()
    a = analysed(tree, meta, advisories, now, fixed, progress, refs)
    out = audit.written(a.documents(now.strftime("%Y-%m-%dT%H:%M:%SZ"), int((time.time() - began) * 1000)))
    if progress:
        progress("scoring", 96, f"{out.count()} reports are written")
    return out


def of_folders(spark: SparkSession, roots: dict[str, str], now: datetime, advisories: DataFrame | None = None, **more: object) -> DataFrame:
    """run() over local trees, by name."""
    spark.dataSource.register(SourceTree)
    tree = spark.read.format("source_tree").option("roots", ",".join(f"{k}={v}" for k, v in roots.items())).load()
    meta = LA.local_meta(spark.createDataFrame([(k,) for k in roots], "repo_id string"), now)
    return run(tree, meta, no_advisories(spark) if advisories is None else advisories, now, **more)


def of_archives(spark: SparkSession, path: str, now: datetime, meta: DataFrame | None = None, advisories: DataFrame | None = None, **more: object) -> tuple[DataFrame, DataFrame]:
    """(run() over landed archives, what could not be read): one repository an archive, with meta (LA.repo_meta) where it is known."""
    tree, bad = LA.archives(spark, path)
    tree = audit.written(tree)
    local = LA.local_meta(tree.select("repo_id").distinct(), now)
    about = local if meta is None else meta.unionByName(local.join(meta, "repo_id", "left_anti"))
    return run(tree, about.join(tree.select("repo_id").distinct(), "repo_id", "left_semi"), no_advisories(spark) if advisories is None else advisories, now, **more), bad


def no_advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "ecosystem string, name string, version string, vuln_id string")
