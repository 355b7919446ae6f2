"""What lands beside the trees: addresses, answers of a code host, archives, and stored jobs and results.

Nothing here goes to the network: answers are read as they were stored, one JSON text a repository.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treegauge.functions import rules as R
from treegauge.workers import ship

META = "repo_id string, owner string, name string, description string, stars long, forks long, open_issues long, default_branch string, primary_language string, languages array<string>, license string, created_at timestamp, pushed_at timestamp, contributors int, bus_factor int, archived boolean, language_bytes map<string,bigint>"
JOB = "id string, repoUrl string, owner string, repo string, status string, stage string, progress int, message string, createdAt string, finishedAt string, error string, cached boolean, resultId string, summary struct<overall:int,grade:string>"
GRAPH = "struct<level:string,nodes:array<struct<id:string,label:string,kind:string,loc:long,complexity:int,fanIn:long,fanOut:long,inCycle:boolean>>,edges:array<struct<source:string,target:string,weight:long>>,cycles:array<array<string>>,topFanIn:array<struct<id:string,fanIn:long>>,externalDeps:array<struct<name:string,count:long>>,unresolvedImports:long>"
RESULT = (
    "id string, repo struct<url:string,owner:string,name:string,ref:string>, meta struct<owner:string,name:string,description:string,stars:long,forks:long,openIssues:long,defaultBranch:string,primaryLanguage:string,languages:map<string,long>,license:string,createdAt:string,pushedAt:string,contributors:int,busFactor:int,archived:boolean>, "
    "scores struct<overall:int,grade:string,categories:array<struct<key:string,label:string,score:int,penalty:int,contributions:array<struct<title:string,penalty:int>>,note:string>>,confidence:struct<filesAnalyzed:int,filesTotal:int,languages:array<string>,partial:boolean>>, "
    "findings array<struct<id:string,category:string,severity:string,title:string,detail:string,file:string,line:int,metric:string,penalty:int,link:string>>, "
    f"architecture {GRAPH}, fileGraph {GRAPH}, prescription struct<text:string,provider:string,generatedAt:string>, plan array<struct<rank:int,title:string,detail:string,impact:string,effort:string,relatedFindings:array<string>>>, "
    "stats struct<filesAnalyzed:int,filesTotal:int,totalLoc:long,durationMs:long,byLanguage:map<string,struct<files:int,loc:long>>>, vulnerableDeps array<struct<name:string,version:string,ecosystem:string,vulns:array<struct<id:string,summary:string,url:string>>>>, notes array<string>, analyzedAt string"
)
MOST_BYTES = 150 << 20


def parsed_address(text: Column) -> Column:
    """struct<owner, repo, ref> of a repository's address or of owner/repo, or null; ref only from /tree/ref."""
    clean = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+\z", ""), r"\.git\z", "")
    part = lambda pattern, i: F.regexp_extract(clean, pattern, i)
    short = R.REPO_SHORT.replace("$", r"\z")
    long = F.struct(part(R.REPO_URL, 1).alias("owner"), part(R.REPO_URL, 2).alias("repo"), F.nullif(part(R.REPO_URL, 3), F.lit("")).alias("ref"))
    return F.when(clean.rlike(R.REPO_URL), long).when(clean.rlike(short), F.struct(part(short, 1).alias("owner"), part(short, 2).alias("repo"), F.lit(None).cast("string").alias("ref")))


def answer_error(status: Column, remaining: Column) -> Column:
    """What a code host's answer means: null if fine, else limit, refused, missing, unreachable (no status), or failed."""
    return (
        F.when(status.isNull(), "unreachable")
        .when(status.isin(403, 429), F.when(remaining == 0, "limit").otherwise("refused"))
        .when(status == 404, "missing")
        .when(~status.between(200, 299), "failed")
    )


def answers(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows for repo_meta(), refused (repo_id, status, error)) of landed answers (repo_id, what, status, remaining, body).

    what: repo, languages or contributors. A repository is refused for what its own answer means; the other
    two may fail or be missing, and are null then. Of several answers to one question the last body by code point counts, answers without error first.
    """
    told = landed.withColumn("error", answer_error(F.col("status"), F.col("remaining")))
    best = lambda what: F.max_by(F.struct("status", "error", F.when(F.col("error").isNull(), F.col("body")).alias("body")), F.when(F.col("what") == what, F.struct(F.col("error").isNull(), F.coalesce("body", F.lit("")), F.coalesce("status", F.lit(0))))).alias(what)
    each = told.groupBy("repo_id").agg(*[best(what) for what in ("repo", "languages", "contributors")])
    fine = F.col("repo").isNotNull() & F.col("repo.error").isNull()
    bad = each.where(~fine).select("repo_id", "repo.status", F.coalesce("repo.error", F.lit("missing")).alias("error"))
    return each.where(fine).select("repo_id", F.col("repo.body").alias("repo"), F.col("languages.body").alias("languages"), F.col("contributors.body").alias("contributors")), bad


def repo_meta(landed: DataFrame) -> DataFrame:
    """META rows of (repo_id, repo, languages, contributors) as JSON texts; the last two may be missing.

    Languages go by bytes, the most first. The bus factor is the fewest contributors, in the order
    told, that made half of all contributions.
    """
    kind = "name string, owner struct<login:string>, description string, stargazers_count long, forks_count long, open_issues_count long, default_branch string, language string, license struct<spdx_id:string>, created_at timestamp, pushed_at timestamp, archived boolean"
    x = landed.select("repo_id", F.from_json("repo", kind).alias("r"), F.coalesce(F.from_json("languages", "map<string,long>"), F.create_map().cast("map<string,bigint>")).alias("l"), F.coalesce(F.from_json("contributors", "array<struct<contributions:long>>"), F.array().cast("array<struct<contributions:bigint>>")).alias("c"))
    n = F.transform("c", lambda p: p["contributions"])
    total = F.aggregate(n, F.lit(0).cast("long"), lambda acc, v: acc + v)
    upto = lambda i: F.aggregate(F.slice(n, F.lit(1), i), F.lit(0).cast("long"), lambda acc, v: acc + v)
    half = F.filter(F.sequence(F.lit(1), F.size(n)), lambda i: upto(i) * 2 >= total)
    bus = F.when((F.size(n) > 0) & (total > 0), F.get(half, F.lit(0))).otherwise(F.size(n))
    by_bytes = F.transform(F.array_sort(F.transform(F.map_entries("l"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))), lambda e: e["k"])
    license_ = F.nullif(F.nullif(F.col("r.license.spdx_id"), F.lit("NOASSERTION")), F.lit(""))
    return x.select(
        "repo_id", F.col("r.owner.login").alias("owner"), F.col("r.name").alias("name"), F.col("r.description").alias("description"), F.col("r.stargazers_count").alias("stars"), F.col("r.forks_count").alias("forks"), F.col("r.open_issues_count").alias("open_issues"),
        F.col("r.default_branch").alias("default_branch"), F.col("r.language").alias("primary_language"), by_bytes.alias("languages"), license_.alias("license"), F.col("r.created_at").alias("created_at"), F.col("r.pushed_at").alias("pushed_at"),
        F.size("c").alias("contributors"), bus.cast("int").alias("bus_factor"), F.coalesce("r.archived", F.lit(False)).alias("archived"), F.col("l").alias("language_bytes"),
    )


def local_meta(repos: DataFrame, now: datetime) -> DataFrame:
    """META rows for trees (repo_id) of a local folder: one contributor, no languages, just pushed."""
    none = lambda kind: F.lit(None).cast(kind)
    return repos.select("repo_id", F.lit("local").alias("owner"), F.col("repo_id").cast("string").alias("name"), F.lit("(local folder)").alias("description"), *[F.lit(0).cast("long").alias(c) for c in ("stars", "forks", "open_issues")], F.lit("main").alias("default_branch"), none("string").alias("primary_language"), F.array().cast("array<string>").alias("languages"), none("string").alias("license"), none("timestamp").alias("created_at"), F.lit(now).alias("pushed_at"), F.lit(1).alias("contributors"), F.lit(1).alias("bus_factor"), F.lit(False).alias("archived"), F.create_map().cast("map<string,bigint>").alias("language_bytes"))


def archives(spark: SparkSession, path: str, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(tree, refused) of tar archives below path: a repository each, named as its file.

    The first folder of every name is dropped, and one that then wraps all files as well. tree:
    (repo_id, path, size, raw), raw null above 400,000 bytes. refused: (repo_id, status, why) of
    archives over `most` bytes, unreadable or empty ones; an archive is one task's work, file by file.
    """
    read = spark.read.format("binaryFile").load(path)
    repo = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(tar|tar\.gz|tgz)\z", "")
    fit = read.where(F.col("length") <= most).select(repo.alias("repo_id"), "content")

    def members(content: bytes) -> Iterator[tuple[str, int, str | None]]:
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            names = [m.name.split("/", 1)[1] for m in tar.getmembers() if m.isfile() and "/" in m.name]
        top = {n.split("/", 1)[0] if "/" in n else "" for n in names}
        wrapped = len(top) == 1 and "" not in top
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            for m in tar:
                if m.isfile() and "/" in m.name:
                    name = m.name.split("/", 2 if wrapped else 1)[-1]
                    body = tar.extractfile(m)
                    yield name, m.size, body.read().decode("utf-8", "replace") if body and m.size <= 400_000 else None

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo_id, content in zip(batch["repo_id"], batch["content"], strict=True):
                rows = 0
                try:
                    for name, size, raw in members(content):
                        rows += 1
                        yield pd.DataFrame({"repo_id": [repo_id], "path": [name], "size": [size], "raw": [raw]})
                except tarfile.TarError:
                    rows = 0
                if not rows:
                    yield pd.DataFrame({"repo_id": [repo_id], "path": [None], "size": [None], "raw": [None]})

    ship(spark)
    out = fit.mapInPandas(unpack, "repo_id string, path string, size long, raw string")
    bad = out.where("path is null").select("repo_id", F.lit(422).alias("status"), F.lit("empty or unreadable").alias("why"))
    large = read.where(F.col("length") > most).select(repo.alias("repo_id"), F.lit(413).alias("status"), F.lit("too large").alias("why"))
    return out.where("path is not null"), bad.unionByName(large)


def stored_jobs(spark: SparkSession, path: str) -> DataFrame:
    """JOB rows with seq, their place in a stored JSON array; none where nothing is stored."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{JOB}, seq long")
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.posexplode(F.from_json("value", f"array<struct<{JOB_FIELDS}>>")).alias("seq", "j"))
    return each.select("j.*", F.col("seq").cast("long").alias("seq"))


JOB_FIELDS = JOB.replace("struct<overall:int,grade:string>", "\0").replace(" ", ":").replace(",:", ",").replace("\0", "struct<overall:int,grade:string>")


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    """RESULT rows of stored documents, one JSON text a file or line."""
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").json(path)


def save_results(documents: DataFrame, path: str) -> None:
    """Writes documents (id, document as JSON text), each over the one of its id that was there.

    A document is a file of its own, so tasks share files out by number: by size, a few of them would take them all.
    """
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    documents.select("id", "document").repartition(tasks, F.xxhash64("id")).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("id").text(path)
