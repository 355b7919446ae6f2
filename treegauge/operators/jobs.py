"""Operators over job updates (job_id, seq, status, created, finished) and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegauge.functions import rules as R

IN_FLIGHT = ("queued", "running")
WORKERS = 2
#: (status before, status after) of allowed changes.
FOLLOWS = {(None, "queued"), (None, "done"), ("queued", "running"), ("queued", "error"), ("running", "done"), ("running", "error")}


def latest(updates: DataFrame) -> DataFrame:
    """The last update of each job: a map-side aggregate, no sort of a job's updates."""
    rest = [c for c in updates.columns if c != "job_id"]
    return updates.groupBy("job_id").agg(F.max_by(F.struct(*rest), "seq").alias("x")).select("job_id", "x.*")


def retained(jobs: DataFrame, most: int = 200) -> DataFrame:
    """The jobs that were written last."""
    return jobs.orderBy(F.desc("seq")).limit(most)


def saved(jobs: DataFrame, updates: DataFrame, most: int = 200) -> DataFrame:
    """jobs after updates of the same columns, whose seq are later: one row a job, the last written ones."""
    return retained(latest(jobs.unionByName(updates)), most)


def oldest_queued(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy("created", "job_id").limit(1)


def started(jobs: DataFrame, workers: int = WORKERS) -> DataFrame:
    """The queued jobs that free workers take, the oldest first."""
    busy = jobs.agg(F.sum(F.when(F.col("status") == "running", 1).otherwise(0)).alias("busy"))
    first = jobs.where("status = 'queued'").orderBy("created", "job_id").limit(workers)
    k = first.withColumn("k", F.row_number().over(Window.orderBy("created", "job_id")))
    # one row on the right, and at most as many as workers on the left
    return k.join(F.broadcast(busy), F.col("k") <= workers - F.coalesce("busy", F.lit(0))).drop("k", "busy")


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart jobs that were queued or running have failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*IN_FLIGHT), "error").otherwise(F.col("status")))


def transitions(updates: DataFrame) -> DataFrame:
    """(job_id, seq, was, status, allowed): changes of status; only queued, running, done or error follow in this order."""
    w = Window.partitionBy("job_id").orderBy("seq")
    x = updates.select("job_id", "seq", F.lag("status").over(w).alias("was"), "status").where(F.col("was").isNull() | (F.col("was") != F.col("status")))
    pair = lambda c: F.concat_ws(">", F.coalesce(c, F.lit("")), "status")
    fine = pair(F.col("was")).isin(*sorted(f"{was or ''}>{status}" for was, status in FOLLOWS))
    return x.withColumn("allowed", F.coalesce(fine, F.lit(False)))


def queue_key(address: Column) -> Column:
    """owner/repo as the queue reads it; anything that isn't a whole address is unknown/unknown."""
    part = lambda i: F.regexp_extract(address, R.QUEUE_URL, i)
    return F.when(address.rlike(R.QUEUE_URL), F.concat_ws("/", part(1), F.regexp_replace(part(2), r"\.git\z", ""))).otherwise("unknown/unknown")


def enqueued(requests: DataFrame, jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(request_id, key, job_id, how) for requests (request_id, address), against jobs (job_id, key, status, finished).

    A request attaches to the job of its key in flight, else to the last result not older than
    `hours`, else to the first request of its key, which becomes a new job.
    """
    asked = requests.select("request_id", queue_key(F.col("address")).alias("key"))
    flight = jobs.where(F.col("status").isin(*IN_FLIGHT)).groupBy("key").agg(F.min("job_id").alias("flight"))
    cached = fresh(jobs, now, hours).groupBy("key").agg(F.max_by("job_id", F.struct("finished", "job_id")).alias("cached"))
    first = asked.groupBy("key").agg(F.min("request_id").alias("first"))
    x = asked.join(flight, "key", "left").join(cached, "key", "left").join(first, "key")
    how = F.when(F.col("flight").isNotNull(), "attached").when(F.col("cached").isNotNull(), "cached").when(F.col("request_id") == F.col("first"), "new").otherwise("attached")
    return x.select("request_id", "key", F.coalesce("flight", "cached").alias("job_id"), how.alias("how"))


def created(admitted: DataFrame, now: Column) -> DataFrame:
    """Jobs (job_id, key, status, created) for the new ones of enqueued(), with random ids: write them once, since ids differ in every run."""
    return admitted.where("how = 'new'").select(F.uuid().alias("job_id"), "key", F.lit("queued").alias("status"), now.alias("created"))


def fresh(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return jobs.where((F.col("status") == "done") & (F.col("finished") > now - F.expr(f"INTERVAL {hours} HOURS")))


def recent(jobs: DataFrame, results: DataFrame, most: int = 8) -> DataFrame:
    """The done jobs that finished last, then those of them with a result."""
    return jobs.where("status = 'done'").orderBy(F.desc("finished"), F.desc("job_id")).limit(most).join(results, "job_id")


def resolved(ids: DataFrame, results: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, result_id): ids that are of a result themselves, else of a job (job_id, result_id) with one; null where neither."""
    have = results.select("result_id").distinct()
    direct = have.select(F.col("result_id").alias("id"), F.col("result_id").alias("direct"))
    through = jobs.select(F.col("job_id").alias("id"), "result_id").join(have, "result_id", "left_semi").groupBy("id").agg(F.max("result_id").alias("through"))
    return ids.join(direct, "id", "left").join(through, "id", "left").select("id", F.coalesce("direct", "through").alias("result_id"))


def bus_factor(people: DataFrame) -> DataFrame:
    """(repo_id, bus_factor): the fewest contributors (repo_id, who, n) with half of all contributions."""
    w = Window.partitionBy("repo_id")
    by = w.orderBy(F.desc("n"), "who")
    run = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))
    ranked = people.select("repo_id", F.row_number().over(by).alias("place"), run.alias("run"), F.sum("n").over(w).alias("total"))
    return ranked.where(F.col("run") * 2 >= F.col("total")).groupBy("repo_id").agg(F.min("place").cast("long").alias("bus_factor"))
