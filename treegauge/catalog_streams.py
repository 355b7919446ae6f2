"""Reference queries of the job machine as streams over whole tables, each with DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegauge.scratch import folder
from treegauge.streaming import machine as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


STATUS = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'error' ELSE 'done' END"


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    return M.files(spark, path, spark.read.parquet(path).schema)


def all_of(rows: DataFrame) -> DataFrame:
    at = f"{folder(rows.sparkSession)}/treegauge/{uuid.uuid4().hex}"
    return M.caught_up(rows, f"{at}/out", f"{at}/checkpoint")


@query(f"""SELECT job_id, seq, was, status, coalesce((was IS NULL AND status IN ('queued', 'done')) OR was || '>' || status IN ('queued>running', 'queued>error', 'running>done', 'running>error'), false) AS allowed
FROM (SELECT job_id, seq, status, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS was FROM (SELECT user_id * 10 + event_id % 10 AS job_id, event_id AS seq, {STATUS} AS status FROM events)) WHERE was IS DISTINCT FROM status""")
def job_machine_stream(spark, d):
    """Changes of status of all jobs, from events as a stream."""
    e = stream(spark, d, "events").select(F.expr("user_id * 10 + event_id % 10").alias("job_id"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"))
    return all_of(M.transitions(e))


KEYED = f"(SELECT *, 'o/' || (job_id % 701) AS key FROM (SELECT user_id * 10 + event_id % 10 AS job_id, max(event_id) AS seq, arg_max({STATUS}, event_id) AS status, max(ts) AS finished FROM events GROUP BY 1))"
ASKED = "(SELECT c_custkey AS request_id, CASE WHEN c_custkey % 11 = 0 THEN c_name ELSE 'o/' || (c_custkey * 7 % 701) END AS key FROM customer)"


@query(f"""WITH f AS (SELECT key, min(job_id) AS flight FROM {KEYED} WHERE status IN ('queued', 'running') GROUP BY 1),
c AS (SELECT key, arg_max(job_id, struct_pack(f := finished, j := job_id)) AS cached FROM {KEYED} WHERE status = 'done' AND finished > TIMESTAMP '2024-01-12' GROUP BY 1),
a AS (SELECT request_id, CASE WHEN key LIKE 'o/%' THEN key ELSE 'unknown/unknown' END AS key FROM {ASKED})
SELECT request_id, key, coalesce(flight, cached) AS job_id, CASE WHEN flight IS NOT NULL THEN 'attached' WHEN cached IS NOT NULL THEN 'cached' WHEN request_id = min(request_id) OVER (PARTITION BY key) THEN 'new' ELSE 'attached' END AS how FROM a LEFT JOIN f USING (key) LEFT JOIN c USING (key)""")
def job_admission_stream(spark, d):
    """What requests of all customers get from the jobs of all events: attached, cached or new."""
    key = F.concat(F.lit("o/"), (F.col("job_id") % 701).cast("string"))
    e = stream(spark, d, "events").select(F.expr("user_id * 10 + event_id % 10").alias("job_id"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"), F.col("ts").alias("finished")).withColumn("key", key)
    address = F.when(F.col("c_custkey") % 11 == 0, F.col("c_name")).otherwise(F.concat(F.lit("https://github.com/o/"), (F.col("c_custkey") * 7 % 701).cast("string")))
    asked = stream(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), address.alias("address"), F.expr("TIMESTAMP '2024-01-13'").alias("asked"))
    return all_of(M.admissions(asked, e))


HALF = "TIMESTAMP '2024-01-15'"
TOLD = f"(SELECT user_id * 10 + event_id % 10 AS job_id, event_id AS seq, {STATUS} AS status, ts < {HALF} AS old FROM events)"
BODY = "printf('{{\"id\":%d,\"seq\":%d,\"status\":\"%s\"}}', job_id, seq, status)"


@query(f"""WITH told AS (SELECT *, {BODY.replace("{{", "{").replace("}}", "}")} AS body FROM {TOLD}),
saved AS (SELECT job_id, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(body, seq) AS body FROM told WHERE old GROUP BY 1),
later AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS no FROM told WHERE NOT old),
ended AS (SELECT job_id, min(no) AS last FROM later WHERE status IN ('done', 'error') GROUP BY 1),
asks AS (SELECT c_custkey AS watch_id, c_custkey AS job_id FROM customer)
SELECT watch_id, a.job_id, 0 AS no, CASE WHEN seq IS NULL THEN 'missing' ELSE 'snapshot' END AS kind, CASE WHEN seq IS NULL THEN '{{"error":"Job not found."}}' ELSE 'data: ' || body || chr(10) || chr(10) END AS frame, seq IS NULL OR status IN ('done', 'error') AS closed FROM asks a LEFT JOIN saved USING (job_id)
UNION ALL SELECT watch_id, a.job_id, CAST(no AS INTEGER), 'update', 'data: ' || l.body || chr(10) || chr(10), l.status IN ('done', 'error') FROM asks a JOIN saved s USING (job_id) JOIN later l USING (job_id) LEFT JOIN ended USING (job_id) WHERE s.status IN ('queued', 'running') AND (last IS NULL OR no <= last)""")
def job_frames_stream(spark, d):
    """What a watcher for every customer is sent: the snapshot of its job, then updates until one closes."""
    told = F.format_string('{"id":%d,"seq":%d,"status":"%s"}', "job_id", "seq", "status").alias("body")
    read = lambda e: e.select(F.expr("user_id * 10 + event_id % 10").alias("job_id"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"), F.expr(f"ts < {HALF}").alias("old")).withColumn("body", told)
    saved = read(spark.read.parquet(f"{d}/events.parquet")).where("old").groupBy("job_id").agg(F.max(F.struct("seq", "status", "body")).alias("x")).select("job_id", "x.*")
    asks = stream(spark, d, "customer").select(F.col("c_custkey").alias("watch_id"), F.col("c_custkey").alias("job_id"))
    # no heartbeat falls into a run of minutes
    return all_of(M.frames(asks, read(stream(spark, d, "events")).where("not old"), saved, heartbeat_seconds=86_400))
