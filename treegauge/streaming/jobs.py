"""Job updates as a stream, an extension: the last update of each job, counts by window, and pushed updates."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(updates: DataFrame) -> DataFrame:
    """The last update of each job of a stream (job_id, seq, status), for an update or complete sink."""
    return updates.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def finished_by_hour(updates: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, status, n) of a stream (ts timestamp, status); updates later than `late` are left out, so state stays bounded."""
    return updates.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").start.alias("hour"), "status").agg(F.count(F.lit(1)).alias("n"))


def pushed(updates: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, jobs: Iterable | None = None) -> StreamingQuery:
    """Starts a query that hands every batch's last update of each job (of the given jobs, or of all) to deliver."""
    some = updates if jobs is None else updates.where(F.col("job_id").isin(*jobs))
    return some.writeStream.foreachBatch(lambda batch, i: deliver(latest(batch), i)).option("checkpointLocation", checkpoint).start()


def awaited(updates: DataFrame, jobs: list, checkpoint: str) -> dict:
    """The final status of each of a few jobs: reads what there is of the stream, and ends when all are done or failed, or nothing is left."""
    seen: dict = {}

    def note(batch: DataFrame, _: int) -> None:
        for r in batch.collect():  # a row for each of the jobs asked for, at most
            seen[r["job_id"]] = max(seen.get(r["job_id"], (-1, "")), (r["seq"], r["status"]))

    q = pushed(updates, note, checkpoint, jobs)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return {job: status for job, (_, status) in seen.items() if status in ("done", "error")}
