"""The job machine as keyed state: transitions, admissions and the frames pushed to watchers, with timers.

Each operator takes streams and gives a stream. State is kept per job or per queue key, in RocksDB, and expires `ttl_hours`
after it was last written, so it is bounded by what is alive, not by what was ever seen. Updates of one
job are taken in the order of seq within a batch; an update that isn't later than the last one seen is
stale and changes nothing.

Nulls: updates without job_id or seq, and requests without address, are dealt with like in batch: the first
are left out, the second have the key unknown/unknown. Empty streams give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from treegauge.operators import jobs as J
from treegauge.workers import ship

HOUR = 3_600_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("done", "error")


class _Transitions(StatefulProcessor):
    """See transitions()."""

    def __init__(self, patience: int | None, ttl: int) -> None:
        self.patience, self.ttl = patience, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, seq long", self.ttl)

    def wait(self, status: str | None, until: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status in J.IN_FLIGHT and until is not None:
            self.handle.registerTimer(until)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        # what a process of before left in flight has failed: its timer is due at once
        self.last.update((initialState["status"], initialState["seq"]))
        self.wait(initialState["status"], timerValues.getCurrentProcessingTimeInMs())

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was, at = self.last.get() if self.last.exists() else (None, None)
        first = at
        for seq, status in sorted((r["seq"], r["status"]) for r in rows):
            if at is None or seq > at:
                if status != was:
                    yield Row(job_id=key[0], seq=seq, was=was, status=status, allowed=(was, status) in J.FOLLOWS)
                was, at = status, seq
        if at != first:
            self.last.update((was, at))
            self.wait(was, None if self.patience is None else timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            was, at = self.last.get()
            if was in J.IN_FLIGHT:
                self.last.update(("error", at))
                yield Row(job_id=key[0], seq=at, was=was, status="error", allowed=(was, "error") in J.FOLLOWS)


def transitions(updates: DataFrame, saved: DataFrame | None = None, patience_hours: float | None = None, ttl_hours: float = 24 * 7) -> DataFrame:
    """A stream (job_id, seq, was, status, allowed) of changes of status, of a stream of updates (job_id long, seq long, status).

    saved (job_id, seq, status): jobs of before a restart; those in flight fail at once, with their last
    seq. patience_hours: so long after its last update a job in flight fails too. Both are timers that expire.
    """
    ship(updates.sparkSession)
    rows = updates.where("job_id is not null and seq is not null").select(F.col("job_id").cast("long").alias("job_id"), F.col("seq").cast("long").alias("seq"), "status")
    before = saved.select(F.col("job_id").cast("long").alias("job_id"), F.col("seq").cast("long").alias("seq"), "status").groupBy("job_id") if saved is not None else None
    machine = _Transitions(None if patience_hours is None else int(patience_hours * HOUR), int(ttl_hours * HOUR))
    return rows.groupBy("job_id").transformWithState(machine, "job_id long, seq long, was string, status string, allowed boolean", "Append", "ProcessingTime", before)


class _Admissions(StatefulProcessor):
    """See admissions()."""

    def __init__(self, hours: int) -> None:
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "job_id long", "seq long, status string, finished long", self.hours * HOUR)
        self.asked = handle.getValueState("asked", "request_id long", self.hours * HOUR)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, changed = None, {}
        for r in sorted(rows, key=lambda r: (r["request_id"] is not None, r["seq"] if r["request_id"] is None else r["request_id"])):
            if known is None:
                known = {k[0]: tuple(v) for k, v in self.jobs.iterator()}
            if r["request_id"] is None:
                if r["job_id"] not in known or known[r["job_id"]][0] < r["seq"]:
                    known[r["job_id"]] = changed[r["job_id"]] = (r["seq"], r["status"], r["at"])
                continue
            flight = min((j for j, x in known.items() if x[1] in J.IN_FLIGHT), default=None)
            done = max(((x[2], j) for j, x in known.items() if x[1] == "done" and x[2] is not None and x[2] > r["at"] - self.hours * HOUR * 1000), default=None)
            how = "attached" if flight is not None else "cached" if done is not None else "attached" if self.asked.exists() else "new"
            if how == "new":
                self.asked.update((r["request_id"],))
            yield Row(request_id=r["request_id"], key=key[0], job_id=flight if flight is not None else done[1] if done else None, how=how)
        for job, x in changed.items():
            self.jobs.updateValue((job,), x)


def admissions(requests: DataFrame, updates: DataFrame, hours: int = 24) -> DataFrame:
    """A stream (request_id, key, job_id, how) like jobs.enqueued(), of streams of requests (request_id, address, asked timestamp) and of updates (job_id, seq, status, key, finished timestamp).

    Updates of a batch come before its requests. A key's jobs and its first request are forgotten
    `hours` after they were written, which is how long a result may be served.
    """
    ship(requests.sparkSession)
    none = F.lit(None).cast("long")
    # timestamps without a zone can't be compared to a clock; as microseconds both kinds can
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = requests.select(J.queue_key(F.col("address")).alias("key"), F.col("request_id").cast("long").alias("request_id"), none.alias("job_id"), none.alias("seq"), F.lit(None).cast("string").alias("status"), micros("asked").alias("at"))
    told = updates.where("job_id is not null and seq is not null").select("key", none.alias("request_id"), F.col("job_id").cast("long").alias("job_id"), F.col("seq").cast("long").alias("seq"), "status", micros("finished").alias("at"))
    return asked.where("request_id is not null").unionByName(told).groupBy("key").transformWithState(_Admissions(hours), "request_id long, key string, job_id long, how string", "Append", "ProcessingTime")


class _Frames(StatefulProcessor):
    """See frames()."""

    def __init__(self, heartbeat: int, ttl: int) -> None:
        self.heartbeat, self.ttl = heartbeat, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, status string, body string", self.ttl)
        self.open = handle.getMapState("open", "watch_id long", "sent int", self.ttl)

    def rest(self, timerValues) -> None:
        """One timer while anyone watches."""
        timers = list(self.handle.listTimers())
        watched = next(iter(self.open.keys()), None) is not None
        for t in timers if not watched else ():
            self.handle.deleteTimer(t)
        if watched and not timers:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.heartbeat)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = tuple(self.last.get()) if self.last.exists() else None
        watching = {k[0]: v[0] for k, v in self.open.iterator()}
        row = lambda watch, no, kind, body, closed: Row(watch_id=watch, job_id=key[0], no=no, kind=kind, frame=body, closed=closed)
        data = lambda body: f"data: {body}\n\n"
        begun, before = last, set(watching)
        for r in sorted(rows, key=lambda r: (r["watch_id"] is None, r["watch_id"] or 0, r["seq"] or 0)):
            if r["watch_id"] is not None:
                if r["seq"] is not None and (last is None or last[0] < r["seq"]):
                    last = (r["seq"], r["status"], r["body"])
                if r["watch_id"] in watching:
                    continue
                if last is None:
                    yield row(r["watch_id"], 0, "missing", '{"error":"Job not found."}', True)
                    continue
                over = last[1] in TERMINAL
                yield row(r["watch_id"], 0, "snapshot", data(last[2]), over)
                if not over:
                    watching[r["watch_id"]] = 1
            elif last is None or r["seq"] > last[0]:
                last = (r["seq"], r["status"], r["body"])
                over = last[1] in TERMINAL
                for watch, no in sorted(watching.items()):
                    yield row(watch, no, "update", data(last[2]), over)
                    watching[watch] = no + 1
                if over:
                    watching = {}
        if last is not None and last != begun:
            self.last.update(last)
        for watch in before - set(watching):
            self.open.removeKey((watch,))
        for watch, no in watching.items():
            self.open.updateValue((watch,), (no,))
        self.rest(timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for (watch,), (no,) in sorted((tuple(k), tuple(v)) for k, v in self.open.iterator()):
            yield Row(watch_id=watch, job_id=key[0], no=no, kind="heartbeat", frame=": hb\n\n", closed=False)
            self.open.updateValue((watch,), (no + 1,))
        if next(iter(self.open.keys()), None) is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.heartbeat)


def frames(watchers: DataFrame, updates: DataFrame, saved: DataFrame, heartbeat_seconds: float = 15, ttl_hours: float = 24) -> DataFrame:
    """A stream (watch_id, job_id, no, kind, frame, closed) of what each watcher is sent, in the order of no.

    watchers: a stream (watch_id, job_id); updates: a stream (job_id, seq, status, body), body a JSON
    text; saved: a table of the same columns, one row a job, the snapshot. A watcher gets the later of the snapshot and the last update seen,
    then every later update until one is terminal, which closes; and a heartbeat while
    nothing closes it. A watcher of a job that nobody knows gets one answer that says so. A
    watcher that asks again while it is open gets nothing anew.
    """
    ship(watchers.sparkSession)
    id_ = lambda c: F.col(c).cast("long").alias(c)
    known = saved.select(id_("job_id"), id_("seq"), "status", "body")
    asks = watchers.select(id_("watch_id"), id_("job_id")).where("watch_id is not null").join(known, "job_id", "left").select("watch_id", "job_id", "seq", "status", "body")
    told = updates.where("job_id is not null and seq is not null").select(F.lit(None).cast("long").alias("watch_id"), id_("job_id"), id_("seq"), "status", "body")
    return asks.unionByName(told).groupBy("job_id").transformWithState(_Frames(int(heartbeat_seconds * 1000), int(ttl_hours * HOUR)), "watch_id long, job_id long, no int, kind string, frame string, closed boolean", "Append", "ProcessingTime")


def files(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """Parquet files at a path as a stream. A stream's own path must be a folder, a pattern may be of one file."""
    return spark.readStream.schema(schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def caught_up(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that its sources hold now, appends to Parquet files at out, and gives all that is there.

    With the same checkpoint the next call goes on from there: what was taken isn't taken again, and what
    was written is written once. Timers that are due fire in the batch that brings rows.
    """
    spark = stream.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    held = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(out)
