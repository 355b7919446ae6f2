"""The job machine as a stream against the same rows in batch, over restarts, with timers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from treegauge.operators import jobs as J
from treegauge.streaming import machine as M

UPDATES = "job_id long, seq long, status string, key string, finished timestamp, body string"


def told(seed=1, n=240, jobs=30):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        job = rng.randrange(jobs)
        out.append((job, seq, rng.choice(["queued", "running", "running", "done", "error"]), f"o/{job % 12}", None, f'{{"id":{job},"seq":{seq}}}'))
    return [(j, s, st, k, 86_400 * 19 + s * 700, b) for j, s, st, k, _, b in out]


def frame(spark, rows):
    return spark.createDataFrame(rows, UPDATES.replace("finished timestamp", "at long")).withColumn("finished", F.timestamp_seconds("at")).drop("at")


def landed(spark, df, folder):
    """Adds one file to a folder."""
    df.coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def parts(spark, tmp_path):
    rows = told()
    return rows, [frame(spark, rows[i : i + 80]) for i in (0, 80, 160)], tmp_path


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_transitions_over_restarts(spark, parts):
    rows, files, at = parts
    names = ("job_id", "seq", "was", "status", "allowed")
    for i, f in enumerate(files):
        landed(spark, f, at / "in")
        got = M.caught_up(M.transitions(M.files(spark, str(at / "in"), f.schema)), str(at / "out"), str(at / "check"))
        assert rows_of(got, *names) == rows_of(J.transitions(frame(spark, rows[: 80 * (i + 1)])), *names)
    again = M.caught_up(M.transitions(M.files(spark, str(at / "in"), files[0].schema)), str(at / "out"), str(at / "check"))
    assert again.count() == got.count()


def test_jobs_of_before_a_restart_fail(spark, tmp_path):
    saved = spark.createDataFrame([(1, 5, "running"), (2, 6, "queued"), (3, 7, "done")], "job_id long, seq long, status string")
    stream = lambda: M.transitions(M.files(spark, str(tmp_path / "in"), spark.createDataFrame([], UPDATES).schema), saved)
    for k, rows in enumerate(([(9, 1, "queued", "k", 0, "")], [(9, 2, "running", "k", 0, ""), (3, 7, "queued", "k", 0, ""), (None, 8, "done", "k", 0, "")])):
        landed(spark, frame(spark, rows), tmp_path / "in")
        got = rows_of(M.caught_up(stream(), str(tmp_path / "out"), str(tmp_path / "check")), "job_id", "seq", "was", "status", "allowed")
    assert got == sorted([(1, 5, "running", "error", True), (2, 6, "queued", "error", True), (9, 1, None, "queued", True), (9, 2, "queued", "running", True)], key=str)


def test_a_silent_job_fails(spark, tmp_path):
    stream = lambda: M.transitions(M.files(spark, str(tmp_path / "in"), spark.createDataFrame([], UPDATES).schema), patience_hours=1 / 3600)
    for rows in ([(1, 1, "queued", "k", 0, ""), (2, 1, "done", "k", 0, "")], [(5, 2, "queued", "k", 0, "")]):
        landed(spark, frame(spark, rows), tmp_path / "in")
        got = rows_of(M.caught_up(stream(), str(tmp_path / "out"), str(tmp_path / "check")), "job_id", "seq", "was", "status")
        time.sleep(1.5)
    assert got == sorted([(1, 1, None, "queued"), (1, 1, "queued", "error"), (2, 1, None, "done"), (5, 2, None, "queued")], key=str)


def test_admissions_equal_batch(spark, parts):
    rows, files, at = parts
    asked = spark.createDataFrame([(100 + i, f"https://github.com/o/{i % 15}" if i % 9 else "x", 86_400 * 20) for i in range(60)], "request_id long, address string, at long").select("request_id", "address", F.timestamp_seconds("at").alias("asked"))
    for f in files:
        landed(spark, f, at / "in")
    landed(spark, asked, at / "asked")
    got = M.caught_up(M.admissions(M.files(spark, str(at / "asked"), asked.schema), M.files(spark, str(at / "in"), files[0].schema)), str(at / "out"), str(at / "check"))
    want = J.enqueued(asked, J.latest(frame(spark, rows)), F.timestamp_seconds(F.lit(86_400 * 20)))
    names = ("request_id", "key", "job_id", "how")
    assert rows_of(got, *names) == rows_of(want, *names)
    assert {r.how for r in got.collect()} == {"attached", "cached", "new"}
    landed(spark, asked.limit(3).withColumn("request_id", F.col("request_id") + 900), at / "asked")  # keys are still known
    more = M.caught_up(M.admissions(M.files(spark, str(at / "asked"), asked.schema), M.files(spark, str(at / "in"), files[0].schema)), str(at / "out"), str(at / "check"))
    late = {r.request_id - 900: (r.key, r.job_id, r.how.replace("new", "attached")) for r in more.where("request_id >= 1000").collect()}
    assert len(late) == 3 and all(late[r.request_id] == (r.key, r.job_id, r.how.replace("new", "attached")) for r in want.collect() if r.request_id in late)


def plain_frames(saved, rows, watchers):
    out = []
    for watch, job in watchers:
        snap = saved.get(job)
        if snap is None:
            out.append((watch, job, 0, "missing", '{"error":"Job not found."}', True))
            continue
        over = snap[2] in M.TERMINAL
        out.append((watch, job, 0, "snapshot", f"data: {snap[5]}\n\n", over))
        for no, r in enumerate((r for r in rows if r[0] == job and r[1] > snap[1]), 1):
            if over:
                break
            over = r[2] in M.TERMINAL
            out.append((watch, job, no, "update", f"data: {r[5]}\n\n", over))
    return sorted(out, key=str)


def test_frames_over_restarts(spark, parts):
    rows, files, at = parts
    saved = {r[0]: r for r in rows[:80]}
    watchers = [(i, i % 40) for i in range(70)]
    asks = spark.createDataFrame(watchers, "watch_id long, job_id long")
    landed(spark, asks, at / "asks")
    table = frame(spark, list(saved.values())).select("job_id", "seq", "status", "body")
    for f in files:  # the first one is older than the snapshot
        landed(spark, f, at / "in")
        got = M.caught_up(M.frames(M.files(spark, str(at / "asks"), asks.schema), M.files(spark, str(at / "in"), f.schema), table, 3600), str(at / "out"), str(at / "check"))
    assert rows_of(got, "watch_id", "job_id", "no", "kind", "frame", "closed") == plain_frames(saved, rows, watchers)


def test_heartbeats_until_closed(spark, tmp_path):
    asks = spark.createDataFrame([(1, 7), (2, 8)], "watch_id long, job_id long")
    landed(spark, asks, tmp_path / "asks")
    saved = spark.createDataFrame([(7, 1, "running", "a"), (8, 1, "running", "b")], "job_id long, seq long, status string, body string")
    for rows in ([(9, 1, "queued", "k", 0, "")], [(7, 2, "done", "k", 0, "z")], [(9, 2, "done", "k", 0, "")]):
        landed(spark, frame(spark, rows), tmp_path / "in")
        stream = M.frames(M.files(spark, str(tmp_path / "asks"), asks.schema), M.files(spark, str(tmp_path / "in"), frame(spark, []).schema), saved, 0.5)
        got = M.caught_up(stream, str(tmp_path / "out"), str(tmp_path / "check"))
        time.sleep(1)
    of = {}
    for r in got.orderBy("watch_id", "no").collect():
        of.setdefault(r.watch_id, []).append((r.no, r.kind, r.closed))
    assert [x[1] for x in of[2]] == ["snapshot", "heartbeat", "heartbeat"] and [x[0] for x in of[2]] == [0, 1, 2]
    assert of[1][-1][1:] == ("update", True) or of[1][-2][1:] == ("update", True)
    assert sum(k == "heartbeat" for _, k, _ in of[1]) <= 1
