"""Views of stored results, ranked functions, ids of new jobs and landed answers."""

import pytest
from pyspark.sql import functions as F

from treegauge import catalog_trees
from treegauge.functions import text as T
from treegauge.operators import jobs as J
from treegauge.plans import audit, outputs
from treegauge.sources import landed as LA


def test_overview_cuts_cycles_and_dependencies(spark):
    deps = ",".join(f'{{"name":"d{i}","version":"1","ecosystem":"npm","vulns":[{",".join(["{}"] * (i + 1))}]}}' for i in range(12))
    text = f'{{"id":"r","architecture":{{"cycles":[{",".join(f"""["a{i}","b{i}"]""" for i in range(6))}]}},"vulnerableDeps":[{deps}]}}'
    r = spark.createDataFrame([(text,), ('{"id":"none"}',)], "t string").select(F.from_json("t", LA.RESULT).alias("r")).select("r.*")
    got = outputs.overview(r).collect()
    assert [(x.place, x.text) for x in got if x.part == "cycle"] == [(i + 1, f"a{i} > b{i}") for i in range(4)]
    assert [(x.place, x.text) for x in got if x.part == "dependency"] == [(i + 1, f"d{i}@1 {i + 1}") for i in range(10)]


def test_functions_by_complexity(spark):
    rows = [("r", "b.py", 1, 3), ("r", "a.py", 9, 3), ("r", "a.py", 2, 3), ("r", "c.py", 1, 7), ("s", "x.py", 1, 1)]
    got = audit.by_complexity(spark.createDataFrame(rows, "repo_id string, path string, line int, complexity int")).collect()
    assert [(x.path, x.line) for x in sorted(got, key=lambda x: (x.repo_id, x.place))] == [("c.py", 1), ("a.py", 2), ("a.py", 9), ("b.py", 1), ("x.py", 1)]


def test_new_jobs_have_ids_of_their_own(spark):
    asked = spark.createDataFrame([(i, f"o/{i}", None, "new" if i % 2 else "attached") for i in range(40)], "request_id long, key string, job_id long, how string")
    got = J.created(asked, F.current_timestamp()).collect()
    assert len({x.job_id for x in got}) == 20 and all(len(x.job_id) == 36 and x.status == "queued" for x in got)


def test_answers(spark):
    rows = [("a", "repo", 200, 1, '{"name":"a"}'), ("a", "languages", 200, 1, '{"Go":5}'), ("a", "contributors", 500, 1, "oops"), ("b", "repo", 404, 1, None), ("c", "repo", None, None, None), ("d", "languages", 200, 1, "{}"), ("e", "repo", 500, 1, "x"), ("e", "repo", 200, 1, "y"), ("f", "repo", 429, 0, "x")]
    fine, bad = LA.answers(spark.createDataFrame(rows, "repo_id string, what string, status int, remaining int, body string"))
    assert sorted(map(tuple, fine.collect())) == [("a", '{"name":"a"}', '{"Go":5}', None), ("e", "y", None, None)]
    assert sorted((r.repo_id, r.error) for r in bad.collect()) == [("b", "missing"), ("c", "unreachable"), ("d", "missing"), ("f", "limit")]
    meta = LA.repo_meta(fine).collect()
    assert {(r.repo_id, r.name, tuple(r.languages)) for r in meta} == {("a", "a", ("Go",)), ("e", None, ())}


def test_thousands_round_as_the_double_stands(spark):
    values = [*range(990, 4000), *range(99_900, 100_100), 1_049_950, 2**53 + 50, 10**15 + 50, 10**17 + 950, None, 0, -1450]
    got = spark.createDataFrame([(v,) for v in values], "n long").select("n", T.thousands(F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == [None if v is None else f"{float(v) / 1000:.1f}k" if v >= 1000 else str(v) for v in values]


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(18,0)"])
def test_score_bands_against_duckdb_whatever_number_an_id_is(spark, tmp_path, kind):
    import duckdb

    # user u: one event, whose id is u; every tie between 1 and 40 thousand, and short ids
    ids = spark.range(0, 40_000, 50).unionAll(spark.range(995, 1006)).distinct()
    ids.select(F.col("id").cast(kind).alias("event_id"), F.col("id").alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog_trees.ORACLES["score_bands"])
    columns = [c[0] for c in want.description]
    got = catalog_trees.QUERIES["score_bands"](spark, str(tmp_path)).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize(
    "ids",
    [
        *[f"CAST({n} AS {kind})" for kind in ("DOUBLE", "DECIMAL(18,1)") for n in ("e * 0.5", "-e * 0.5", "1000 + e * 99.5")],
        "CASE e % 3 WHEN 0 THEN 9000000000000000000 WHEN 1 THEN 9000000000000000001 ELSE -9000000000000000000 END - e % 3",
        "CASE WHEN e % 2 = 0 THEN CAST(e * 950 AS INTEGER) END",
    ],
)
def test_score_bands_add_and_round_ids_as_duckdb_does(spark, tmp_path, ids):
    import duckdb

    # halves that go to either side, signs, sums that leave BIGINT on their way, and missing ids
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT e // 3 AS user_id, {ids} AS event_id FROM range(300) t(e)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(catalog_trees.ORACLES["score_bands"])
    columns = [c[0] for c in want.description]
    got = catalog_trees.QUERIES["score_bands"](spark, str(tmp_path)).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
