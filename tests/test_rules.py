"""Path, text and score rules on inline rows."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treegauge.functions import text as T
from treegauge.operators import files as O
from treegauge.operators import graph as G
from treegauge.operators import jobs as J
from treegauge.operators import secrets as S
from treegauge.plans import health, scoring


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("path", "want"), [("src/a.test.ts", True), ("tests/a.py", True), ("src/latest/a.py", False), ("test_x.py", True), ("a/b.py", False), ("jest.config.js", True)])
def test_is_test(spark, path, want):
    assert one(spark, path, T.is_test) is want


@pytest.mark.parametrize(("path", "want"), [("a/node_modules/b.js", True), ("dist/x.js", True), ("src/x.min.js", True), ("src/dist.js", False), ("Pods/a.m", False)])
def test_is_ignored(spark, path, want):
    assert one(spark, path, T.is_ignored) is want


@pytest.mark.parametrize(("path", "want"), [("a.py", "(root)"), ("src/a.py", "src"), ("src/x/a.py", "src/x"), ("docs/x/a.md", "docs")])
def test_module_of(spark, path, want):
    assert one(spark, path, T.module_of) == want


@pytest.mark.parametrize(("value", "want"), [("aabb", 1.0), ("abcd", 2.0), ("", 0.0)])
def test_entropy(spark, value, want):
    assert one(spark, value, T.entropy) == pytest.approx(want)


def test_secrets_and_test_path_downgrade(spark):
    key = "AK" + "IA" + "Q7RTZ2MN5PLW9XKC"  # made at run time: no token stands in the source
    rows = [(1, "src/a.ts", f'k = "{key}"'), (1, "tests/a.ts", 'token = "zT9q-LmW4v-xR7bN"'), (1, "src/b.ts", 'password = "changeme-now"'), (1, "src/c.ts", 'secret = "zT9qLmW4vxR7bN" || process.env.S')]
    found = S.secret_findings(S.secret_matches(spark.createDataFrame(rows, "repo_id int, path string, raw string"))).collect()
    assert {(r.pattern, r.n, r.severity) for r in found} == {("security.awskeys", 1, "critical"), ("security.generic", 1, "minor")}


def test_clones(spark):
    body = "\n".join(f"value_{i} = compute(total, {i})" for i in range(8))
    f = spark.createDataFrame([(1, "a", body), (1, "b", "head_line_here = 1\n" + body)], "repo_id int, path string, raw string")
    groups = O.clone_groups(f).collect()
    assert len(groups) == 2 and {g.n for g in groups} == {2} and {g.first_line for g in groups} == {1, 2}
    r = O.clone_ratio(f).first()
    assert (r.eligible, r.duplicated) == (17, 14)


def test_scores(spark):
    rows = [(1, "a", "security", "critical", 30), (1, "b", "security", "critical", 30), (1, "documentation.readme", "documentation", "critical", 30), (2, "c", "quality", "minor", 4)]
    s = scoring.category_scores(spark.createDataFrame(rows, "repo_id int, id string, category string, severity string, penalty int"))
    assert {(r.repo_id, r.category, r.score) for r in s.collect()} == {(1, "security", 35), (1, "documentation", 12), (2, "quality", 96)}
    assert {(r.repo_id, r.overall, r.grade) for r in scoring.overall(s).collect()} == {(1, 71, "C"), (2, 99, "A+")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_components_are_mutual_reachability(edges):
    reach = {a: {a} for a in range(8)}
    for _ in range(8):
        for a, b in edges:
            for r in reach.values():
                if a in r:
                    r.add(b)
    want = {tuple(sorted(b for b in reach if b in reach[a] and a in reach[b])) for a in reach}
    assert {tuple(g) for g in G.strongly_connected([], edges)} == {w for w in want if len(w) > 1}


def test_jobs(spark):
    u = spark.createDataFrame([(1, 1, "queued"), (1, 2, "done"), (2, 3, "queued")], "job_id int, seq int, status string")
    assert {(r.job_id, r.status) for r in J.latest(u).collect()} == {(1, "done"), (2, "queued")}
    p = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (1, "c", 3)], "repo_id int, who string, n int")
    assert J.bus_factor(p).first().bus_factor == 2


def test_health_report(spark):
    rows = [(1, "README.md", "hello", 1, False), (1, "src/a.py", "x = 1\ny = 2", 2, False), (1, "tests/t.py", "\n" * 9, 10, True)]
    r = health.report(spark.createDataFrame(rows, "repo_id int, path string, raw string, lines long, is_test boolean")).first()
    assert (r.files, r.loc, r.overall, r.grade) == (3, 13, 100, "A+")
    assert math.isclose(r.overall, 100)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "repo_id int, path string, raw string, lines long, is_test boolean")
    assert health.report(empty).count() == 0
