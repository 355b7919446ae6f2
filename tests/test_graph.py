"""Cycles of graphs of any size against the small graphs' algorithm."""

import random

import pytest
from pyspark.sql import functions as F

from treegauge import catalog_graphs
from treegauge.operators import graph as G
from treegauge.operators import imports as I


def plain(rows):
    out = []
    for repo in {r[0] for r in rows}:
        for group in G.strongly_connected([], [(a, b) for r, a, b in rows if r == repo and a and b]):
            out += [(repo, group[0], n) for n in group]
    return sorted(out)


@pytest.mark.parametrize("small", [0, 25])
def test_strong_components_of_random_graphs(spark, small):
    rng = random.Random(small)
    rows = []
    for repo in range(12):
        n = rng.randint(2, 40)
        rows += [(repo, f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(int(n * rng.uniform(0.7, 1.6)))]
    rows += [(1, None, "n01"), (1, "n01", None), (2, "x", "x")]
    got = G.strong_components(spark.createDataFrame(rows, "repo_id long, src string, dst string"), small)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_strong_components_of_chains_rings_and_nothing(spark):
    ring = [("r", f"{i:04}", f"{(i + 1) % 60:04}") for i in range(60)]
    chain = [("c", f"{i:04}", f"{i + 1:04}") for i in range(40)]
    two = [("t", "a", "b"), ("t", "b", "a"), ("t", "b", "c"), ("t", "c", "d"), ("t", "d", "c"), ("t", "a", "b")]
    got = G.strong_components(spark.createDataFrame(ring + chain + two, "repo_id string, src string, dst string"), 0)
    assert sorted(map(tuple, got.collect())) == plain(ring + chain + two)
    assert G.strong_components(spark.createDataFrame([], "repo_id string, src string, dst string")).count() == 0


def test_small_graphs_share_calls_of_python(spark):
    rows = [(i % 700, f"n{i % 3}", f"n{(i + 1) % 3}") for i in range(2100)] + [(None, "a", "b"), (None, "b", "a")]
    got = G.cycles(spark.createDataFrame(rows, "repo_id long, src string, dst string").repartition(3))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    want = [(*x[:2], n) for r in {x[0] for x in rows} for g in G.strongly_connected([], [x[1:] for x in rows if x[0] == r]) for x, n in [((r, g[0]), n) for n in g]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_labels_are_numbers(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (9, 5), (1, 7), (7, 8), (2, 8)], "a long, b long")
    assert {r.node: r.label for r in G._spread(edges).collect()} == {5: 3, 3: 3, 9: 3, 1: 1, 7: 1, 8: 1, 2: 2}


def test_modules_are_worked_out_once_an_edge(spark):
    rows = [("r", "src/a/x.ts", "src/b/y.ts", 2), ("r", "src/a/z.ts", "src/b/y.ts", 3), ("r", "src/a/x.ts", "src/a/z.ts", 7), ("r", "x.ts", "docs/a/b.ts", 1), ("r", None, "x.ts", 1), ("r", "src/x.ts", "/x.ts", 1)]
    got = I.module_edges(spark.createDataFrame(rows, "repo_id string, src string, dst string, weight long").repartition(2))
    assert sorted(tuple(r) for r in got.collect()) == [("r", "(root)", "docs", 1), ("r", "src", "", 1), ("r", "src/a", "src/b", 5)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("(root)") == 2


def test_paths_of_large_graphs(spark):
    keys = [0, 96, 97, 12345, 99_999_999, 123_456_789]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select(F.expr(catalog_graphs._path("k")).alias("p")).collect()
    assert [r.p for r in got] == [f"src/m{k % 97:02d}/f{k:08d}.ts" for k in keys]


def test_limited_modules_sums_no_file_edges(spark):
    plan = catalog_graphs.limited_modules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # the only counts and sums over references are those between modules
    assert "Aggregate [repo_id" in plan
    assert "count(1)" not in plan
