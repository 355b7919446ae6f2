"""Trees that are larger than the limits audits once had: every file, text and module counts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from test_audit import ADVICE, BRANCHY, SAME
from test_catalog import DATA, ORACLES, QUERIES, rows
from treegauge.plans import architecture as A
from treegauge.plans import audit, outputs, scoring
from treegauge.sources import landed

NOW = datetime(2025, 1, 1)


def tree(df):
    return df.select("repo_id", "path", F.octet_length("raw").cast("long").alias("size"), "raw")


def test_a_duel_sees_every_file_and_module(spark):
    own = {
        "src/auth/login.ts": 'import { a } from "../util/a";\n' + BRANCHY + 'const apiKey = "' + "q8Zr3LmW" + "v6Tn1KpX" + '";\n',
        "src/util/a.ts": 'import "../auth/login";\n' + SAME,
        "src/util/b.ts": SAME,
        "src/worker.py": "# TODO fix\n" * 6,
        "tests/a.test.ts": "t(1);\n",
        "z/README.md": "# Hi\n",
    }
    small = spark.createDataFrame([(repo, *f) for repo in ("small", "large") for f in own.items()], "repo_id string, path string, raw string")
    # before the others in file order, and without any weight of their own: 4,000 files and 81 modules
    files = spark.range(4000).select(F.lit("large").alias("repo_id"), F.format_string("a/n%d.txt", "id").alias("path"), F.lit("x").alias("raw"))
    modules = spark.range(81).select(F.lit("large").alias("repo_id"), F.format_string("b%d/a.js", "id").alias("path"), F.lit("").alias("raw"))
    p = audit.Parts(tree(small.union(files).union(modules)), spark.createDataFrame([], ADVICE))
    known = audit.known(p, landed.local_meta(small.select("repo_id").distinct(), NOW), NOW)
    assert {r.repo_id: (r.files, r.cycles) for r in known.collect()} == {"small": (6, 1), "large": (4087, 1)}
    scores = audit.scores(known, audit.findings(known, p.code))
    duel = outputs.duel(scores, scoring.overall(scores), spark.createDataFrame([("small", "large")], "a string, b string"))
    assert {(r.category, r.told) for r in duel.collect()} == {(c, "tie") for c in outputs.ORDER}


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """The smallest pages, and 2,100 more in the first repository: 4,200 files, before most of those with references and secrets."""
    folder = tmp_path_factory.mktemp("large")
    pages = spark.read.parquet(f"{DATA}/pages.parquet").withColumn("page_id", F.col("page_id").cast("double"))
    more = spark.range(2100).select((F.lit(20.5) + F.col("id") / 8192).alias("page_id"), F.lit("https://a.example/").alias("url"), F.lit("a=1").alias("html"))
    pages.unionByName(more).coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def as_in_sql(spark, d, name):
    """The rows of a query, which are those of its SQL."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, d)
    out = rows(got.columns, [tuple(r) for r in got.collect()])
    assert out == rows(columns, want.fetchall())
    return out


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
def test_links_of_every_file(spark, large):
    assert (1, "src/auth/login.ts", "r0.0", "../util/a", "src/util/a.ts") in as_in_sql(spark, large, "tree_links")


def test_every_text_is_loaded(spark):
    files = spark.range(62).select(F.lit("r").alias("repo_id"), F.format_string("f%d.go", "id").alias("path"), F.repeat(F.lit("x"), 1 << 20).alias("raw"))
    p = audit.Parts(tree(files), spark.createDataFrame([], ADVICE))
    assert audit.loaded(p.files).count() == 62


def test_graphs_of_all_modules(spark):
    n = 150
    files = spark.range(n).select(F.lit("r").alias("repo_id"), F.format_string("m%d/a.js", "id").alias("path"), (F.col("id") + 1).alias("lines"), F.lit("js").alias("analysis"))
    none = spark.createDataFrame([], "repo_id string, path string, complexity int")
    # one ring of all modules but the last, which leads into it
    edges = spark.range(n).select(F.lit("r").alias("repo_id"), F.format_string("m%d/a.js", "id").alias("src"), F.format_string("m%d/a.js", (F.col("id") + 1) % (n - 1)).alias("dst"), (F.col("id") + 1).alias("weight"))
    nodes, held = A.module_graph(files, none, edges)
    assert {(r.id, r.loc, r.fan_out, r.in_cycle) for r in nodes.collect()} == {(f"m{i}", i + 1, i + 1, i < n - 1) for i in range(n)}
    assert {(r.src, r.dst, r.weight, r.in_cycle) for r in held.collect()} == {(f"m{i}", f"m{(i + 1) % (n - 1)}", i + 1, i < n - 1) for i in range(n)}
    nodes, held = A.module_graph(files, none, edges, 80, 20)
    assert nodes.count() == 80 and held.count() == 20


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
def test_modules_of_every_file(spark, large):
    assert ("r0.0", "src/util") in {(r[-1], r[3]) for r in as_in_sql(spark, large, "tree_module_nodes")}


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
def test_secrets_of_every_file(spark, large):
    got = as_in_sql(spark, large, "tree_secrets")
    assert {"src/auth/login.ts", "src/keys.ts"} <= {r[3] for r in got if r[5] == "r0.0"}
