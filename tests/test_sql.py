"""SQL functions against the expressions they are made of."""

import pytest
from pyspark.sql import functions as F

from treegauge import sql as Q
from treegauge.operators import deps as D

TEXTS = ["", "a", "src/lib/A.TS", "src/x.py", "lib/a/b/c.min.js", "tests/x.test.ts", "package-lock.json", "a'b\\c\n=(x)", "critical", "major", "1.0.0-rc.1", "v2.10", "aA1!bB2?cC3", "C:\\new\tend", None]


@pytest.fixture
def made(spark):
    return Q.register(spark)


def test_functions_equal_their_expressions(spark, made):
    df = spark.createDataFrame([(t, i * 13) for i, t in enumerate(TEXTS)], "t string, n long")
    for name, parameters, _, of in Q.SCALARS:
        own, kind = parameters.split()
        x = df.withColumn(own, F.col("n") if kind == "BIGINT" else F.col("t"))
        want = [str(r[0]) for r in x.select(of().alias("v")).collect()]
        assert [str(r[0]) for r in x.selectExpr(f"tg_{name}({own}) AS v").collect()] == want, name


def test_operators_inside_texts_stay(spark):
    c = F.when(F.col("a") == "x=(1) and(2)", F.concat("a", F.lit(" it's \\ >(3)"))).otherwise(F.lit("no"))
    df = spark.createDataFrame([("x=(1) and(2)",), ("y",)], "a string")
    assert [r[0] for r in df.selectExpr(f"{Q.sql_of(c)} AS v").collect()] == [r[0] for r in df.select(c).collect()]


def test_table_function_of_manifests(spark, made):
    rows = [("requirements.txt", "Foo_Bar==1.0\nbaz>=2\n"), ("Cargo.lock", '[[package]]\nname = "x"\nversion = "0.1.0"\n'), ("package-lock.json", '{"packages":{"node_modules/a":{"version":"1.2.3"}}}'), ("other", "x"), ("go.sum", None)]
    df = spark.createDataFrame(rows, "path string, content string")
    df.createOrReplaceTempView("manifests_of_test")
    got = spark.sql("SELECT m.path, p.* FROM manifests_of_test m, LATERAL tg_pinned(m.path, m.content) p").collect()
    want = df.select("path", F.explode(D.pins()).alias("x")).select("path", "x.*").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 3
