"""Lexers, function extraction, manifests, the directory source and the stream."""

import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treegauge.operators import deps as D
from treegauge.operators import lexing as L
from treegauge.sources.tree import SourceTree
from treegauge.streaming import jobs as S


@pytest.mark.parametrize(("src", "want"), [
    ('a = "x//y"; b', "a =       ; b"),
    ("a // b\nc", "a     \nc"),
    ("a /* b\n c */ d", "a     \n      d"),
    ("x = /a\"b/g; y", "x =       ; y"),
    ("a / b / c", "a / b / c"),
    ("`a\nb` c", "      c"),
    ("'open\nx", "     \nx"),
    ("`a${b}c` d", "    b}c   "),
])
def test_strip_js(src, want):
    assert L.strip_js(src) == want


@pytest.mark.parametrize(("src", "want"), [("x = 'a#b' # c", "x =          "), ('"""a\nb"""\ny', "    \n    \ny"), ("a = 1", "a = 1")])
def test_strip_python(src, want):
    assert L.strip_python(src) == want


@given(st.text(alphabet="ab/*\"'`\\\n#${}[]= ", max_size=80))
def test_length_is_kept(src):
    assert len(L.strip_js(src)) == len(src)
    assert len(L.strip_python(src)) == len(src)


def test_python_is_stripped_alike_in_the_jvm(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices(["a", " ", "\n", "#", '"', "'", "\\", '"""', "'''", "\U0001f600"], k=rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", '"', "'", "#", "\\", '"\\', "a'\\", '"a\\\nb" c', '"""' + "x'\n\\y" * 60_000, '"' + "\\a" * 100_000, "#" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", L.stripped_python(F.col("t")).alias("s")).collect()}
    assert got.pop(-1) is None
    assert [got[i] for i in range(len(texts))] == [L.strip_python(t) for t in texts]


def test_functions(spark):
    js = "function top(a) {\n  if (a && b) {\n    return a ? 1 : 2;\n  }\n}\nconst f = (x): number => x > 1 || y ? 1 : 2;\n"
    py = "def f(a):\n    if a and b:\n        x = 1\n    for y in a:\n        pass\n"
    rows = [(1, "a.ts", js, "js"), (1, "b.py", py, "python"), (1, "c.go", js, "generic")]
    got = L.functions(spark.createDataFrame(rows, "repo_id int, path string, code string, analysis string")).collect()
    assert {(r.path, r.line, r.name, r.complexity, r.length, r.nesting) for r in got} == {("a.ts", 1, "top", 4, 5, 2), ("a.ts", 6, "f", 3, 1, 0), ("b.py", 1, "f", 4, 4, 2)}


def test_manifests(spark):
    lock = json.dumps({"packages": {"": {"version": "1.0.0"}, "node_modules/a": {"version": "1.2.3"}, "node_modules/a/node_modules/b": {"version": "9.9.9"}, "node_modules/@s/c": {"version": "^2"}}})
    rows = [
        (1, "package.json", json.dumps({"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"c": "3"}})),
        (1, "package-lock.json", lock),
        (1, "requirements.txt", "Foo_Bar==1.0\nbaz>=2\n"),
        (1, "go.mod", "require (\n a v1\n b v2\n)"),
        (1, "Cargo.lock", '[[package]]\nname = "x"\nversion = "0.1.0"\n'),
        (1, "composer.lock", json.dumps({"packages": [{"name": "p/q", "version": "v3.1"}]})),
        (2, "package.json", "{broken"),
    ]
    m = spark.createDataFrame(rows, "repo_id int, path string, content string")
    assert {(r.repo_id, r.direct) for r in D.direct_count(m).collect()} == {(1, 7), (2, 0)}
    got = D.pinned(m)
    assert {tuple(r) for r in got.select("ecosystem", "name", "version").collect()} == {("npm", "a", "1.2.3"), ("pip", "foo-bar", "1.0"), ("cargo", "x", "0.1.0"), ("composer", "p/q", "3.1")}
    adv = spark.createDataFrame([("npm", "a", "1.2.3", "V-1"), ("npm", "a", "1.2.3", "V-2")], "ecosystem string, name string, version string, vuln_id string")
    assert D.vulnerable(got, adv).first().vulns == ["V-1", "V-2"]


def test_source_tree(spark, tmp_path):
    for path, text in {".env": "A=1", "src/_x.py": "x", "node_modules/a.js": "no", "src/deep/b.ts": "y"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    spark.dataSource.register(SourceTree)
    got = spark.read.format("source_tree").option("roots", f"r={tmp_path}").load().collect()
    assert {(r.repo_id, r.path, r.raw) for r in got} == {("r", ".env", "A=1"), ("r", "src/_x.py", "x"), ("r", "src/deep/b.ts", "y")}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, "queued"), (1, 2, "done"), (2, 1, "queued")], "job_id int, seq int, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id int, seq int, status string").parquet(str(tmp_path / "in"))
    q = S.latest(stream).writeStream.format("memory").queryName("latest_jobs").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.job_id, r.status) for r in spark.table("latest_jobs").collect()} == {(1, "done"), (2, "queued")}
    assert F is not None
