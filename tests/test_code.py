"""Pages as code: whole texts reach the lexers, the functions and the audit."""

import pytest
from pyspark.sql import functions as F

from treegauge import catalog
from treegauge.operators import lexing as L

JS = "function page{}(a) {{\n  if (a && 'x') {{\n    return /* none */ a;\n  }}\n}}\n"
PY = "import os, sys\ndef page{}(a):\n    if a or 'x':  # text\n        b = 1\n    return b\n"
HTML = {
    0: '<html><script>var t="</p>";track(0);</script>\n<script>\nfunction late(a) {\n  if (a) {\n    return eval(a);\n  }\n}\n</script><p>it\'s /* odd',
    1: '<p>a</p>\n\ndef late(a):\n    b = """text"""\n    c = b\n    return c  # end\n<p>',
    2: None,
    3: None,
}


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pages")
    spark.createDataFrame([(i, f"https://h{i % 2}.example/p/{i}", h) for i, h in HTML.items()], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d)


def test_whole_pages_are_lexed(spark, pages):
    want = {str(i): (L.strip_python if i % 2 else L.strip_js)((PY if i % 2 else JS).format(i) + (h or "")) for i, h in HTML.items()}
    assert {r.path: r.code for r in catalog.lex_strip(spark, pages).collect()} == want


def test_functions_of_whole_pages(spark, pages):
    assert sorted((r.path, r.name) for r in catalog.js_functions(spark, pages).collect()) == [("0", "late"), ("0", "page0"), ("2", "page2")]
    assert sorted((r.path, r.name) for r in catalog.py_functions(spark, pages).collect()) == [("1", "late"), ("1", "page1"), ("3", "page3")]


def test_imports_of_whole_pages(spark, pages):
    got = catalog.py_imports(spark, pages).groupBy("page_id").agg(F.array_sort(F.collect_list("module")).alias("m")).collect()
    assert {r.page_id: r.m for r in got} == {1: ["os", "sys"], 3: ["os", "sys"]}


def test_hosts_are_repositories(spark, pages):
    got = {(r.repo_id, r.path) for r in catalog.lex_strip(spark, pages).collect()}
    assert got == {(f"h{i % 2}.example", str(i)) for i in HTML}
    assert {(r.repo_id, r.files) for r in catalog.audit_report(spark, pages).collect()} == {("h0.example", 2), ("h1.example", 2)}


def test_texts_go_to_python_in_small_batches(spark):
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    for name, value in zip(names, ("10000", "67108864b"), strict=True):
        spark.conf.set(name, value)
    L.functions(spark.createDataFrame([("r", "p", "x", "js")], "repo_id string, path string, code string, analysis string"))
    assert [spark.conf.get(x) for x in names] == ["1000", str(4 << 20)]
    spark.conf.set(names[1], "1000")
    L.strip(F.lit("x"), F.lit("js"))
    assert spark.conf.get(names[1]) == "1000"
    for name in names:
        spark.conf.unset(name)
