"""Reference queries over code of every shape that lexers and function extraction know, around the whole text of every document.

A file is a list of pieces, code or not: comments, strings, regular expressions and doc texts hold what would
count if it were code, and the document's text. The SQL blanks the pieces that are no code, and has each function's measures as
counted by hand, so it shares nothing with the lexers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treegauge.operators import lexing as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: (text, whether it is code); TEXT and LINE stand for the document's text and its first line.
TEXT, LINE = "\0text", "\0line"
JS = [
    ("/* ", False), (TEXT, False), (" */", False), ("\nexport function plain(a, b) {\n  if (a && b) {\n    return a ? 1 : 2;\n  }\n}\nconst arrow = (x): number => x > 1 || x < 0 ? 1 : 2;\n", True),
    ("const held = async function (y) {\n  for (const z of y) { while (z) { y?.q(); } }\n  return y ?? z;\n};\nclass C {\n  static async method(p: { q: string }): Promise<number> {\n    switch (p) { case 1: case 2: break; }\n    try { p(); } catch (e) { }\n  }\n}\n", True),
    ("const o = { key: (w) => w && w.length > 100 };\nconst half = a / b / c; const re = x.match(", True), ("/if (a) { [\"'/] /g", False), (");\n", True), ("// if (never) { return \"x\"; } ", False), (LINE, False), ("\nconst s = ", True), ('"a // \\" if (b) {"', False), (" + ", True), ("'/* if'", False), (";\nconst t = ", True), ("`one ${", False), ("two} && ", True), ("`; if", False),
]
PYTHON = [
    ('"""', False), (TEXT, False), ('"""', False), ("\nimport os\ndef outer(a, b=(1, 2)):\n    ", True), ("'''one \"quoted\" if line'''", False), ("\n    if a and b:\n        for x in a:\n            y = x or ", True), ("'#'", False),
    ("\n    def inner(z):\n        while z:\n            z -= 1\n        return z\n    async def short(q):\n        return q\n    return inner\nclass K:\n    def method(self):\n        try:\n            pass\n        except (A, B): ", True), ("# if for ", False), (LINE, False),
    ("\n            return None if self else 1\n", True),
]
GO = [("// if ", False), (LINE, False), ("\npackage main\nvar s = ", True), ('"a // if b"', False), ("\n", True), ("/* ", False), (TEXT, False), ("\n*/", False), (" func f() { if x { } }\n", True), ("// end", False)]
KINDS = {"js": JS, "python": PYTHON, "generic": GO}
#: line after the text's last one, name, complexity, length, nesting.
FUNCTIONS = {
    "js": [(1, "plain", 4, 5, 2), (6, "arrow", 3, 1, 0), (7, "held", 4, 4, 3), (12, "method", 4, 4, 2), (17, "key", 2, 1, 0)],
    "python": [(2, "outer", 5, 4, 3), (7, "inner", 2, 3, 2), (15, "method", 3, 4, 2)],
}
#: What would end a piece early is parted, and escapes are taken out.
SAFE = ("\\", ""), ("*/", "* /"), ('""', '" "'), ("\r", "")


def shaped(spark: SparkSession, d: str) -> DataFrame:
    """(repo_id, path, raw, analysis): three files for every document."""
    text = F.coalesce("text", F.lit(""))
    for a, b in SAFE:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.when(text.endswith('"'), F.concat(text, F.lit(" "))).otherwise(text)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("source").alias("repo_id"), text.alias("t")).withColumn("l", F.split("t", "\n")[0])
    of: Callable[[str], Column] = lambda x: F.col("t") if x == TEXT else F.col("l") if x == LINE else F.lit(x)
    files = F.array(*[F.struct(F.lit(kind).alias("analysis"), F.concat(*[of(x) for x, _ in pieces]).alias("raw")) for kind, pieces in KINDS.items()])
    return docs.select("repo_id", F.format_string("%08d", "doc_id").alias("path"), F.explode(files).alias("f")).select("repo_id", "path", "f.*")


def _sql(x: str) -> str:
    return "t" if x == TEXT else "l" if x == LINE else "'" + x.replace("'", "''") + "'"


_TEXT = "coalesce(text, '')"
for _a, _b in SAFE:
    _TEXT = f"replace({_TEXT}, {'chr(13)' if _a == chr(13) else _sql(_a)}, {_sql(_b)})"
_DOCS = f"(SELECT repo_id, path, t, string_split(t, chr(10))[1] AS l FROM (SELECT source AS repo_id, printf('%08d', doc_id) AS path, CASE WHEN ends_with(t, '\"') THEN t || ' ' ELSE t END AS t FROM (SELECT *, {_TEXT} AS t FROM documents)))"


def _blanked(kind: str) -> str:
    return " || ".join(_sql(x) if code else f"regexp_replace({_sql(x)}, '[^\\n]', ' ', 'g')" for x, code in KINDS[kind])


@query(" UNION ALL ".join(f"SELECT repo_id, path, '{kind}' AS analysis, md5({_blanked(kind)}) AS code FROM {_DOCS}" for kind in KINDS))
def code_stripped(spark, d):
    """Code of three kinds without its comments, strings, regular expressions and templates."""
    return shaped(spark, d).select("repo_id", "path", "analysis", F.md5(L.strip(F.col("raw"), F.col("analysis"))).alias("code"))


@query(" UNION ALL ".join(f"SELECT repo_id, path, '{kind}' AS analysis, CAST(len(string_split(t, chr(10))) + {line} AS INTEGER) AS line, '{name}' AS name, {cx} AS complexity, {size} AS length, {deep} AS nesting FROM {_DOCS}" for kind, fs in FUNCTIONS.items() for line, name, cx, size, deep in fs))
def code_functions(spark, d):
    """Functions of every shape: plain, arrow with a return type, held, method with a return type, property; outer, inner and method; too short ones are none."""
    files = shaped(spark, d).withColumn("code", L.strip(F.col("raw"), F.col("analysis"))).withColumn("path", F.concat_ws(" ", "analysis", "path"))
    f = L.functions(files)
    return f.select("repo_id", F.element_at(F.split("path", " "), 2).alias("path"), F.element_at(F.split("path", " "), 1).alias("analysis"), "line", "name", "complexity", "length", "nesting")
