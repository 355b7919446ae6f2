"""The audit in SQL: scalar functions, a table function of manifests, and views of a run.

    register(spark)                     functions tg_... for this session
    publish(spark, analysis, "audit_")  views audit_files, audit_code, audit_findings, ...

Functions are made from the same expressions as the operators, as SQL functions: the optimizer sees through them, and
nothing runs in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from treegauge.functions import rules as R
from treegauge.functions import text as T
from treegauge.operators import deps as D
from treegauge.operators import versions as V

LITERAL = re.compile(r"'(?:\\.|[^'\\])*'", re.S)
OPERATOR = re.compile(r"(?<![\w`.])(and|or|in|not|[=<>!+\-*/%&|^]+)\(")
FRACTION = re.compile(r"(?<![\w.])([0-9]+\.[0-9]+)(?![\w.])")


def sql_of(c: Column) -> str:
    """An expression as SQL text. Operators are written as calls, whose names need quotes in SQL; plain fractions would be decimals there."""
    text, out, at = c._jc.node().sql(), [], 0
    plain = lambda x: FRACTION.sub(r"\1D", OPERATOR.sub(r"`\1`(", x))
    for m in LITERAL.finditer(text):
        out += [plain(text[at : m.start()]), m.group()]
        at = m.end()
    return "".join(out) + plain(text[at:])


def _kind(c: Column) -> Column:
    """struct<lang, analysis> of an extension; analysis is null for what is no language."""
    ext = T.extension(c)
    lang = analysis = None
    for name, kind, exts in R.LANGUAGES:
        hit = ext.isin(*exts.split())
        lang = F.when(hit, name) if lang is None else lang.when(hit, name)
        analysis = F.when(hit, kind) if analysis is None else analysis.when(hit, kind)
    return F.struct(lang.alias("lang"), analysis.alias("analysis"))


#: name, parameters, type, expression
SCALARS: list[tuple[str, str, str, object]] = [
    ("classify", "path STRING", "STRUCT<lang STRING, analysis STRING>", lambda: _kind(F.col("path"))),
    ("extension", "path STRING", "STRING", lambda: T.extension(F.col("path"))),
    ("is_test", "path STRING", "BOOLEAN", lambda: T.is_test(F.col("path"))),
    ("is_lock", "path STRING", "BOOLEAN", lambda: T.is_lock(F.col("path"))),
    ("module_of", "path STRING", "STRING", lambda: T.module_of(F.col("path"))),
    ("line_count", "text STRING", "INT", lambda: T.line_count(F.col("text"))),
    ("entropy", "text STRING", "DOUBLE", lambda: T.entropy(F.col("text"))),
    ("penalty", "severity STRING", "INT", lambda: T.penalty(F.col("severity"))),
    ("grade", "score BIGINT", "STRING", lambda: T.grade(F.col("score"))),
    ("diagnosis", "score BIGINT", "STRING", lambda: T.diagnosis(F.col("score"))),
    ("version_key", "version STRING", "STRING", lambda: V.version_key(F.col("version"))),
]
VIEWS = {"files": "files", "code": "code", "functions": "functions", "links": "links", "edges": "edges", "vulnerable": "bad"}


def register(spark: SparkSession, prefix: str = "tg_") -> list[str]:
    """Names of the functions registered: tg_classify, tg_module_of, ..., and the table function tg_pinned(path, content)."""
    for name, parameters, kind, of in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {sql_of(of())}")
    rows = sql_of(F.explode(D.pins()))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}pinned(path STRING, content STRING) RETURNS TABLE (name STRING, version STRING) RETURN SELECT x.name, x.version FROM (SELECT {rows} AS x)")
    return [f"{prefix}{name}" for name, *_ in SCALARS] + [f"{prefix}pinned"]


def publish(spark: SparkSession, analysis: object, prefix: str = "audit_") -> list[str]:
    """Views of all tables of a plans.results.Analysis."""
    tables = {name: getattr(analysis.parts, part) for name, part in VIEWS.items()}
    tables |= {name: getattr(analysis, name) for name in ("facts", "findings", "scores", "graded", "plan", "notes", "meta")}
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in tables]
