"""The reference queries over the driver's tables, each with DuckDB SQL where SQL can express it.

Documents stand in for files (source: repository), pages for files with links, events for job
updates and findings, orders and line items for contributions and references between modules.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegauge.functions import rules as R
from treegauge.functions import text as T
from treegauge.operators import files as O
from treegauge.operators import graph as G
from treegauge.operators import jobs as J
from treegauge.operators import imports as I
from treegauge.operators import lexing as L
from treegauge.operators import secrets as S
from treegauge.operators import versions as V
from treegauge.plans import audit, health, outputs, scoring
from treegauge.sources import landed

from .catalog_trees import secret_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """documents as files (repo_id, path, raw, size, lines)."""
    doc = O.spread(_t(spark, d, "documents")).select(F.col("source").alias("repo_id"), F.format_string("doc_%08d.txt", "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("raw"), "lang")
    return doc.withColumn("size", F.octet_length("raw").cast("long")).withColumn("lines", T.line_count(F.col("raw")))


SRC = "(SELECT source AS repo_id, printf('doc_%08d.txt', doc_id) AS path, coalesce(text, '') AS raw, lang, strlen(coalesce(text, '')) AS size FROM documents)"
LINES = f"(SELECT repo_id, path, unnest(string_split(raw, chr(10))) AS text, generate_subscripts(string_split(raw, chr(10)), 1) AS line FROM {SRC} WHERE raw <> '')"


def _sql_list(xs: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


@query(f"SELECT repo_id, count(*) AS files, CAST(sum(len(string_split(raw, chr(10)))) AS BIGINT) AS loc, CAST(sum(size) AS BIGINT) AS bytes FROM {SRC} WHERE raw <> '' GROUP BY 1")
def src_line_stats(spark, d):
    return sources(spark, d).where("raw <> ''").groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("loc"), F.sum("size").alias("bytes"))


@query(f"SELECT lang, count(*) AS files, CAST(sum(CASE WHEN raw = '' THEN 0 ELSE len(string_split(raw, chr(10))) END) AS BIGINT) AS loc FROM {SRC} GROUP BY 1")
def lang_stats(spark, d):
    return sources(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("loc"))


ADDRESS = "CASE page_id % 6 WHEN 0 THEN 'https://github.com/owner' || page_id || '/repo.x.git' WHEN 1 THEN ' www.github.com/o_' || page_id || '/r/tree/dev/x ' WHEN 2 THEN 'o.' || page_id || '/r-x' WHEN 3 THEN url WHEN 4 THEN 'http://github.com/o/' || page_id || '?tab=x' ELSE 'github.com/' || page_id END"
TRIMMED = f"regexp_replace(trim({ADDRESS}), '\\.git$', '')"
LONG = "^(?:https?://)?(?:www\\.)?github\\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)(?:/tree/([^/]+))?"


@query(f"SELECT page_id, CASE WHEN long THEN regexp_extract(x, '{LONG}', 1) WHEN short THEN split_part(x, '/', 1) END AS owner, CASE WHEN long THEN regexp_extract(x, '{LONG}', 2) WHEN short THEN split_part(x, '/', 2) END AS repo, CASE WHEN long THEN nullif(regexp_extract(x, '{LONG}', 3), '') END AS ref FROM (SELECT page_id, x, regexp_matches(x, '{LONG}') AS long, regexp_full_match(x, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') AS short FROM (SELECT page_id, {TRIMMED} AS x FROM pages))")
def url_parse(spark, d):
    """Whole and short addresses, and texts that are none."""
    return _t(spark, d, "pages").selectExpr("page_id", f"{ADDRESS} AS x").select("page_id", landed.parsed_address(F.col("x")).alias("a")).select("page_id", "a.owner", "a.repo", "a.ref")


@query("SELECT status, remaining, CASE WHEN status IS NULL THEN 'unreachable' WHEN status IN (403, 429) AND remaining = 0 THEN 'limit' WHEN status IN (403, 429) THEN 'refused' WHEN status = 404 THEN 'missing' WHEN status // 100 <> 2 THEN 'failed' END AS error, count(*) AS n FROM (SELECT [200, 204, 403, 429, 404, 500, NULL][event_id % 7 + 1] AS status, event_id % 2 AS remaining FROM events) GROUP BY 1, 2, 3")
def answer_errors(spark, d):
    code = F.get(F.array(*[F.lit(x) for x in (200, 204, 403, 429, 404, 500, None)]), (F.col("event_id") % 7).cast("int"))
    e = _t(spark, d, "events").select(code.alias("status"), (F.col("event_id") % 2).alias("remaining"))
    return e.select("status", "remaining", landed.answer_error(F.col("status"), F.col("remaining")).alias("error")).groupBy("status", "remaining", "error").agg(F.count(F.lit(1)).alias("n"))


EXTS = ".ts .js .py .go .min.js .lock .md .png .snap .test.ts".split()


def paths(spark: SparkSession, d: str) -> DataFrame:
    """pages as paths of files of many kinds (repo_id, path, page_id)."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    part = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^?#]*)", 1)
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.col("page_id") % len(EXTS) + 1).cast("int"))
    where = F.element_at(F.array(*map(F.lit, ["src", "tests", "dist", "lib", "node_modules/x", "docs", "app"])), (F.col("page_id") % 7 + 1).cast("int"))
    return _t(spark, d, "pages").select("page_id", host.alias("repo_id"), F.concat(where, F.lit("/"), part, ext).alias("path"))


PATHS = f"(SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo_id, ['src', 'tests', 'dist', 'lib', 'node_modules/x', 'docs', 'app'][page_id % 7 + 1] || '/' || regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1) || [{_sql_list(EXTS)}][page_id % {len(EXTS)} + 1] AS path FROM pages)"


@query(f"""SELECT page_id, path, string_split(path, '/')[-1] AS base, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) AS ext,
 lower(regexp_extract(path, '(\\.[^.]*)$', 1)) IN ({_sql_list(R.BINARY)}) AS is_binary,
 regexp_matches(lower(path), '{R.TEST_PATH}') AS is_test, lower(string_split(path, '/')[-1]) IN ({_sql_list(R.LOCKS)}) AS is_lock FROM {PATHS}""")
def path_classify(spark, d):
    p = paths(spark, d).withColumn("base", T.base_name(F.col("path"))).withColumn("ext", T.extension(F.col("path")))
    return p.select("page_id", "path", "base", "ext", T.is_binary(F.col("ext")).alias("is_binary"), T.is_test(F.col("path")).alias("is_test"), T.is_lock(F.col("path")).alias("is_lock"))


DIM = ", ".join(f"('{e}', '{name}', '{kind}')" for name, kind, exts in R.LANGUAGES for e in exts.split())


@query(f"SELECT p.page_id, d.lang, d.analysis FROM {PATHS} p LEFT JOIN (VALUES {DIM}) d(ext, lang, analysis) ON lower(regexp_extract(p.path, '(\\.[^.]*)$', 1)) = d.ext")
def lang_dim_join(spark, d):
    return O.classify(paths(spark, d)).select("page_id", "lang", "analysis")


@query(f"""SELECT page_id, path FROM {PATHS} WHERE NOT (list_has_any(string_split(lower(path), '/')[:-2], [{_sql_list(R.IGNORED_DIRS)}]) OR string_split(lower(path), '/')[-1] IN ({_sql_list(R.IGNORED_FILES)})
 OR {" OR ".join(f"ends_with(lower(path), '{s}')" for s in R.IGNORED_SUFFIXES)})""")
def ignore_filter(spark, d):
    return paths(spark, d).where(~T.is_ignored(F.col("path"))).select("page_id", "path")


@query(f"SELECT page_id, CASE WHEN len(p) = 1 THEN '(root)' WHEN p[1] IN ('src', 'lib', 'app', 'packages', 'server', 'client') AND len(p) > 2 THEN p[1] || '/' || p[2] ELSE p[1] END AS module FROM (SELECT page_id, string_split(path, '/') AS p FROM {PATHS})")
def module_of(spark, d):
    return paths(spark, d).select("page_id", T.module_of(F.col("path")).alias("module"))


@query(f"SELECT repo_id, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS k FROM {SRC}) WHERE k <= 20")
def file_cap(spark, d):
    return O.file_cap(sources(spark, d), 20).select("repo_id", "path")


UNITS = "(len(raw) + len(regexp_replace(raw, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"


@query(f"SELECT repo_id, path, CAST(b AS BIGINT) AS before FROM (SELECT *, coalesce(sum({UNITS}) OVER (PARTITION BY repo_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {SRC}) WHERE b <= 60000")
def text_budget(spark, d):
    return O.text_budget(sources(spark, d), 60000).select("repo_id", "path", "before")


SECRET_ROWS = secret_sql(SRC)


@query(f"SELECT repo_id, path, pattern, nth, line, value, round(entropy, 6) AS entropy FROM {SECRET_ROWS}")
def secret_matches(spark, d):
    return S.secret_matches(sources(spark, d)).withColumn("entropy", F.round("entropy", 6))


@query(f"SELECT repo_id, pattern, count(*) AS n, CASE WHEN pattern = 'security.generic' THEN 'major' ELSE 'critical' END AS severity FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, pattern ORDER BY path, nth) AS k FROM {SECRET_ROWS}) WHERE k <= 12 GROUP BY 1, 2")
def secret_severity(spark, d):
    return S.secret_findings(S.secret_matches(sources(spark, d)))


CODE = "(SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'x = eval(input())' WHEN 1 THEN 'requests.get(u, verify=False)' WHEN 2 THEN 'pickle.load (f)' ELSE html END || chr(10) || html AS raw, CASE page_id % 3 WHEN 0 THEN 'js' ELSE 'python' END AS analysis, page_id % 10 AS repo_id FROM pages)"


@query("SELECT repo_id, page_id, pattern FROM (" + " UNION ALL ".join(f"""SELECT repo_id, page_id, '{n}' AS pattern, analysis, unnest(string_split(raw, chr(10))) AS text FROM {CODE} WHERE analysis IN ({_sql_list(langs.split())})""" for n, _, langs, _ in R.DANGEROUS) + ") WHERE " + " OR ".join(f"""(pattern = '{n}' AND regexp_matches(text, '{p.replace("'", "''")}'))""" for n, p, _, _ in R.DANGEROUS))
def pattern_lines(spark, d):
    head = F.when(F.col("page_id") % 4 == 0, "x = eval(input())").when(F.col("page_id") % 4 == 1, "requests.get(u, verify=False)").when(F.col("page_id") % 4 == 2, "pickle.load (f)").otherwise(F.col("html"))
    f = _t(spark, d, "pages").select((F.col("page_id") % 10).alias("repo_id"), F.col("page_id").alias("path"), F.concat(head, F.lit("\n"), "html").alias("raw"), F.when(F.col("page_id") % 3 == 0, "js").otherwise("python").alias("analysis"), F.lit(False).alias("is_test"))
    return O.pattern_lines(f).select("repo_id", F.col("path").alias("page_id"), "pattern")


CLONE = f"""(SELECT repo_id, path, line, t AS text FROM (SELECT repo_id, path, line, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS t FROM {LINES}) WHERE len(t) >= {R.CLONE_LEAST} AND NOT regexp_matches(t, '{R.CLONE_SKIP}'))"""
WINDOWS = f"(SELECT repo_id, path, line, md5(array_to_string(run, chr(10))) AS key FROM (SELECT repo_id, path, line, list(text) OVER (PARTITION BY repo_id, path ORDER BY line ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS run FROM {CLONE}) WHERE len(run) = 7)"
GROUPS = f"(SELECT repo_id, key, count(*) AS n, min(struct_pack(path := path, line := line)) AS f FROM {WINDOWS} GROUP BY 1, 2 HAVING count(*) > 1)"


@query(f"SELECT repo_id, path, CAST(line AS INTEGER) AS line, key FROM {WINDOWS}")
def dup_windows(spark, d):
    return O.clone_windows(sources(spark, d))


@query(f"SELECT repo_id, key, n, f.path AS first_path, CAST(f.line - 6 AS INTEGER) AS first_line FROM {GROUPS}")
def dup_groups(spark, d):
    return O.clone_groups(sources(spark, d))


@query(f"SELECT e.repo_id, e.eligible, CAST(coalesce(g.d, 0) AS BIGINT) AS duplicated, round(coalesce(g.d, 0) / e.eligible, 6) AS ratio FROM (SELECT repo_id, count(*) AS eligible FROM {CLONE} GROUP BY 1) e LEFT JOIN (SELECT repo_id, sum((n - 1) * 7) AS d FROM {GROUPS} GROUP BY 1) g USING (repo_id)")
def dup_ratio(spark, d):
    return O.clone_ratio(sources(spark, d)).drop("blocks").withColumn("ratio", F.round("ratio", 6))


@query(f"SELECT * FROM (SELECT repo_id, key, n, row_number() OVER (PARTITION BY repo_id ORDER BY least(n, 4) DESC, f.path, f.line, key) AS place FROM {GROUPS}) WHERE place <= 6")
def dup_top_groups(spark, d):
    return O.top_clone_groups(O.clone_groups(sources(spark, d))).select("repo_id", "key", "n", F.col("place").cast("long").alias("place"))


@query(f"SELECT repo_id, CAST(sum(CASE WHEN regexp_matches(t, '^(//|/\\*|\\*|#)') AND NOT regexp_matches(t, '^#!') AND len(t) > 2 THEN 1 ELSE 0 END) AS BIGINT) AS comments, count(*) AS loc FROM (SELECT repo_id, regexp_replace(text, '^[ \\t\\n\\v\\f\\r]+', '') AS t FROM {LINES}) GROUP BY 1")
def comment_lines(spark, d):
    return O.lines(sources(spark, d)).groupBy("repo_id").agg(F.sum(T.is_comment(F.col("text")).cast("int")).alias("comments"), F.count(F.lit(1)).alias("loc"))


@query(f"SELECT repo_id, CAST(sum(len(regexp_extract_all(raw, '(?i)\\b(license|licensed|copyright)\\b'))) AS BIGINT) AS n, bool_or(regexp_matches(raw, '(?i)licen[cs]e')) AS has_license FROM {SRC} GROUP BY 1")
def license_presence(spark, d):
    pattern = T.java(r"(?i)\b(license|licensed|copyright)\b")
    return sources(spark, d).groupBy("repo_id").agg(F.sum(F.regexp_count("raw", F.lit(pattern))).alias("n"), F.bool_or(F.col("raw").rlike("(?i)licen[cs]e")).alias("has_license"))


@query("SELECT page_id, " + ", ".join(f"""regexp_matches(lower(html), '{p}') AS "{n.replace(' ', '_')}" """ for n, p in R.SECTIONS) + " FROM (SELECT page_id, '# Usage' || chr(10) || html || chr(10) || CASE WHEN page_id % 2 = 0 THEN '## License' ELSE '# API docs' END || chr(10) AS html FROM pages)")
def section_flags(spark, d):
    html = F.concat(F.lit("# Usage\n"), "html", F.lit("\n"), F.when(F.col("page_id") % 2 == 0, "## License").otherwise("# API docs"), F.lit("\n"))
    return _t(spark, d, "pages").select("page_id", *[F.lower(html).rlike(T.java(p)).alias(n.replace(" ", "_")) for n, p in R.SECTIONS])


@query("SELECT text_md5, n, first_doc FROM (SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1) WHERE n > 1")
def exact_dedupe(spark, d):
    return _t(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT DISTINCT source, lang FROM documents")
def distinct_langs(spark, d):
    return _t(spark, d, "documents").select("source", "lang").distinct()


TEST_LOC = f"(SELECT s.source AS repo_id, CAST(sum(CASE WHEN l.quality = 1 THEN n ELSE 0 END) AS BIGINT) AS test_loc, CAST(sum(CASE WHEN l.quality = 1 THEN 0 ELSE n END) AS BIGINT) AS source_loc FROM (SELECT doc_id, source, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n FROM documents) s LEFT JOIN labels l USING (doc_id) GROUP BY 1)"


def _test_loc(spark, d):
    doc = _t(spark, d, "documents").withColumn("n", T.line_count(F.col("text")))
    flag = F.coalesce(F.col("quality") == 1, F.lit(False))
    return doc.join(_t(spark, d, "labels"), "doc_id", "left").groupBy(F.col("source").alias("repo_id")).agg(F.sum(F.when(flag, F.col("n")).otherwise(0)).alias("test_loc"), F.sum(F.when(flag, 0).otherwise(F.col("n"))).alias("source_loc"))


@query(f"SELECT repo_id, test_loc, source_loc, CASE WHEN source_loc > 0 THEN round(test_loc / source_loc, 6) END AS ratio FROM {TEST_LOC}")
def test_ratio(spark, d):
    return _test_loc(spark, d).withColumn("ratio", F.round(F.try_divide("test_loc", "source_loc"), 6))


@query(f"SELECT repo_id, CAST(greatest(5, least(100, 100 - CASE WHEN source_loc = 0 THEN 0 ELSE greatest(0, 100 - least(100, floor(test_loc / source_loc / 0.6 * 100 + 0.5))) END)) AS BIGINT) AS score FROM {TEST_LOC}")
def test_curve(spark, d):
    return _test_loc(spark, d).select("repo_id", scoring.testing_score().alias("score"))


@query("SELECT repo_id, min(k) AS bus_factor FROM (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, who) AS k, sum(n) OVER (PARTITION BY repo_id ORDER BY n DESC, who ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY repo_id) AS total FROM (SELECT c.c_nationkey AS repo_id, o.o_custkey AS who, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)) WHERE run * 2 >= total GROUP BY 1")
def bus_factor(spark, d):
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("who")).agg(F.count(F.lit(1)).alias("n"))
    return J.bus_factor(o.join(_t(spark, d, "customer"), F.col("who") == F.col("c_custkey")).select(F.col("c_nationkey").alias("repo_id"), "who", "n"))


@query("SELECT o_custkey AS repo_id, max(o_orderdate) < TIMESTAMP '1998-01-01' - INTERVAL 720 DAY AS stale FROM orders GROUP BY 1")
def staleness(spark, d):
    return _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo_id")).agg((F.max("o_orderdate") < F.expr("TIMESTAMP_NTZ '1998-01-01' - INTERVAL 720 DAY")).alias("stale"))


@query("SELECT event_type, CAST(sum(len(json_keys(props))) AS BIGINT) AS n_keys, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_props_keys(spark, d):
    m = F.from_json("props", "map<string,string>")
    return _t(spark, d, "events").select("event_type", m.alias("m")).groupBy("event_type").agg(F.sum(F.size("m")).alias("n_keys"), F.sum(F.col("m")["k"].cast("long")).alias("total"))


@query("SELECT DISTINCT p_type AS ecosystem, p_name AS name, p_size AS version FROM part")
def dep_dedupe(spark, d):
    return _t(spark, d, "part").select(F.col("p_type").alias("ecosystem"), F.col("p_name").alias("name"), F.col("p_size").alias("version")).distinct()


@query("SELECT p_partkey AS dep, least(count(*), 8) AS shown, count(*) AS vulns FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) v ON p_partkey = l_partkey GROUP BY 1")
def vuln_join(spark, d):
    adv = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return _t(spark, d, "part").join(adv, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_partkey").alias("dep")).agg(F.least(F.count(F.lit(1)), F.lit(8)).alias("shown"), F.count(F.lit(1)).alias("vulns"))


HREF = "(SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages)"


@query(f"SELECT target, count(*) AS n, count(DISTINCT page_id) AS pages FROM {HREF} GROUP BY 1")
def link_targets(spark, d):
    l = _t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return l.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


SUFFIXES = R.JS_TAILS
KNOWN = "(SELECT DISTINCT lower(target) || CASE WHEN len(target) % 3 = 0 THEN '.js' WHEN len(target) % 3 = 1 THEN '.ts' ELSE '/index.js' END AS path FROM " + HREF + ")"


@query(f"SELECT page_id, target, arg_min(path, k) AS path FROM (SELECT DISTINCT r.page_id, r.target, k.path, s.k FROM {HREF} r, (VALUES {', '.join(f'({i}, {chr(39)}{s}{chr(39)})' for i, s in enumerate(SUFFIXES))}) s(k, suffix) JOIN {KNOWN} k ON lower(r.target || s.suffix) = k.path) GROUP BY 1, 2")
def link_resolution(spark, d):
    refs = _t(spark, d, "pages").select(F.lit(0).alias("repo_id"), F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    n = F.length("target") % 3
    known = refs.select("repo_id", F.concat(F.lower("target"), F.when(n == 0, ".js").when(n == 1, ".ts").otherwise("/index.js")).alias("path")).distinct()
    return G.resolve(refs, known, SUFFIXES).select(F.col("src").alias("page_id"), "target", "path")


EDGES = "(SELECT c.c_nationkey AS src, s.s_nationkey AS dst, count(*) AS weight FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE c.c_nationkey <> s.s_nationkey GROUP BY 1, 2)"
TOP = f"(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS k FROM {EDGES}) WHERE k <= 120)"


def _edges(spark, d):
    l = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    l = l.join(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")).join(_t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
    return G.edge_weights(l.select(F.lit(0).alias("repo_id"), F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")))


@query(f"SELECT * FROM {EDGES}")
def module_edges(spark, d):
    return _edges(spark, d).select("src", "dst", "weight")


@query(f"SELECT src, dst, weight FROM {TOP}")
def top_edges(spark, d):
    return G.top_edges(_edges(spark, d)).select("src", "dst", "weight")


@query(f"SELECT src, dst, weight FROM {EDGES} WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def edge_semi(spark, d):
    nodes = _t(spark, d, "nation").where("n_regionkey = 1").select(F.lit(0).alias("repo_id"), F.col("n_nationkey").alias("id"))
    return G.on_nodes(_edges(spark, d), nodes).select("src", "dst", "weight")


@query(f"SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT dst AS id, weight AS i, 0 AS o FROM {TOP} UNION ALL SELECT src, 0, weight FROM {TOP}) GROUP BY 1")
def fan_in_out(spark, d):
    return G.fans(G.top_edges(_edges(spark, d))).select("id", "fan_in", "fan_out")


@query(f"SELECT dst AS id, CAST(sum(weight) AS BIGINT) AS fan_in FROM {TOP} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_fan_in(spark, d):
    return G.fans(G.top_edges(_edges(spark, d))).select("id", "fan_in").orderBy(F.desc("fan_in"), "id").limit(5)


@query(f"WITH RECURSIVE e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS k FROM {EDGES}) WHERE k <= 120), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src) SELECT x.a AS id, min(least(x.a, x.b)) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1")
def scc_members(spark, d):
    return G.cycles(G.top_edges(_edges(spark, d))).select("id", "cycle")


CLOSURE = """WITH RECURSIVE e AS (SELECT DISTINCT repo_id, src, dst FROM {0} WHERE src <> dst), r(repo_id, a, b) AS (SELECT repo_id, src, dst FROM e UNION SELECT r.repo_id, r.a, e.dst FROM r JOIN e ON r.repo_id = e.repo_id AND r.b = e.src)
SELECT x.repo_id, min(least(x.a, x.b)) AS cycle, x.a AS id FROM r x JOIN r y ON x.repo_id = y.repo_id AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY ALL"""


@query(CLOSURE.format("(SELECT o_custkey AS repo_id, 's' || l_suppkey AS src, 's' || lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"))
def scc_by_customer(spark, d):
    """Cycles of suppliers in each customer's orders: an edge from the supplier of a line to that of the next one."""
    l = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    after = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return G.strong_components(l.select(F.col("o_custkey").alias("repo_id"), name(F.col("l_suppkey")).alias("src"), name(after).alias("dst")))


@query(CLOSURE.format("(SELECT 0 AS repo_id, CASE WHEN l_returnflag = 'R' THEN 's' || l_suppkey ELSE 'c' || o_custkey END AS src, CASE WHEN l_returnflag = 'R' THEN 'c' || o_custkey ELSE 's' || l_suppkey END AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"))
def scc_customers_suppliers(spark, d):
    """One graph of all customers and suppliers: what is ordered points to the supplier, what is returned to the customer."""
    l = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c, s, back = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.col("l_returnflag") == "R"
    return G.strong_components(l.select(F.lit(0).alias("repo_id"), F.when(back, s).otherwise(c).alias("src"), F.when(back, c).otherwise(s).alias("dst")))


# versions 1.<quantity>.<supplier> of parts, some of them pre-releases; ranges from bounds of both kinds
PINNED = "(SELECT l_suppkey % 40 AS repo_id, 'p' || l_partkey AS name, l_linenumber AS a, CAST(l_quantity AS INTEGER) AS b, l_orderkey % 9 AS pre FROM lineitem)"
RANGED = "(SELECT 'p' || p_partkey AS name, 'A-' || p_partkey || '-' || k AS vuln_id, p_size % 4 + k AS a, p_size AS b, p_partkey % 7 AS pre, p_size % 4 + 2 * k AS c, p_size // 2 AS e, (p_partkey + k) % 3 AS how FROM part, (SELECT unnest([0, 1, 2]) AS k))"
NUMBERS = "[{0}, {1}, CASE WHEN {2} < 4 THEN 0 ELSE 1 END, CASE WHEN {2} < 4 THEN {2} ELSE 0 END]"


@query(f"""WITH d AS (SELECT DISTINCT repo_id, name, a || '.' || b || CASE WHEN pre < 4 THEN '.0-rc.' || pre ELSE '.0' END AS version, {NUMBERS.format("a", "b", "pre")} AS v FROM {PINNED}),
r AS (SELECT name, vuln_id, how, CASE WHEN how = 2 THEN [0, 0, 0, 0] ELSE {NUMBERS.format("a", "b", "pre")} END AS lo, [c, e, 1, 0] AS hi FROM {RANGED})
SELECT repo_id, name, version, count(*) AS n, string_agg(vuln_id, ',' ORDER BY vuln_id) AS vulns FROM d JOIN r USING (name) WHERE v >= lo AND (how = 0 OR how = 1 AND v < hi OR how = 2 AND v <= hi) GROUP BY 1, 2, 3""")
def vuln_ranges(spark, d):
    """Advisories of all parts, with open ends, fixed versions and last affected ones, against the versions of all line items."""
    text = lambda a, b, pre: F.concat_ws(".", a, b, F.when(pre < 4, F.concat(F.lit("0-rc."), pre.cast("string"))).otherwise("0"))
    deps = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("repo_id"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), text(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_orderkey") % 9).alias("version")).distinct()
    p = _t(spark, d, "part").select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    how, whole = (F.col("p_partkey") + F.col("k")) % 3, lambda c: c.cast("string")
    from_ = text(whole(F.col("p_size") % 4 + F.col("k")), whole(F.col("p_size")), F.col("p_partkey") % 7)
    to = F.concat_ws(".", whole(F.col("p_size") % 4 + 2 * F.col("k")), whole(F.floor(F.col("p_size") / 2)))
    ranges = p.select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.concat_ws("-", F.lit("A"), "p_partkey", "k").alias("vuln_id"), F.when(how == 2, "0").otherwise(from_).alias("introduced"), F.when(how == 1, to).alias("fixed"), F.when(how == 2, to).alias("last_affected"))
    return V.in_ranges(deps, ranges).select("repo_id", "name", "version", F.size("vulns").cast("long").alias("n"), F.array_join("vulns", ",").alias("vulns"))


CATEGORY = "CASE event_id % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'quality' WHEN 2 THEN 'documentation' ELSE 'maintainability' END"
SEVERITY = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'major' WHEN 'signup' THEN 'minor' ELSE 'info' END"
# ten consecutive events are the findings of one repository, so that their penalties stay apart at every size
FINDINGS = f"(SELECT event_id - event_id % 10 AS repo_id, event_id, {CATEGORY} || '.' || event_type AS id, {CATEGORY} AS category, {SEVERITY} AS severity, CASE event_type WHEN 'error' THEN 30 WHEN 'purchase' THEN 10 WHEN 'signup' THEN 4 ELSE 1 END AS penalty FROM events)"
SCORES = f"(SELECT repo_id, category, CAST(sum(penalty) AS BIGINT) AS penalty, CAST(CASE WHEN sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) >= 2 THEN least(100 - least(100, sum(penalty)), 35) WHEN sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) = 1 THEN least(100 - least(100, sum(penalty)), 55) ELSE 100 - least(100, sum(penalty)) END AS BIGINT) AS score FROM {FINDINGS} GROUP BY 1, 2)"


def _findings(spark, d):
    e = _t(spark, d, "events")
    f = e.select((F.col("event_id") - F.col("event_id") % 10).alias("repo_id"), "event_id", F.expr(CATEGORY).alias("category"), F.expr(SEVERITY).alias("severity"), "event_type")
    return f.withColumn("id", F.concat("category", F.lit("."), "event_type")).withColumn("penalty", T.penalty(F.col("severity")))


@query(f"SELECT repo_id, event_id, id, category, severity, penalty FROM {FINDINGS}")
def finding_penalties(spark, d):
    return _findings(spark, d).select("repo_id", "event_id", "id", "category", "severity", "penalty")


@query(f"SELECT * FROM {SCORES}")
def category_scores(spark, d):
    return scoring.category_scores(_findings(spark, d))


WEIGHTED = " + ".join(f"coalesce(max(CASE WHEN category = '{c}' THEN score END), 100) * {w}::DOUBLE" for c, w in R.WEIGHTS.items())


@query(f"SELECT repo_id, overall, CASE WHEN overall >= 93 THEN 'A+' WHEN overall >= 85 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 65 THEN 'C' WHEN overall >= 50 THEN 'D' ELSE 'F' END AS grade FROM (SELECT repo_id, CAST(floor(round({WEIGHTED}, 6) + 0.5) AS BIGINT) AS overall FROM {SCORES} GROUP BY 1)")
def overall_grade(spark, d):
    return scoring.overall(scoring.category_scores(_findings(spark, d)))


@query(f"SELECT category, coalesce(severity, 'all') AS severity, count(*) AS n FROM {FINDINGS} GROUP BY GROUPING SETS ((category, severity), (category))")
def severity_rollup(spark, d):
    f = _findings(spark, d)
    return f.select("category", F.explode(F.array("severity", F.lit("all"))).alias("severity")).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT repo_id, event_id, id FROM {FINDINGS} WHERE severity = 'critical'")
def findings_filtered(spark, d):
    return _findings(spark, d).where("severity = 'critical'").select("repo_id", "event_id", "id")


COMPARED = f"(SELECT category, x.score AS score_a, y.score AS score_b, x.score - y.score AS diff, CASE WHEN x.score > y.score THEN 'a' WHEN x.score < y.score THEN 'b' ELSE 'tie' END AS winner FROM (SELECT * FROM {SCORES} WHERE repo_id = 0) x JOIN (SELECT * FROM {SCORES} WHERE repo_id = 30) y USING (category))"


@query(f"SELECT * FROM {COMPARED}")
def compare_categories(spark, d):
    return scoring.compare(scoring.category_scores(_findings(spark, d)), 0, 30)


@query(f"SELECT winner, count(*) AS categories FROM {COMPARED} GROUP BY 1")
def compare_verdict(spark, d):
    return scoring.compare(scoring.category_scores(_findings(spark, d)), 0, 30).groupBy("winner").agg(F.count(F.lit(1)).alias("categories"))


@query(f"SELECT DISTINCT id FROM {FINDINGS} WHERE repo_id = 0 AND id NOT IN (SELECT id FROM {FINDINGS} WHERE repo_id = 30)")
def only_in_a(spark, d):
    f = _findings(spark, d)
    return f.where("repo_id = 0").select("id").distinct().join(f.where("repo_id = 30").select("id"), "id", "left_anti")


@query(f"SELECT DISTINCT id FROM {FINDINGS} WHERE repo_id = 0 AND id IN (SELECT id FROM {FINDINGS} WHERE repo_id = 30)")
def shared_findings(spark, d):
    f = _findings(spark, d)
    return f.where("repo_id = 0").select("id").distinct().join(f.where("repo_id = 30").select("id"), "id", "left_semi")


@query(f"SELECT repo_id, id, place FROM (SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END, id) AS place FROM (SELECT DISTINCT repo_id, id, severity FROM {FINDINGS})) WHERE place <= 12")
def plan_top12(spark, d):
    w = Window.partitionBy("repo_id").orderBy(T.severity_rank(F.col("severity")), "id")
    return _findings(spark, d).select("repo_id", "id", "severity").distinct().select("repo_id", "id", F.row_number().over(w).cast("long").alias("place")).where("place <= 12")


STATUS = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'error' ELSE 'done' END"
JOBS = f"(SELECT user_id * 100 + event_id % 100 AS job_id, event_id AS seq, {STATUS} AS status, ts AS finished, value FROM events)"
LATEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS k FROM {JOBS}) WHERE k = 1)"


def _jobs(spark, d):
    e = _t(spark, d, "events")
    return J.latest(e.select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("job_id"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"), F.col("ts").alias("finished"), F.col("ts").alias("created"), "value"))


@query(f"SELECT job_id, seq, status FROM {LATEST}")
def job_latest(spark, d):
    return _jobs(spark, d).select("job_id", "seq", "status")


@query(f"""SELECT job_id, '{{"job":{{"id":' || job_id || ',"seq":' || seq || ',"status":"' || status || '","result_id":' || (seq // 2) || '}}' || CASE WHEN status = 'done' AND o_orderkey IS NOT NULL THEN ',"result":{{"id":' || o_orderkey || '}}' ELSE '' END || '}}' AS body FROM {LATEST} LEFT JOIN orders ON o_orderkey = seq // 2""")
def job_status(spark, d):
    """What a caller who asks for a job gets: the job, and its result once it is done."""
    jobs = _jobs(spark, d).select("job_id", "seq", "status", F.expr("seq div 2").alias("result_id"))
    return outputs.status(jobs, _t(spark, d, "orders").select(F.col("o_orderkey").alias("result_id"), F.format_string('{"id":%d}', "o_orderkey").alias("document")))


ANSWERS = "(SELECT page_id // 3 AS repo_id, ['repo', 'languages', 'contributors'][page_id % 3 + 1] AS what, [200, 200, 404, 403, 200, 500, 429][page_id % 7 + 1] AS status, page_id % 2 AS remaining, url AS body FROM pages)"


@query(f"""WITH a AS (SELECT *, CASE WHEN status IN (403, 429) AND remaining = 0 THEN 'limit' WHEN status IN (403, 429) THEN 'refused' WHEN status = 404 THEN 'missing' WHEN status // 100 <> 2 THEN 'failed' END AS error FROM {ANSWERS})
SELECT r.repo_id, r.error, CASE WHEN r.error IS NULL THEN r.body END AS repo, CASE WHEN r.error IS NULL AND l.error IS NULL THEN l.body END AS languages, CASE WHEN r.error IS NULL AND c.error IS NULL THEN c.body END AS contributors
FROM a r LEFT JOIN a l ON l.repo_id = r.repo_id AND l.what = 'languages' LEFT JOIN a c ON c.repo_id = r.repo_id AND c.what = 'contributors' WHERE r.what = 'repo'""")
def landed_answers(spark, d):
    """Answers of a code host with their status: what can be read on, and what was refused."""
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), F.expr(f"CAST({k} AS INT)"))
    rows = _t(spark, d, "pages").select(F.expr("page_id div 3").alias("repo_id"), pick(["repo", "languages", "contributors"], "page_id % 3").alias("what"), pick([200, 200, 404, 403, 200, 500, 429], "page_id % 7").alias("status"), F.expr("page_id % 2").alias("remaining"), F.col("url").alias("body"))
    fine, bad = landed.answers(rows)
    return fine.withColumn("error", F.lit(None).cast("string")).unionByName(bad.drop("status"), allowMissingColumns=True)


@query(f"SELECT job_id, seq FROM {LATEST} ORDER BY seq DESC LIMIT 200")
def job_retention(spark, d):
    return J.retained(_jobs(spark, d)).select("job_id", "seq")


@query(f"SELECT job_id, seq FROM {LATEST} WHERE status = 'queued' ORDER BY finished, job_id LIMIT 1")
def job_fifo(spark, d):
    return J.oldest_queued(_jobs(spark, d)).select("job_id", "seq")


@query(f"SELECT j.job_id, o.o_totalprice AS price FROM (SELECT * FROM {LATEST} WHERE status = 'done' ORDER BY finished DESC, job_id DESC LIMIT 8) j JOIN orders o ON j.job_id = o.o_orderkey")
def recent_results(spark, d):
    return J.recent(_jobs(spark, d), _t(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_totalprice").alias("price"))).select("job_id", "price")


@query(f"SELECT job_id FROM {LATEST} WHERE status = 'done' AND finished > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def fresh_cache(spark, d):
    last = _t(spark, d, "events").agg(F.max("ts").alias("now"))  # one row
    return J.fresh(_jobs(spark, d).join(F.broadcast(last)), F.col("now")).select("job_id")


@query(f"SELECT repo_id, 'health ' || grade || ' ' || CAST(overall AS VARCHAR) AS label, CAST(len('health ' || grade || ' ' || CAST(overall AS VARCHAR)) * 7.0 - 2 * 3.5 AS DOUBLE) AS width FROM ({ORACLES['overall_grade']})")
def badge_text(spark, d):
    label = F.concat_ws(" ", F.lit("health"), "grade", F.col("overall").cast("string"))
    narrow = F.length(label) - F.length(F.replace(label, F.lit(" "), F.lit("")))
    return scoring.overall(scoring.category_scores(_findings(spark, d))).select("repo_id", label.alias("label"), (F.length(label) * 7.0 - narrow * 3.5).cast("double").alias("width"))


@query(f"SELECT repo_id, string_agg(severity || ': ' || id, chr(10) ORDER BY k) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END, id, event_id) AS k FROM {FINDINGS}) WHERE k <= 30 GROUP BY 1")
def digest(spark, d):
    w = Window.partitionBy("repo_id").orderBy(T.severity_rank(F.col("severity")), "id", "event_id")
    top = _findings(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 30")
    return top.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat("severity", F.lit(": "), "id").alias("x")))), lambda s: s["x"]), "\n").alias("digest"))


@query(f"SELECT repo_id, CAST(sum(len(regexp_extract_all(raw, '\\b([A-Z]{{2,}})\\b'))) AS BIGINT) AS marks, round(sum(len(regexp_extract_all(raw, '\\b([A-Z]{{2,}})\\b'))) / (sum(len(string_split(raw, chr(10)))) / 1000.0), 6) AS per_kloc FROM {SRC} WHERE raw <> '' GROUP BY 1")
def marker_density(spark, d):
    # the tables hold no work markers, so words in capitals stand in for them
    n = F.regexp_count("raw", F.lit(T.java(r"\b([A-Z]{2,})\b")))
    g = sources(spark, d).where("raw <> ''").groupBy("repo_id").agg(F.sum(n).alias("marks"), F.sum("lines").alias("loc"))
    return g.select("repo_id", "marks", F.round(F.col("marks") / (F.col("loc") / 1000.0), 6).alias("per_kloc"))


@query(f"SELECT regexp_extract(path, '^(.*)/', 1) AS dir, count(*) AS n FROM {PATHS} GROUP BY 1 HAVING count(*) >= 5")
def dir_fanout(spark, d):
    return paths(spark, d).groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("dir")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query(f"SELECT page_id, array_to_string(list_filter(['installation', 'usage'], lambda x: NOT list_contains([CASE WHEN installation THEN 'installation' END, CASE WHEN usage THEN 'usage' END], x)), ',') AS missing FROM ({ORACLES['section_flags']})")
def missing_sections(spark, d):
    f = section_flags(spark, d)
    held = F.array_compact(F.array(F.when(F.col("installation"), "installation"), F.when(F.col("usage"), "usage")))
    return f.select("page_id", F.array_join(F.array_except(F.array(F.lit("installation"), F.lit("usage")), held), ",").alias("missing"))


@query(f"SELECT category, score_a, score_b, rpad(repeat('#', CAST(score_a // 5 AS INTEGER)), 20, '.') AS bar_a, rpad(repeat('#', CAST(score_b // 5 AS INTEGER)), 20, '.') AS bar_b FROM {COMPARED}")
def duel_rows(spark, d):
    c = compare_categories(spark, d)
    bar = lambda x: F.rpad(F.repeat(F.lit("#"), F.floor(F.col(x) / 5).cast("int")), 20, ".")
    return c.select("category", "score_a", "score_b", bar("score_a").alias("bar_a"), bar("score_b").alias("bar_b"))


@query(f"SELECT value_key, min(job_id) AS job_id, count(*) AS asked FROM (SELECT job_id % 50 AS value_key, job_id FROM {LATEST} WHERE status IN ('queued', 'running')) GROUP BY 1")
def inflight_dedupe(spark, d):
    j = _jobs(spark, d).where("status in ('queued', 'running')")
    return j.groupBy((F.col("job_id") % 50).alias("value_key")).agg(F.min("job_id").alias("job_id"), F.count(F.lit(1)).alias("asked"))


@query(f"SELECT job_id, seq, status FROM (SELECT * FROM {LATEST} ORDER BY seq DESC LIMIT 200)")
def job_saved(spark, d):
    """Stored jobs after a second half of updates: an upsert that keeps the last 200."""
    e = _t(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("job_id"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"))
    return J.saved(J.latest(e.where("seq % 2 = 0")), e.where("seq % 2 = 1")).select("job_id", "seq", "status")


@query(f"SELECT job_id, seq FROM (SELECT *, row_number() OVER (ORDER BY finished, job_id) AS nth FROM {LATEST} WHERE status = 'queued') WHERE nth <= 40 - least(40, (SELECT count(*) FROM {LATEST} WHERE status = 'running' AND job_id % 97 = 0))")
def job_started(spark, d):
    """What the free ones of forty workers take; only some of the running jobs are theirs."""
    j = _jobs(spark, d).withColumn("status", F.when((F.col("status") == "running") & (F.col("job_id") % 97 != 0), "done").otherwise(F.col("status")))
    return J.started(j, 40).select("job_id", "seq")


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN status IN ('queued', 'running') THEN 'error' ELSE status END AS status FROM {LATEST}) GROUP BY 1")
def job_recovered(spark, d):
    return J.recovered(_jobs(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT job_id, seq, was, status, coalesce((was IS NULL AND status IN ('queued', 'done')) OR was || '>' || status IN ('queued>running', 'queued>error', 'running>done', 'running>error'), false) AS allowed FROM (SELECT job_id, seq, status, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS was FROM {JOBS}) WHERE was IS DISTINCT FROM status")
def job_transitions(spark, d):
    e = _t(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("job_id"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"))
    return J.transitions(e)


QUEUE_KEY = "CASE WHEN regexp_matches({0}, 'github\\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') THEN regexp_extract({0}, 'github\\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)', 1) || '/' || regexp_replace(regexp_extract({0}, 'github\\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)', 2), '\\.git$', '') ELSE 'unknown/unknown' END"
ASKED_KEYS = f"(SELECT page_id AS request_id, {QUEUE_KEY.format('x')} AS key FROM (SELECT page_id, {ADDRESS.replace('page_id ||', '(page_id % 50) ||').replace('|| page_id END', '|| (page_id % 50) END')} AS x FROM pages))"
KEYED = f"(SELECT *, CASE WHEN job_id % 9 = 0 THEN 'unknown/unknown' ELSE 'o/' || (job_id % 70) END AS key FROM {LATEST})"


@query(f"""WITH f AS (SELECT key, min(job_id) AS flight FROM {KEYED} WHERE status IN ('queued', 'running') AND job_id % 5 = 0 GROUP BY 1), c AS (SELECT key, arg_max(job_id, struct_pack(f := finished, j := job_id)) AS cached FROM {KEYED} WHERE status = 'done' AND finished > TIMESTAMP '2024-01-01' - INTERVAL 24 HOUR GROUP BY 1)
SELECT a.request_id, a.key, coalesce(flight, cached) AS job_id, CASE WHEN flight IS NOT NULL THEN 'attached' WHEN cached IS NOT NULL THEN 'cached' WHEN a.request_id = (SELECT min(b.request_id) FROM {ASKED_KEYS} b WHERE b.key = a.key) THEN 'new' ELSE 'attached' END AS how FROM {ASKED_KEYS} a LEFT JOIN f USING (key) LEFT JOIN c USING (key)""")
def job_enqueued(spark, d):
    """Requests by address: attached to a job in flight, served from a result, or a new job."""
    address = ADDRESS.replace("page_id ||", "(page_id % 50) ||").replace("|| page_id END", "|| (page_id % 50) END")
    asked = _t(spark, d, "pages").selectExpr("page_id AS request_id", f"{address} AS address")
    key = F.when(F.col("job_id") % 9 == 0, "unknown/unknown").otherwise(F.concat(F.lit("o/"), (F.col("job_id") % 70).cast("string")))
    jobs = _jobs(spark, d).withColumn("key", key).where("job_id % 5 = 0 or status not in ('queued', 'running')")
    return J.enqueued(asked, jobs, F.expr("TIMESTAMP_NTZ '2024-01-01'"))


@query(f"SELECT i.id, coalesce(r.o_orderkey, x.o_orderkey) AS result_id FROM (SELECT DISTINCT event_id AS id FROM events) i LEFT JOIN orders r ON r.o_orderkey = i.id LEFT JOIN (SELECT job_id, seq // 2 AS result FROM {LATEST} WHERE status = 'done') j ON j.job_id = i.id LEFT JOIN orders x ON x.o_orderkey = j.result")
def job_resolved(spark, d):
    """Ids that are of a result or of a job with one."""
    ids = _t(spark, d, "events").select(F.col("event_id").alias("id")).distinct()
    jobs = _jobs(spark, d).where("status = 'done'").select("job_id", F.expr("seq div 2").alias("result_id"))
    return J.resolved(ids, _t(spark, d, "orders").select(F.col("o_orderkey").alias("result_id")), jobs)


@query("SELECT p_partkey AS key, CASE WHEN len(p_name) > 12 THEN left(p_name, 11) || '…' ELSE p_name END AS short, replace(replace(replace(p_name || '<&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml, p_size || ' ' || CASE WHEN p_size = 1 THEN 'place' ELSE 'places' END AS counted FROM part")
def label_forms(spark, d):
    x = F.concat("p_name", F.lit("<&>"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("key"), T.shortened(F.col("p_name"), 12).alias("short"), T.xml(x).alias("xml"), T.plural(F.col("p_size"), "place", "places").alias("counted"))


@query(f"SELECT category, id, severity, k FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END, id) AS k FROM (SELECT DISTINCT category, id, severity FROM {FINDINGS} WHERE repo_id = 0 AND id NOT IN (SELECT id FROM {FINDINGS} WHERE repo_id = 30))) WHERE k <= 8")
def only_in_a_first(spark, d):
    """Findings of one side only, the most severe first, eight a category."""
    f = _findings(spark, d)
    own = f.where("repo_id = 0").select("category", "id", "severity").distinct().join(f.where("repo_id = 30").select("id"), "id", "left_anti")
    w = Window.partitionBy("category").orderBy(T.severity_rank(F.col("severity")), "id")
    return own.select("category", "id", "severity", F.row_number().over(w).cast("long").alias("k")).where("k <= 8")


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def external_hosts(spark, d):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return _t(spark, d, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(15)


@query(f"SELECT repo_id, pattern, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, pattern ORDER BY page_id) AS k FROM ({ORACLES['pattern_lines']})) WHERE k <= 12 GROUP BY 1, 2")
def pattern_findings(spark, d):
    w = Window.partitionBy("repo_id", "pattern").orderBy("page_id")
    return pattern_lines(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 12").groupBy("repo_id", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, 'user' || CAST(user_id AS VARCHAR) || '/' || event_type AS slug, CASE WHEN len(event_type) > 5 THEN left(event_type, 4) || '…' ELSE event_type END AS short FROM events")
def label_text(spark, d):
    cut = F.when(F.length("event_type") > 5, F.concat(F.left("event_type", F.lit(4)), F.lit("…"))).otherwise(F.col("event_type"))
    return _t(spark, d, "events").select("event_id", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("slug"), cut.alias("short"))


def _code(spark: SparkSession, d: str) -> DataFrame:
    """pages as code: their whole html with a function in front, every other one as Python."""
    html = F.coalesce("html", F.lit(""))
    js = F.concat(F.lit("function page"), "page_id", F.lit("(a) {\n  if (a && 'x') {\n    return /* none */ a;\n  }\n}\n"), html)
    py = F.concat(F.lit("import os, sys\ndef page"), "page_id", F.lit("(a):\n    if a or 'x':  # text\n        b = 1\n    return b\n"), html)
    even = F.col("page_id") % 2 == 0
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return _t(spark, d, "pages").select(F.coalesce(host, F.lit("")).alias("repo_id"), F.col("page_id").cast("string").alias("path"), F.when(even, js).otherwise(py).alias("raw"), F.when(even, "js").otherwise("python").alias("analysis"))


@query(None)
def lex_strip(spark, d):
    return _code(spark, d).select("repo_id", "path", L.strip(F.col("raw"), F.col("analysis")).alias("code"))


def _functions(spark: SparkSession, d: str, kind: str) -> DataFrame:
    f = _code(spark, d).where(F.col("analysis") == kind)
    return L.functions(f.withColumn("code", L.strip(F.col("raw"), F.col("analysis"))))


@query(None)
def js_functions(spark, d):
    return _functions(spark, d, "js")


@query(None)
def py_functions(spark, d):
    return _functions(spark, d, "python")


PAGES = "(SELECT page_id, 'import os, sys' || chr(10) || 'def page' || page_id || '(a):' || chr(10) || '    if a or ' || chr(39) || 'x' || chr(39) || ':  # text' || chr(10) || '        b = 1' || chr(10) || '    return b' || chr(10) || coalesce(html, '') AS raw FROM pages WHERE page_id % 2 = 1)"


@query(f"SELECT page_id, trim(unnest(string_split(x, ',')), ' ' || chr(9) || chr(10) || chr(13)) AS module FROM (SELECT page_id, unnest(regexp_extract_all(raw, '{R.PY_IMPORT}', 2)) AS x FROM {PAGES}) UNION ALL SELECT page_id, m FROM (SELECT page_id, unnest(regexp_extract_all(raw, '{R.PY_IMPORT}', 1)) AS m FROM {PAGES}) WHERE m <> ''")
def py_imports_raw(spark, d):
    """Imports of every other page as Python, as the operator gives them: a match goes on over line ends."""
    return I.imported(_code(spark, d).where("analysis = 'python'")).select(F.col("path").cast("long").alias("page_id"), F.col("spec").alias("module"))


@query("SELECT page_id, unnest(['os', 'sys']) AS module FROM pages WHERE page_id % 2 = 1")
def py_imports(spark, d):
    code = _code(spark, d).where("analysis = 'python'")
    found = F.regexp_extract_all("raw", F.lit(r"(?m)^\s*import\s+([A-Za-z0-9_., \t]+)"), F.lit(1))
    each = F.explode(F.flatten(F.transform(found, lambda x: F.split(x, ","))))
    return code.select(F.col("path").cast("long").alias("page_id"), each.alias("m")).select("page_id", F.trim("m").alias("module"))


@query(None)
def health_report(spark, d):
    """The flagship: findings of every repository, scored and graded."""
    return health.report(sources(spark, d).withColumn("is_test", F.pmod(F.xxhash64("path"), F.lit(10)) == 0))


@query(None)
def audit_report(spark, d):
    """All finding rules over pages as code, without facts of hosts and advisories."""
    code = _code(spark, d)
    tree = code.select(F.col("repo_id").cast("string").alias("repo_id"), F.concat(F.lit("src/page"), "path", F.when(F.col("analysis") == "js", ".js").otherwise(".py")).alias("path"), F.octet_length("raw").cast("long").alias("size"), "raw")
    meta = spark.createDataFrame([], "repo_id string, license string, contributors int, bus_factor int, archived boolean, pushed_at timestamp, languages array<string>")
    none = spark.createDataFrame([], "ecosystem string, name string, version string, vuln_id string")
    known, loaded = audit.facts(tree, meta, none, datetime(2025, 1, 1))
    return audit.report(known, audit.findings(known, loaded))
