"""Queries that run the shipped operators and the whole audit over the trees of trees.py, each with DuckDB SQL.

The SQL takes other ways than the operators where it can: rules match paths by comparing texts, not
keys; places of matches come from what lies between them; lexed code from a replacement of the
strings and comments that these trees hold; functions from counts of words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from treegauge import sql as audit_sql
from treegauge import trees as TR
from treegauge.functions import rules as R
from treegauge.functions import text as T
from treegauge.operators import deps as D
from treegauge.operators import ignore as IG
from treegauge.operators import imports as I
from treegauge.operators import layout as LO
from treegauge.operators import lexing as L
from treegauge.operators import secrets as S
from treegauge.plans import architecture as A
from treegauge.plans import audit, outputs, results, scoring
from treegauge.scratch import folder, written
from treegauge.sources import landed as LA

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = datetime(2025, 1, 1)


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def q(text: str) -> str:
    return text.replace("'", "''")


def sql_list(xs: list[str]) -> str:
    return ", ".join(f"'{q(x)}'" for x in xs)


class _Run:
    """The audit of the trees of a folder; what a query doesn't ask for isn't made."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d

    @cached_property
    def tree(self) -> DataFrame:
        # written, since its expressions are long, and filters would repeat them
        return written(TR.tree(self.spark, self.d))

    @cached_property
    def p(self) -> audit.Parts:
        return audit.Parts(self.tree, TR.advisories(self.spark))

    @cached_property
    def known(self) -> DataFrame:
        return audit.known(self.p, self.meta, NOW)

    @cached_property
    def meta(self) -> DataFrame:
        return LA.repo_meta(TR.landed(self.spark, self.d))

    @cached_property
    def found(self) -> DataFrame:
        return audit.findings(self.known, self.p.code)

    @cached_property
    def scores(self) -> DataFrame:
        return audit.scores(self.known, self.found)

    @cached_property
    def graded(self) -> DataFrame:
        return scoring.overall(self.scores)

    @cached_property
    def notes(self) -> DataFrame:
        stats = IG.walk_stats(self.tree, IG.ignore_rules(self.tree))
        return audit.notes(self.known, stats, self.found).join(stats.select("repo_id", "files_total"), "repo_id", "left")


DIM = ", ".join(f"('{e}', '{name}', '{kind}')" for name, kind, exts in R.LANGUAGES for e in exts.split())
ORDER = "replace(lower({0}), '_', '!')"
BY_FILE = ORDER.format("path")
WALK = f"""WITH tree AS (SELECT t.*, lower(path) AS low, string_split(path, '/')[-1] AS base, string_split(lower(path), '/')[:-2] AS above, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) AS ext FROM {TR.TREE_SQL} t),
line AS (SELECT repo_id, trim(x, ' ' || chr(9) || chr(13)) AS x FROM (SELECT repo_id, unnest(string_split(raw, chr(10))) AS x FROM tree WHERE path = '.gitignore')),
word AS (SELECT DISTINCT repo_id, lower(regexp_replace(regexp_replace(x, '^/', ''), '/$', '')) AS c FROM line WHERE x <> '' AND x[1] NOT IN ('#', '!')),
rule AS (SELECT repo_id, CASE WHEN contains(c, '*') OR contains(c, '/') THEN c WHEN contains(c, '.') THEN '*' || c END AS pat, CASE WHEN NOT regexp_matches(c, '[*/.]') THEN c END AS dir FROM word WHERE c <> ''),
plain AS (SELECT *, list_has_any(above, [{sql_list(R.IGNORED_DIRS)}]) AS gone, lower(base) IN ({sql_list(R.IGNORED_FILES)}) OR {' OR '.join(f"ends_with(low, '{s}')" for s in R.IGNORED_SUFFIXES)} AS off FROM tree),
judged AS (SELECT p.*, p.gone OR EXISTS (SELECT 1 FROM rule r WHERE r.repo_id = p.repo_id AND list_contains(p.above, r.dir)) AS in_dir,
 p.off OR EXISTS (SELECT 1 FROM rule r WHERE r.repo_id = p.repo_id AND (CASE WHEN starts_with(r.pat, '*.') THEN ends_with(p.low, substr(r.pat, 2)) ELSE p.low = r.pat OR starts_with(p.low, r.pat || '/') END)) AS by_name FROM plain p),
walked AS (SELECT j.repo_id, j.path, j.size, j.raw, j.base, j.ext, d.lang, d.analysis, regexp_matches(low, '{R.TEST_PATH}') AS is_test, lower(base) IN ({sql_list(R.LOCKS)}) AS is_lock,
 base IN ({sql_list(R.AUX)}) OR regexp_matches(base, '{R.README}') OR regexp_matches(path, '{R.WORKFLOW}') OR regexp_matches(path, '{R.AUX_FOLDER}') AS is_aux
 FROM judged j LEFT JOIN (VALUES {DIM}) d(ext, lang, analysis) ON j.ext = d.ext WHERE NOT in_dir AND NOT by_name AND j.ext NOT IN ({sql_list(R.BINARY)})),
loaded AS (SELECT repo_id, path, size, raw, base, lang, is_test, is_lock, CASE WHEN lang IS NULL THEN 'generic' ELSE analysis END AS analysis, CASE WHEN raw = '' THEN 0 ELSE len(string_split(raw, chr(10))) END AS lines FROM walked
 WHERE NOT is_aux AND (regexp_matches(base, '{R.CREDENTIAL_READ}') OR (lang IS NOT NULL AND analysis <> 'none'))),
script AS (SELECT *, CASE analysis WHEN 'js' THEN regexp_replace(raw, '"[^"\\n]*"', ' ', 'g') ELSE regexp_replace(raw, '#[^\\n]*', ' ', 'g') END AS code FROM loaded WHERE analysis IN ('js', 'python')),
man AS (SELECT repo_id, path, raw AS content FROM walked WHERE is_aux)"""


@query(f"{WALK} SELECT repo_id, CASE WHEN pat IS NULL THEN 'dir' WHEN starts_with(pat, '*.') THEN 'suffix' ELSE 'path' END AS kind, CASE WHEN pat IS NULL THEN dir WHEN starts_with(pat, '*.') THEN substr(pat, 2) ELSE pat END AS pattern FROM rule")
def tree_ignore_rules(spark, d):
    return IG.ignore_rules(_Run(spark, d).tree)


@query(f"{WALK} SELECT repo_id, '{R.IGNORED_DIRS[0]}' AS pattern FROM (SELECT DISTINCT repo_id FROM tree) UNION SELECT repo_id, unnest([{sql_list(R.IGNORED_DIRS)}]) FROM (SELECT DISTINCT repo_id FROM tree) UNION SELECT repo_id, dir FROM rule WHERE dir IS NOT NULL")
def tree_ignored_folders(spark, d):
    """Default and own folders of each repository: a union without repeats."""
    t = _Run(spark, d).tree
    own = IG.ignore_rules(t).where("kind = 'dir'")
    return IG.default_rules(t.select("repo_id").distinct()).union(own).select("repo_id", "pattern").distinct()


@query(f"{WALK} SELECT repo_id, path, size, lang, analysis, is_test, is_lock, is_aux FROM walked")
def tree_walked(spark, d):
    return _Run(spark, d).p.files.select("repo_id", "path", "size", "lang", "analysis", "is_test", "is_lock", "is_aux")


@query(f"{WALK} SELECT repo_id, count(*) FILTER (WHERE NOT in_dir) AS files_total, count(*) FILTER (WHERE NOT in_dir AND by_name) + count(DISTINCT CASE WHEN in_dir THEN string_split(path, '/')[1] || CASE WHEN starts_with(path, 'lib/') THEN path ELSE '' END END) AS skipped FROM judged GROUP BY 1")
def tree_walk_stats(spark, d):
    t = _Run(spark, d).tree
    return IG.walk_stats(t, IG.ignore_rules(t))


@query(f"{WALK} SELECT repo_id, path, analysis, CAST(lines AS BIGINT) AS lines, regexp_matches(base, '{R.CREDENTIAL_READ}') AS named FROM loaded")
def tree_loaded(spark, d):
    return _Run(spark, d).p.code.select("repo_id", "path", "analysis", "lines", F.col("base").rlike(R.CREDENTIAL_READ.replace("$", r"\z")).alias("named"))


COUNTED = f"""SELECT repo_id, CAST(sum(CASE WHEN path = 'package.json' AND json_valid(content) THEN len(coalesce(json_keys(content, '$.dependencies'), [])) + len(coalesce(json_keys(content, '$.devDependencies'), []))
 WHEN regexp_matches(path, '{R.REQUIREMENTS}') THEN len(regexp_extract_all(content, '{q(R.REQUIRED)}'))
 WHEN path = 'go.mod' THEN CASE WHEN contains(content, '(') THEN len(regexp_extract_all(string_split(string_split(content, '(')[2], ')')[1], '{q(R.GO_BLOCK_LINE)}')) ELSE len(regexp_extract_all(content, '{q(R.GO_LINE)}')) END
 WHEN path = 'pom.xml' THEN len(string_split(content, '<dependency>')) - 1 ELSE 0 END) AS BIGINT) AS direct FROM man GROUP BY 1"""


@query(f"{WALK} {COUNTED}")
def tree_direct_deps(spark, d):
    return _Run(spark, d).p.direct


def _pair_sql(where: str, pattern: str, calm: bool = False) -> str:
    name = "regexp_replace(lower(n), '[-_.]+', '-', 'g')" if calm else "n"
    return f"SELECT repo_id, path, {name} AS name, version FROM (SELECT repo_id, path, unnest(regexp_extract_all(content, '{q(pattern)}', 1)) AS n, unnest(regexp_extract_all(content, '{q(pattern)}', 2)) AS version FROM man WHERE {where})"


PIN = f"""pin AS (SELECT DISTINCT repo_id, CASE WHEN path IN ('package-lock.json', 'pnpm-lock.yaml') THEN 'npm' WHEN path = 'Cargo.lock' THEN 'cargo' WHEN path = 'composer.lock' THEN 'composer' ELSE 'pip' END AS ecosystem, name, version FROM (
 SELECT repo_id, path, regexp_replace(k, '^node_modules/', '') AS name, j AS version FROM (SELECT repo_id, path, k, json_extract_string(content, '$.packages."' || k || '".version') AS j FROM (SELECT repo_id, path, content, unnest(json_keys(content, '$.packages')) AS k FROM man WHERE path = 'package-lock.json' AND json_extract(content, '$.packages') IS NOT NULL)) WHERE k <> '' AND NOT contains(substr(k, 14), '/node_modules/')
 UNION ALL SELECT repo_id, path, unnest(regexp_extract_all(content, '"([a-z]+)": .?"version": "([^"]+)"', 1)), unnest(regexp_extract_all(content, '"([a-z]+)": .?"version": "([^"]+)"', 2)) FROM man WHERE path = 'package-lock.json' AND json_extract(content, '$.packages') IS NULL
 UNION ALL {_pair_sql("path = 'pnpm-lock.yaml'", R.PINS["pnpm"])} UNION ALL {_pair_sql(f"regexp_matches(path, '{R.REQUIREMENTS}')", R.PINS["requirements"], True)}
 UNION ALL {_pair_sql("path = 'poetry.lock'", R.PINS["poetry"], True)} UNION ALL {_pair_sql("path = 'Cargo.lock'", R.PINS["cargo"])}
 UNION ALL SELECT repo_id, path, unnest(regexp_extract_all(content, '"name": "([^"]+)", "version": "v?([^"]+)"', 1)), unnest(regexp_extract_all(content, '"name": "([^"]+)", "version": "v?([^"]+)"', 2)) FROM man WHERE path = 'composer.lock'
) WHERE regexp_matches(version, '^[0-9]') AND NOT contains(version, '*'))"""


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    return _Run(spark, d).p.files.where("is_aux").select("repo_id", "path", F.col("raw").alias("content"))


@query(f"{WALK}, {PIN} SELECT * FROM pin")
def tree_pinned(spark, d):
    return D.pinned(_manifests(spark, d))


@query(f"""{WALK}, {PIN} SELECT * FROM pin UNION SELECT repo_id, 'npm', split_part(replace(head, '"', ''), ' ', 1)[:-2], version FROM (SELECT repo_id, CASE WHEN starts_with(b, '"@') THEN '@' || split_part(b, '@', 2) || '@' ELSE split_part(b, '@', 1) || '@' END AS head, regexp_extract(b, 'version "([^"]+)"', 1) AS version FROM (SELECT repo_id, trim(unnest(string_split(replace(content, '# yarn' || chr(10), ''), chr(10) || chr(10))), chr(10)) AS b FROM man WHERE path = 'yarn.lock')) WHERE version <> ''
 UNION SELECT repo_id, 'go', split_part(l, ' ', 1), substr(split_part(l, ' ', 2), 2) FROM (SELECT repo_id, unnest(string_split(content, chr(10))) AS l FROM man WHERE path = 'go.sum') WHERE contains(l, ' h1:') AND NOT contains(l, '/go.mod')""")
def tree_pinned_fixed(spark, d):
    """With the locks that the compatible mode doesn't read."""
    return D.pinned(_manifests(spark, d), fixed=True)


SERVICE = "CASE ecosystem " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in R.ECOSYSTEMS.items()) + " END"
BAD = f"bad AS (SELECT repo_id, p.ecosystem, p.name, p.version, least(count(DISTINCT a.vuln_id), 8) AS n, array_to_string(list_sort(list(DISTINCT a.vuln_id))[:8], ',') AS vulns FROM (SELECT *, {SERVICE} AS service FROM pin) p JOIN {TR.ADVICE_SQL} a ON a.ecosystem = p.service AND a.name = p.name AND a.version = p.version GROUP BY 1, 2, 3, 4)"


@query(f"{WALK}, {PIN}, {BAD} SELECT repo_id, ecosystem, name, version, vulns, n, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, ecosystem, name, version) AS place FROM bad")
def tree_vulnerable(spark, d):
    bad = D.top_vulnerable(_Run(spark, d).p.bad)
    return bad.select("repo_id", "ecosystem", "name", "version", F.array_join("vulns", ",").alias("vulns"), F.size("vulns").cast("long").alias("n"), F.col("place").cast("long").alias("place"))


@query(f"{WALK}, {PIN} SELECT repo_id, CAST(k // 2 AS INTEGER) AS request, count(*) AS n, string_agg({SERVICE} || ' ' || name || ' ' || version, ',' ORDER BY k) AS asked FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ecosystem, name, version) - 1 AS k FROM pin) GROUP BY 1, 2")
def tree_advice_requests(spark, d):
    body = F.from_json("body", "queries array<struct<package:struct<name:string,ecosystem:string>,version:string>>")["queries"]
    r = D.advice_requests(D.pinned(_manifests(spark, d)), 2)
    return r.select("repo_id", "request", "n", F.array_join(F.transform(body, lambda x: F.concat_ws(" ", x["package"]["ecosystem"], x["package"]["name"], x["version"])), ",").alias("asked"))


def _import_sql() -> str:
    js = " UNION ALL ".join(f"SELECT repo_id, path, analysis, unnest(regexp_extract_all(raw, '{q(p)}', 1)) AS spec FROM script WHERE analysis = 'js'" for p in R.JS_IMPORTS)
    py = f"SELECT repo_id, path, analysis, unnest(regexp_extract_all(raw, '{q(R.PY_IMPORT)}', 1)) AS spec FROM script WHERE analysis = 'python' UNION ALL SELECT repo_id, path, analysis, trim(unnest(string_split(s, ',')), ' ' || chr(10)) FROM (SELECT repo_id, path, analysis, unnest(regexp_extract_all(raw, '{q(R.PY_IMPORT)}', 2)) AS s FROM script WHERE analysis = 'python')"
    return f"ref AS (SELECT * FROM ({js} UNION ALL {py}) WHERE spec <> '')"


REF = _import_sql()
# ../ goes up one folder; the trees hold no deeper steps
JOINED = "CASE WHEN starts_with(spec, '../') THEN array_to_string(string_split(path, '/')[:-3] || [substr(spec, 4)], '/') ELSE array_to_string(string_split(path, '/')[:-2] || [substr(spec, 3)], '/') END"
TAILS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(R.JS_TAILS))
FORMS = ", ".join(f"({i}, '{h}', '{t}')" for i, (h, t) in enumerate(R.PY_FORMS))
LINK = f"""once AS (SELECT repo_id, path, analysis, spec, count(*) AS n FROM ref WHERE analysis = 'python' OR starts_with(spec, '.') GROUP BY 1, 2, 3, 4),
tried AS (SELECT repo_id, path, spec, n, k, lower({JOINED} || t) AS low FROM once, (VALUES {TAILS}) v(k, t) WHERE analysis = 'js' UNION ALL SELECT repo_id, path, spec, n, k, lower(h || replace(spec, '.', '/') || t) FROM once, (VALUES {FORMS}) v(k, h, t) WHERE analysis = 'python'),
link AS (SELECT o.repo_id, o.path, o.spec, o.n, (SELECT s.path FROM tried t JOIN script s ON s.repo_id = t.repo_id AND lower(s.path) = t.low WHERE t.repo_id = o.repo_id AND t.path = o.path AND t.spec = o.spec ORDER BY t.k LIMIT 1) AS target FROM once o),
edge AS (SELECT repo_id, path AS src, target AS dst, CAST(sum(n) AS BIGINT) AS weight FROM link WHERE target IS NOT NULL AND target <> path GROUP BY 1, 2, 3)"""
MODULE = "CASE WHEN NOT contains({0}, '/') THEN '(root)' WHEN split_part({0}, '/', 1) IN ('src', 'lib', 'app', 'packages', 'server', 'client') AND len(string_split({0}, '/')) > 2 THEN split_part({0}, '/', 1) || '/' || split_part({0}, '/', 2) ELSE split_part({0}, '/', 1) END"


@query(f"{WALK}, {REF} SELECT repo_id, path, spec, count(*) AS n FROM ref GROUP BY 1, 2, 3")
def tree_imports(spark, d):
    return _Run(spark, d).p.refs.groupBy("repo_id", "path", "spec").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WALK}, {REF} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, package) AS place FROM (SELECT repo_id, CASE WHEN starts_with(spec, '@') THEN array_to_string(string_split(spec, '/')[:2], '/') ELSE split_part(spec, '/', 1) END AS package, count(*) AS n FROM ref WHERE analysis = 'js' AND NOT starts_with(spec, '.') GROUP BY 1, 2)) WHERE place <= 15")
def tree_packages(spark, d):
    return A.top_packages(_Run(spark, d).p.refs).withColumn("place", F.col("place").cast("long"))


@query(f"{WALK}, {REF}, {LINK} SELECT repo_id, path, spec, n, target FROM link")
def tree_links(spark, d):
    return _Run(spark, d).p.links


@query(f"{WALK}, {REF}, {LINK} SELECT repo_id, CAST(sum(CASE WHEN target IS NULL THEN n ELSE 0 END) AS BIGINT) AS unresolved FROM link GROUP BY 1")
def tree_unresolved(spark, d):
    return A.unresolved(_Run(spark, d).p.links)


FUN = """fun AS (SELECT repo_id, path, analysis, CASE WHEN analysis = 'js' THEN 1 + len(regexp_extract_all(code, '\\bif\\b|&&')) WHEN contains(code, 'def deep') THEN 1 + len(regexp_extract_all(code, '\\bif\\b')) ELSE 1 END AS complexity,
 CASE WHEN analysis = 'js' THEN 2 WHEN contains(code, 'def deep') THEN 8 ELSE 1 END AS nesting, len(string_split(split_part(code, 'def deep', 1), chr(10))) AS deep_line, len(string_split(code, CASE analysis WHEN 'js' THEN 'function gate' ELSE 'def ' END)) - 1 AS times FROM script WHERE regexp_matches(code, 'function gate|def '))"""
NODE = f"fnode AS (SELECT s.repo_id, s.path AS id, s.lines AS loc, coalesce(f.complexity, 0) AS complexity FROM script s LEFT JOIN fun f USING (repo_id, path)), mnode AS (SELECT repo_id, {MODULE.format('id')} AS id, CAST(sum(loc) AS BIGINT) AS loc, max(complexity) AS complexity FROM fnode GROUP BY 1, 2), medge AS (SELECT repo_id, a AS src, b AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT repo_id, {MODULE.format('src')} AS a, {MODULE.format('dst')} AS b, weight FROM edge) WHERE a <> b GROUP BY 1, 2, 3)"


def _graph_sql(node: str, edge: str) -> str:
    return f"{WALK.replace('WITH tree', 'WITH RECURSIVE tree', 1)}, {REF}, {LINK}, {FUN}, {NODE}, reach(repo_id, a, b) AS (SELECT repo_id, src, dst FROM {edge} UNION SELECT r.repo_id, r.a, e.dst FROM reach r JOIN {edge} e ON r.repo_id = e.repo_id AND r.b = e.src), loop AS (SELECT DISTINCT x.repo_id, x.a AS id FROM reach x JOIN reach y ON x.repo_id = y.repo_id AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b), decorated AS (SELECT n.repo_id, n.id, CAST(n.loc AS BIGINT) AS loc, CAST(n.complexity AS INTEGER) AS complexity, CAST(coalesce((SELECT sum(weight) FROM {edge} e WHERE e.repo_id = n.repo_id AND e.dst = n.id), 0) AS BIGINT) AS fan_in, CAST(coalesce((SELECT sum(weight) FROM {edge} e WHERE e.repo_id = n.repo_id AND e.src = n.id), 0) AS BIGINT) AS fan_out, EXISTS (SELECT 1 FROM loop l WHERE l.repo_id = n.repo_id AND l.id = n.id) AS in_cycle FROM {node} n)"


MGRAPH, FGRAPH = _graph_sql("mnode", "medge"), _graph_sql("fnode", "edge")
EDGE_FLAG = "SELECT e.repo_id, e.src, e.dst, e.weight, x.id IS NOT NULL AND y.id IS NOT NULL AS in_cycle FROM {0} e LEFT JOIN loop x ON x.repo_id = e.repo_id AND x.id = e.src LEFT JOIN loop y ON y.repo_id = e.repo_id AND y.id = e.dst"


def _graph(spark: SparkSession, d: str, kind: Callable) -> tuple[DataFrame, DataFrame]:
    p = _Run(spark, d).p
    # only what has functions is lexed, and only they are written
    script = p.texts.where(F.col("analysis").isin("js", "python"))
    functions = written(L.functions(script.withColumn("code", L.strip(F.col("raw"), F.col("analysis")))))
    return kind(script, functions, p.edges)


@query(f"{MGRAPH} SELECT * FROM decorated")
def tree_module_nodes(spark, d):
    return _graph(spark, d, A.module_graph)[0]


@query(f"{MGRAPH} {EDGE_FLAG.format('medge')}")
def tree_module_edges(spark, d):
    return _graph(spark, d, A.module_graph)[1]


@query(f"{FGRAPH} SELECT * FROM decorated")
def tree_file_nodes(spark, d):
    return _graph(spark, d, A.file_graph)[0]


@query(f"{FGRAPH} {EDGE_FLAG.format('edge')}")
def tree_file_edges(spark, d):
    return _graph(spark, d, A.file_graph)[1]


@query(f"{MGRAPH} SELECT * FROM (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY fan_in DESC, loc DESC, id) AS place, id, fan_in FROM decorated) WHERE place <= 5")
def tree_top_fan_in(spark, d):
    return A.top_fan_in(_graph(spark, d, A.module_graph)[0]).withColumn("place", F.col("place").cast("long"))


@query(f"{MGRAPH} SELECT repo_id, id, round(12 + sqrt(loc / greatest(1, max(loc) OVER (PARTITION BY repo_id)) * 26), 6) AS radius FROM decorated")
def tree_radii(spark, d):
    return A.radii(_graph(spark, d, A.module_graph)[0]).select("repo_id", "id", F.round("radius", 6).alias("radius"))


@query(None)
def tree_layout(spark, d):
    n, e = _graph(spark, d, A.module_graph)
    return LO.layout(n, e)


@query(f"{WALK}, {FUN} SELECT repo_id, path, CAST(complexity AS INTEGER) AS complexity, CAST(nesting AS INTEGER) AS nesting, times AS n FROM fun")
def tree_functions(spark, d):
    """Functions of these trees; those of one file are alike."""
    return _Run(spark, d).p.functions.groupBy("repo_id", "path", "complexity", "nesting").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WALK}, {FUN} SELECT repo_id, CAST(max(complexity) AS INTEGER) AS most, round(sum(complexity * times) / sum(times), 1) AS mean FROM fun GROUP BY 1")
def tree_complexity(spark, d):
    k = _Run(spark, d).known
    return k.where("functions > 0").select("repo_id", F.col("most_complex").alias("most"), F.round("mean_complex", 1).alias("mean"))


def secret_sql(src: str) -> str:
    """(repo_id, path, pattern, nth, line, value, entropy) of surviving secrets in src, placed by the text between matches."""
    part = []
    for name, p, group in R.SECRETS:
        part.append(f"SELECT repo_id, path, raw, '{name}' AS pattern, regexp_extract_all(raw, '{q(p)}', 0) AS m, regexp_extract_all(raw, '{q(p)}', {group}) AS v, string_split_regex(raw, '{q(p)}') AS gaps FROM {src} WHERE regexp_matches(raw, '{q(p)}')")
    at = "coalesce(list_sum(list_transform(gaps[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)"
    placed = f"SELECT repo_id, path, pattern, CAST(i - 1 AS INTEGER) AS nth, v[i] AS value, CAST(1 + len(string_split(left(raw, CAST({at} AS BIGINT)), chr(10))) - 1 AS INTEGER) AS line, string_split(substr(raw, CAST({at} AS BIGINT) + 1), chr(10))[1] AS rest FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({' UNION ALL '.join(part)}))"
    entropy = "list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -(len(list_filter(string_split(value, ''), lambda x: x = c)) / len(value)) * log2(len(list_filter(string_split(value, ''), lambda x: x = c)) / len(value))))"
    kept = f"SELECT repo_id, path, pattern, nth, line, value, {entropy} AS entropy FROM ({placed}) WHERE NOT regexp_matches(value, '{R.PLACEHOLDER}') AND NOT regexp_matches(rest, '{R.ENV_CONTEXT}')"
    return f"(SELECT * FROM ({kept}) WHERE pattern <> 'security.generic' OR (len(value) >= 10 AND entropy >= 3.0 AND lower(value) NOT IN ({sql_list(R.RESERVED)})))"


SCANNED = "(SELECT * FROM loaded WHERE size <= 300000 AND NOT is_lock AND analysis <> 'none')"
SECRET = f"secret AS (SELECT *, row_number() OVER (PARTITION BY repo_id, pattern ORDER BY {BY_FILE}, nth) AS place FROM {secret_sql(SCANNED)})"
SEEN = f"""seen AS (SELECT repo_id, pattern AS id, CASE WHEN bool_or(regexp_matches(path, '{R.SECRET_TEST_PATH}')) THEN CASE pattern WHEN 'security.generic' THEN 'minor' ELSE 'major' END ELSE CASE pattern WHEN 'security.generic' THEN 'major' ELSE 'critical' END END AS severity, count(*) AS n FROM secret WHERE place <= 12 GROUP BY repo_id, pattern)"""


@query(f"{WALK}, {SECRET} SELECT repo_id, path, pattern, nth, line, value, round(entropy, 6) AS entropy FROM secret")
def tree_secrets(spark, d):
    return S.secret_matches(_Run(spark, d).p.texts.where("size <= 300000 and not is_lock and analysis <> 'none'")).withColumn("entropy", F.round("entropy", 6))


@query(f"{WALK}, {SECRET}, {SEEN} SELECT repo_id, id AS pattern, n, severity FROM seen")
def tree_secret_findings(spark, d):
    return S.secret_findings(S.secret_matches(_Run(spark, d).p.texts.where("size <= 300000 and not is_lock and analysis <> 'none'")))


RISK = "risk AS (SELECT *, row_number() OVER (PARTITION BY repo_id, pattern ORDER BY " + BY_FILE + ", line) AS place FROM (" + " UNION ALL ".join(f"SELECT repo_id, path, line, '{n}' AS pattern, '{sev}' AS severity FROM (SELECT repo_id, path, analysis, unnest(string_split(raw, chr(10))) AS t, generate_subscripts(string_split(raw, chr(10)), 1) AS line FROM loaded WHERE NOT is_test) WHERE analysis IN ({sql_list(langs.split())}) AND regexp_matches(t, '{q(p)}')" for n, p, langs, sev in R.DANGEROUS) + "))"
WINDOW = f"""cline AS (SELECT repo_id, path, line, t FROM (SELECT repo_id, path, line, trim(regexp_replace(x, '[ \\t\\r\\f\\v]+', ' ', 'g')) AS t FROM (SELECT repo_id, path, unnest(string_split(code, chr(10))) AS x, generate_subscripts(string_split(code, chr(10)), 1) AS line FROM script)) WHERE len(t) >= {R.CLONE_LEAST} AND NOT regexp_matches(t, '{R.CLONE_SKIP}')),
win AS (SELECT repo_id, path, line, md5(array_to_string(run, chr(10))) AS key FROM (SELECT repo_id, path, line, list(t) OVER (PARTITION BY repo_id, path ORDER BY line ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS run FROM cline) WHERE len(run) = 7),
clone AS (SELECT repo_id, key, count(*) AS n, min(struct_pack(o := {BY_FILE}, l := line)) AS first FROM win GROUP BY 1, 2 HAVING count(*) > 1)"""
MARKS = f"len(regexp_extract_all(raw, '{R.MARKERS}'))"
IS_COMMENT = "regexp_matches(ltrim(x, ' ' || chr(9) || chr(13)), '^(//|/\\*|\\*|#)') AND NOT starts_with(ltrim(x, ' ' || chr(9) || chr(13)), '#!') AND len(ltrim(x, ' ' || chr(9) || chr(13))) > 2"
CRED = "CASE WHEN regexp_matches(base, '^\\.env(\\..+)?$') AND NOT regexp_matches(base, '(?i)(example|sample|template|dist)') THEN 'major' WHEN regexp_matches(base, '\\.(pem|p12|pfx)$|^id_(rsa|dsa|ecdsa|ed25519)') THEN 'critical' WHEN ends_with(base, '.tfstate') THEN 'major' WHEN regexp_matches(base, '(?i)^(credentials?|service[-_]?account[^/]*)\\.json$') THEN 'critical' END"
META = f"""told AS (SELECT repo_id, repo::JSON AS r, coalesce(languages, '{{}}')::JSON AS l, CAST(json_extract(coalesce(contributors, '[]')::JSON, '$[*].contributions') AS BIGINT[]) AS c FROM {TR.LANDED_SQL}),
meta AS (SELECT repo_id, r->'owner'->>'login' AS owner, r->>'name' AS name, CAST(r->>'stargazers_count' AS BIGINT) AS stars, array_to_string(list_transform(list_sort(list_transform(json_keys(l), lambda k: struct_pack(n := -CAST(l->>k AS BIGINT), k := k))), lambda s: s.k), ',') AS languages,
 nullif(r->'license'->>'spdx_id', 'NOASSERTION') AS license, CAST(CAST(r->>'pushed_at' AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) AS pushed_at, CAST(len(c) AS INTEGER) AS contributors,
 CAST(coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: list_sum(c[1:i]) * 2 >= list_sum(c))), len(c)) AS INTEGER) AS bus_factor, CAST(r->>'archived' AS BOOLEAN) AS archived FROM told)"""


@query(f"WITH {META} SELECT repo_id, owner, name, stars, languages, license, strftime(pushed_at, '%Y-%m-%d %H:%M:%S') AS pushed_at, contributors, bus_factor, archived FROM meta")
def repo_meta(spark, d):
    m = LA.repo_meta(TR.landed(spark, d))
    return m.select("repo_id", "owner", "name", "stars", F.array_join("languages", ",").alias("languages"), "license", F.date_format("pushed_at", "yyyy-MM-dd HH:mm:ss").alias("pushed_at"), "contributors", "bus_factor", "archived")


FACT = f"""ff AS (SELECT repo_id, count(*) AS files, arg_min(raw, {BY_FILE}) FILTER (WHERE regexp_matches(base, '{R.README}')) AS readme, bool_or(regexp_matches(base, '{R.LICENSE_FILE}')) AS license_file, bool_or(regexp_matches(path, '{R.CONTRIBUTING}')) AS contributing,
 bool_or(regexp_matches(path, '{R.WORKFLOW}') OR path IN ('.gitlab-ci.yml', 'Jenkinsfile')) AS ci, bool_or(regexp_matches(path, '{R.WORKFLOW}') AND regexp_matches(raw, '{R.TEST_COMMAND}')) AS ci_tests,
 bool_or(path IN ('codecov.yml', '.coveragerc') OR (path = 'pyproject.toml' AND contains(raw, '[tool.coverage]')) OR (path = 'setup.cfg' AND contains(raw, '[coverage')) OR (regexp_matches(path, '{R.WORKFLOW}') AND regexp_matches(raw, '{R.COVERAGE}'))) AS coverage,
 bool_or(lower(base) IN ({sql_list(R.LINTER_FILES)}) OR (path IN ('pyproject.toml', 'Cargo.toml') AND regexp_matches(raw, '{R.LINTER_TABLE}'))) AS linter, bool_or(path = 'package.json') AS package_json, bool_or(path IN ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'npm-shrinkwrap.json')) AS npm_lock,
 bool_or(path IN ('poetry.lock', 'Pipfile.lock') OR (regexp_matches(path, '{R.REQUIREMENTS}') AND is_aux)) AS pip_pins FROM walked GROUP BY 1),
cf AS (SELECT repo_id, count(*) AS analysed, CAST(sum(lines) AS BIGINT) AS loc, CAST(sum(len(list_filter(string_split(raw, chr(10)), lambda x: {IS_COMMENT}))) AS BIGINT) AS comments, CAST(sum(CASE WHEN analysis <> 'none' AND is_test THEN lines ELSE 0 END) AS BIGINT) AS test_loc, CAST(sum(CASE WHEN analysis <> 'none' AND NOT is_test THEN lines ELSE 0 END) AS BIGINT) AS source_loc,
 count(*) FILTER (WHERE analysis <> 'none' AND is_test) AS test_files, coalesce(max(lines) FILTER (WHERE analysis IN ('js', 'python')), 0) AS longest, bool_or(analysis = 'js') AS has_js, CAST(sum({MARKS}) AS BIGINT) AS markers, count({CRED}) AS credentials, bool_or({CRED} = 'critical') AS worst FROM loaded GROUP BY 1),
uf AS (SELECT repo_id, CAST(sum(times) AS BIGINT) AS functions, CAST(sum(CASE WHEN complexity > 15 THEN times ELSE 0 END) AS BIGINT) AS complex, max(nesting) AS nesting FROM fun GROUP BY 1),
vf AS (SELECT repo_id, CAST(sum(n) AS BIGINT) AS vulns, count(*) AS bad_deps FROM bad GROUP BY 1),
df AS (SELECT repo_id, max(n) AS crowd FROM (SELECT repo_id, regexp_extract(path, '^(.*)/', 1) AS dir, count(*) AS n FROM loaded WHERE contains(path, '/') GROUP BY 1, 2) GROUP BY 1),
lf AS (SELECT e.repo_id, coalesce(c.d, 0) / e.n AS clones FROM (SELECT repo_id, count(*) AS n FROM cline GROUP BY 1) e LEFT JOIN (SELECT repo_id, sum((n - 1) * 7) AS d FROM clone GROUP BY 1) c USING (repo_id)),
gf AS (SELECT repo_id, count(*) AS looped FROM loop GROUP BY 1),
known AS (SELECT ff.*, cf.* EXCLUDE (repo_id), coalesce(functions, 0) AS functions, coalesce(complex, 0) AS complex, coalesce(nesting, 0) AS nesting, coalesce(direct, 0) AS direct, coalesce(vulns, 0) AS vulns, coalesce(bad_deps, 0) AS bad_deps, coalesce(crowd, 0) AS crowd, coalesce(clones, 0) AS clones, coalesce(looped, 0) AS looped, license, contributors, bus_factor, archived, pushed_at, languages, CASE WHEN source_loc > 0 THEN test_loc / source_loc ELSE 0 END AS ratio
 FROM ff LEFT JOIN cf USING (repo_id) LEFT JOIN uf USING (repo_id) LEFT JOIN vf USING (repo_id) LEFT JOIN df USING (repo_id) LEFT JOIN lf USING (repo_id) LEFT JOIN gf USING (repo_id) LEFT JOIN ({COUNTED}) dd USING (repo_id) LEFT JOIN meta USING (repo_id))"""
HEAD = f"{MGRAPH}, {PIN}, {BAD}, {WINDOW}, {META}, {FACT}"


@query(f"{HEAD} SELECT repo_id, files, analysed, loc, comments, test_loc, source_loc, test_files, CAST(longest AS BIGINT) AS longest, markers, credentials, functions, complex, CAST(nesting AS INTEGER) AS nesting, direct, vulns, bad_deps, crowd, round(clones, 6) AS clones, license_file, contributing, ci, ci_tests, coverage, linter, package_json, npm_lock, pip_pins, md5(readme) AS readme FROM known")
def audit_facts(spark, d):
    k = _Run(spark, d).known
    return k.select("repo_id", "files", "analysed", "loc", "comments", "test_loc", "source_loc", "test_files", "longest", "markers", "credentials", "functions", "complex", "nesting", "direct", "vulns", "bad_deps", "crowd", F.round("clones", 6).alias("clones"), "license_file", "contributing", "ci", "ci_tests", "coverage", "linter", "package_json", "npm_lock", "pip_pins", F.md5("readme").alias("readme"))


SECTION = [f"regexp_matches(lower(readme), '{p}')" for _, p in R.SECTIONS[:2]]
UNITS = "(len({0}) + len(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
ONE = [
    ("security.credentialfiles", "CASE WHEN worst THEN 'critical' WHEN credentials > 0 THEN 'major' END"), ("security.nolock", "CASE WHEN has_js AND package_json AND NOT npm_lock THEN 'minor' WHEN has_js AND NOT package_json AND NOT pip_pins THEN 'info' END"),
    ("security.deps", "CASE WHEN vulns >= 8 OR bad_deps >= 5 THEN 'critical' WHEN vulns > 0 THEN 'major' END"), ("quality.complexity", "CASE WHEN complex >= 15 THEN 'critical' WHEN complex >= 5 THEN 'major' WHEN complex > 0 THEN 'minor' END"),
    ("quality.godfiles", "CASE WHEN longest > 800 THEN 'major' END"), ("quality.longfiles", "CASE WHEN longest > 400 AND longest <= 800 THEN 'minor' END"), ("quality.nesting", "CASE WHEN nesting > 5 THEN 'major' END"),
    ("quality.duplication", "CASE WHEN clones > 0.2 THEN 'major' WHEN clones > 0.05 THEN 'minor' END"), ("documentation.readme", "CASE WHEN readme IS NULL THEN 'critical' END"), ("documentation.readmemd", f"CASE WHEN {UNITS.format('readme')} < 400 THEN 'major' END"),
    ("documentation.sections", f"CASE WHEN {UNITS.format('readme')} >= 400 AND NOT ({' AND '.join(SECTION)}) THEN 'minor' END"), ("documentation.license", "CASE WHEN license IS NULL AND NOT license_file THEN 'major' END"),
    ("documentation.contributing", "CASE WHEN NOT contributing AND contributors >= 3 THEN 'info' END"), ("documentation.docstrings", "CASE WHEN functions >= 20 THEN 'major' END"), ("documentation.comments", "CASE WHEN loc > 3000 AND floor(comments * 1000 / loc + 0.5) / 10 < 1.5 THEN 'minor' END"),
    ("testing.notests", "CASE WHEN test_files = 0 THEN 'critical' END"), ("testing.ratio", "CASE WHEN test_files > 0 AND ratio < 0.05 THEN 'major' WHEN test_files > 0 AND ratio < 0.2 THEN 'minor' END"), ("testing.noci", "CASE WHEN NOT ci THEN 'major' END"),
    ("testing.cinotests", "CASE WHEN ci AND NOT ci_tests THEN 'minor' END"), ("testing.coverage", "CASE WHEN ci AND ci_tests AND NOT coverage AND ratio >= 0.05 THEN 'info' END"), ("maintainability.linter", "CASE WHEN regexp_matches(languages, 'JavaScript|TypeScript|Python') AND NOT linter THEN 'minor' END"),
    ("maintainability.todos", "CASE WHEN markers >= 5 AND markers * 1000 / loc > 1.5 THEN 'minor' END"), ("maintainability.busfactor", "CASE WHEN contributors > 0 AND bus_factor = 1 THEN 'major' END"), ("maintainability.archived", "CASE WHEN archived THEN 'info' END"),
    ("maintainability.stale", "CASE WHEN NOT archived AND date_diff('day', pushed_at, TIMESTAMP '2025-01-01') > 720 THEN 'info' END"), ("maintainability.deps", "CASE WHEN direct > 80 THEN 'minor' END"), ("maintainability.fanout", "CASE WHEN crowd >= 50 THEN 'minor' END"), ("graph.cycles", "CASE WHEN looped > 0 THEN 'major' END"),
]
COST = "CASE severity WHEN 'critical' THEN CASE WHEN id IN ('quality.complexity', 'security.deps') THEN 25 ELSE 30 END WHEN 'major' THEN 10 WHEN 'minor' THEN 4 ELSE 1 END"
FOUND = f"""{HEAD}, {SECRET}, {SEEN}, {RISK}, found AS (SELECT repo_id, id, CASE WHEN id = 'graph.cycles' THEN 'maintainability' ELSE split_part(id, '.', 1) END AS category, severity, CAST({COST} AS INTEGER) AS penalty FROM (
 {' UNION ALL '.join(f"SELECT repo_id, '{id_}' AS id, {s} AS severity FROM known" for id_, s in ONE)} UNION ALL SELECT repo_id, id, severity FROM seen UNION ALL SELECT repo_id, pattern, any_value(severity) FROM risk GROUP BY 1, 2) WHERE severity IS NOT NULL)"""


@query(f"{FOUND} SELECT * FROM found")
def audit_findings(spark, d):
    return _Run(spark, d).found.select("repo_id", "id", "category", "severity", "penalty")


SCORED = """other AS (SELECT repo_id, category, sum(penalty) AS p, count(*) FILTER (WHERE severity = 'critical') AS k, bool_or(id = 'documentation.readme') AS bare, sum(CASE WHEN id IN ('testing.notests', 'testing.ratio') THEN 0 ELSE penalty END) AS rest FROM found GROUP BY 1, 2),
curve AS (SELECT repo_id, CASE WHEN source_loc = 0 THEN 0 ELSE greatest(0, 100 - least(100, floor(ratio / 0.6 * 100 + 0.5))) END AS lost FROM known),
score AS (SELECT repo_id, category, CAST(p AS BIGINT) AS penalty, CAST(least(100 - least(100, p), CASE WHEN k >= 2 THEN 35 WHEN k = 1 THEN 55 ELSE 100 END, CASE WHEN bare THEN 12 ELSE 100 END) AS BIGINT) AS score FROM other WHERE category <> 'testing'
 UNION ALL SELECT repo_id, 'testing', CAST(100 - s AS BIGINT), CAST(s AS BIGINT) FROM (SELECT c.repo_id, greatest(5, least(100, 100 - lost - coalesce(o.rest, 0))) AS s FROM curve c LEFT JOIN other o ON o.repo_id = c.repo_id AND o.category = 'testing'))"""


@query(f"{FOUND}, {SCORED} SELECT * FROM score")
def audit_scores(spark, d):
    r = _Run(spark, d)
    known, found = r.known, r.found
    return audit.scores(known, found)


GRADED = "graded AS (SELECT *, CASE WHEN overall >= 93 THEN 'A+' WHEN overall >= 85 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 65 THEN 'C' WHEN overall >= 50 THEN 'D' ELSE 'F' END AS grade FROM (SELECT repo_id, CAST(floor(round(" + " + ".join(f"coalesce(max(CASE WHEN category = '{c}' THEN score END), 100) * {w}::DOUBLE" for c, w in R.WEIGHTS.items()) + ", 6) + 0.5) AS BIGINT) AS overall FROM score GROUP BY 1))"


@query(f"{FOUND}, {SCORED}, {GRADED} SELECT g.repo_id, k.files, k.loc, (SELECT count(*) FROM found f WHERE f.repo_id = g.repo_id) AS findings, overall, grade FROM graded g JOIN known k USING (repo_id)")
def audit_grades(spark, d):
    r = _Run(spark, d)
    known, found = r.known, r.found
    return audit.report(known, found)


#: The whole grade of a repository in SQL, over the views and functions of treegauge/sql.py.
SQL_GRADES = """
WITH points AS (SELECT repo_id, category, sum(penalty) AS lost, count_if(severity = 'critical') AS critical, max(id = 'documentation.readme') AS bare,
    sum(CASE WHEN id IN ('testing.notests', 'testing.ratio') THEN 0 ELSE penalty END) AS rest FROM audit_findings GROUP BY ALL),
curve AS (SELECT repo_id, CASE WHEN source_loc = 0 THEN 0 ELSE greatest(0, 100 - least(100, floor(test_loc / source_loc / 0.6D * 100 + 0.5D))) END AS lost FROM audit_facts),
score AS (
    SELECT repo_id, category, least(100 - least(100, lost), CASE WHEN critical >= 2 THEN 35 WHEN critical = 1 THEN 55 ELSE 100 END, CASE WHEN bare THEN 12 ELSE 100 END) AS score FROM points WHERE category <> 'testing'
    UNION ALL SELECT c.repo_id, 'testing', greatest(5, least(100, 100 - c.lost - coalesce(p.rest, 0))) FROM curve c LEFT JOIN points p ON p.repo_id = c.repo_id AND p.category = 'testing'),
overall AS (SELECT repo_id, CAST(floor(round(sum(weight * coalesce(score, 100)), 6) + 0.5D) AS BIGINT) AS overall
    FROM (SELECT f.repo_id, w.category, w.weight FROM audit_facts f CROSS JOIN VALUES ('security', 0.25D), ('quality', 0.25D), ('testing', 0.20D), ('documentation', 0.15D), ('maintainability', 0.15D) w(category, weight)) LEFT JOIN score USING (repo_id, category) GROUP BY repo_id)
SELECT f.repo_id, f.files, f.loc, coalesce(n.findings, 0) AS findings, o.overall, tg_grade(o.overall) AS grade
FROM audit_facts f JOIN overall o USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) AS findings FROM audit_findings GROUP BY 1) n USING (repo_id)"""


@query(ORACLES["audit_grades"])
def sql_audit_grades(spark, d):
    """audit_grades by SQL alone, over published views."""
    r = _Run(spark, d)
    audit_sql.register(spark)
    run = results.Analysis(r.p, r.known, r.found, r.scores, r.graded, audit.plan(r.found), r.notes, r.meta, r.meta)
    audit_sql.publish(spark, run)
    return spark.sql(SQL_GRADES)


@query(ORACLES["tree_pinned"])
def sql_tree_pinned(spark, d):
    """Pinned versions by the table function of manifests, nested locks beside it."""
    r = _Run(spark, d)
    audit_sql.register(spark)
    r.p.manifests.createOrReplaceTempView("audit_manifests")
    older = r.p.manifests.where("path = 'package-lock.json' AND get_json_object(content, '$.packages') IS NULL")
    D.nested_versions(older).createOrReplaceTempView("audit_nested")
    return spark.sql("""SELECT DISTINCT repo_id, ecosystem, name, version FROM (
    SELECT m.repo_id, CASE WHEN path IN ('package-lock.json', 'pnpm-lock.yaml') THEN 'npm' WHEN path = 'Cargo.lock' THEN 'cargo' WHEN path = 'composer.lock' THEN 'composer' ELSE 'pip' END AS ecosystem, p.name, p.version
    FROM audit_manifests m, LATERAL tg_pinned(m.path, m.content) p UNION ALL SELECT repo_id, 'npm', name, version FROM audit_nested)
WHERE name <> '' AND version RLIKE '^[0-9]' AND NOT contains(version, '*')""")


_NODES, _EDGES = ORACLES["tree_module_nodes"], ORACLES["tree_module_edges"]


@query(f"SELECT repo_id, id, CASE WHEN in_cycle THEN 'rgba(251,113,133,0.25)' ELSE 'rgba(52,211,153,0.18)' END AS fill, CASE WHEN in_cycle THEN '#fb7185' ELSE '#34d399' END AS stroke, CASE WHEN in_cycle THEN '#fb7185' ELSE '#94a3b8' END AS label FROM ({_NODES}) n UNION ALL SELECT repo_id, src || '>' || dst, NULL, CASE WHEN in_cycle THEN '#fb7185' ELSE '#2a3a5c' END, NULL FROM ({_EDGES}) e")
def tree_colours(spark, d):
    """Colours of the modules and of the edges between them."""
    n, e = A.coloured(*_graph(spark, d, A.module_graph))
    none = F.lit(None).cast("string")
    return n.select("repo_id", "id", "fill", "stroke", "label").union(e.select("repo_id", F.concat("src", F.lit(">"), "dst"), none, "stroke", none))


PLAN = "(VALUES " + ", ".join(f"({i}, '{id_}', '{impact}', '{effort}')" for i, (id_, impact, effort, _) in enumerate(R.PLAN)) + ") v(k, id, impact, effort)"
PLACED = f"planned AS (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY list_position(['high', 'medium', 'low'], impact), list_position(['low', 'medium', 'high'], effort), k) AS place, id, impact, effort FROM found JOIN {PLAN} USING (id))"


@query(f"{FOUND}, {PLACED} SELECT * FROM planned WHERE place <= 12")
def audit_plan(spark, d):
    return audit.plan(_Run(spark, d).found).select("repo_id", F.col("place").cast("long").alias("place"), "id", "impact", "effort")


ADDED = """SELECT repo_id, category, row_number() OVER (PARTITION BY repo_id, category ORDER BY CASE WHEN category = 'testing' THEN 0 ELSE -penalty END, k) AS place, penalty FROM (SELECT repo_id, 'testing' AS category, CAST(lost AS INTEGER) AS penalty, 0 AS k FROM curve UNION ALL SELECT repo_id, category, penalty, 1 FROM found WHERE id NOT IN ('testing.notests', 'testing.ratio'))"""


@query(f"{FOUND}, {SCORED} {ADDED}")
def audit_contributions(spark, d):
    r = _Run(spark, d)
    known, found = r.known, r.found
    return audit.contributions(known, found).select("repo_id", "category", F.col("place").cast("long").alias("place"), "penalty")


def _top(id_: str, n: int, by: str, path: str, line: str, note: str, src: str) -> str:
    return f"SELECT repo_id, '{id_}' AS id, place, {path} AS path, {line} AS line, {note} AS note FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {by}) AS place FROM {src}) WHERE place <= {n}"


SPOT = " UNION ALL ".join([
    "SELECT repo_id, pattern AS id, place, path, line, left(value, 6) || '…' AS note FROM secret WHERE place <= 12", "SELECT repo_id, pattern, place, path, line, NULL FROM risk WHERE place <= 12",
    _top("quality.godfiles", 5, BY_FILE, "path", "NULL", "CAST(lines AS VARCHAR)", "(SELECT * FROM script WHERE lines > 800)"), _top("quality.longfiles", 5, BY_FILE, "path", "NULL", "CAST(lines AS VARCHAR)", "(SELECT * FROM script WHERE lines > 400 AND lines <= 800)"),
    _top("quality.complexity", 5, "complexity DESC, " + BY_FILE, "path", "CASE analysis WHEN 'js' THEN 3 END", "'gate ' || complexity", "(SELECT * FROM fun WHERE complexity > 15)"),
    _top("security.credentialfiles", 6, BY_FILE, "path", "NULL", CRED, f"(SELECT * FROM loaded WHERE {CRED} IS NOT NULL)"), _top("security.deps", 8, "n DESC, ecosystem, name, version", "ecosystem || ' ' || name || '@' || version", "NULL", "array_to_string(string_split(vulns, ',')[:3], ', ')", "bad"),
    _top("maintainability.todos", 4, "n DESC, " + BY_FILE, "path", "NULL", "CAST(n AS VARCHAR)", f"(SELECT repo_id, path, {MARKS} AS n FROM loaded WHERE {MARKS} > 0)"),
    _top("maintainability.fanout", 4, "n DESC, " + BY_FILE, "path", "NULL", "CAST(n AS VARCHAR)", "(SELECT * FROM (SELECT repo_id, regexp_extract(path, '^(.*)/', 1) AS path, count(*) AS n FROM loaded WHERE contains(path, '/') GROUP BY 1, 2) WHERE n >= 50)"),
    f"SELECT w.repo_id, 'quality.duplication', (g.place - 1) * 4 + w.k, w.path, w.line - 6, w.key FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, key ORDER BY {BY_FILE}, line) AS k FROM win) w JOIN (SELECT repo_id, key, row_number() OVER (PARTITION BY repo_id ORDER BY least(n, 4) DESC, first.o, first.l - 6, key) AS place FROM clone) g USING (repo_id, key) WHERE w.k <= 4 AND g.place <= 3",
    "SELECT repo_id, 'quality.nesting', 1, path, deep_line, 'deep 8' FROM fun WHERE nesting > 5",
    "SELECT repo_id, 'graph.cycles', 1, NULL, NULL, string_agg(id, ' > ' ORDER BY id) FROM loop GROUP BY 1",
])


@query(f"{FOUND} SELECT repo_id, id, CAST(place AS INTEGER) AS place, path, CAST(line AS INTEGER) AS line, note FROM ({SPOT})")
def audit_places(spark, d):
    return audit.places(_Run(spark, d).p)


@query(None)
def audit_details(spark, d):
    """Findings as a user reads them: title, detail with places, metric, first file and line."""
    r = _Run(spark, d)
    return audit.detailed(r.found, audit.places(r.p))


@query(f"{FOUND} SELECT k.repo_id, w.n > k.files AS partial, CAST((w.n > k.files)::INT + (SELECT count(DISTINCT f.repo_id) FROM found f WHERE f.repo_id = k.repo_id AND f.id IN ('security.credentialfiles', {sql_list([s[0] for s in R.SECRETS])})) AS INTEGER) AS told FROM known k JOIN (SELECT repo_id, count(*) FILTER (WHERE NOT in_dir) AS n FROM judged GROUP BY 1) w USING (repo_id)")
def audit_notes(spark, d):
    return _Run(spark, d).notes.select("repo_id", "partial", F.size("notes").alias("told"))


BADGE_COLOUR = "CASE grade " + " ".join(f"WHEN '{g}' THEN '{c}'" for g, c in R.BANDS["badge"][0]) + f" ELSE '{R.BANDS['badge'][1]}' END"
WIDTH = "CAST(floor(len(replace(replace({0}, ' ', ''), '·', '')) * 7 + (len({0}) - len(replace(replace({0}, ' ', ''), '·', ''))) * 3.5 + 0.5) AS INTEGER)"
VALUE = "(grade || ' · ' || overall || '%')"


@query(f"{FOUND}, {SCORED}, {GRADED} SELECT repo_id, {VALUE} AS value, {WIDTH.format(VALUE)} + 16 + 42 + 16 AS width, {BADGE_COLOUR} AS colour, md5('<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"' || ({WIDTH.format(VALUE)} + 74) || '\" height=\"20\"><rect width=\"58\" height=\"20\" fill=\"#555\"/><rect x=\"58\" width=\"' || ({WIDTH.format(VALUE)} + 16) || '\" height=\"20\" fill=\"' || {BADGE_COLOUR} || '\"/><text x=\"29.0\" y=\"14\" fill=\"#fff\" text-anchor=\"middle\" font-size=\"11\">health</text><text x=\"' || (58 + ({WIDTH.format(VALUE)} + 16) / 2)::DOUBLE || '\" y=\"14\" fill=\"#fff\" text-anchor=\"middle\" font-size=\"11\">' || {VALUE} || '</text></svg>') AS svg FROM graded")
def badge_svg(spark, d):
    return outputs.badge(_Run(spark, d).graded).withColumn("svg", F.md5("svg"))


DUEL = f"""duel AS (SELECT 'r0' AS a, b, c AS category, coalesce((SELECT score FROM score s WHERE s.repo_id = 'r0' AND s.category = c), 100) AS score_a, coalesce((SELECT score FROM score s WHERE s.repo_id = b AND s.category = c), 100) AS score_b FROM (SELECT repo_id AS b FROM graded WHERE repo_id <> 'r0'), (SELECT unnest([{sql_list(outputs.ORDER)}]) AS c))"""
TOLD = "CASE WHEN score_a = score_b THEN 'tie' WHEN score_a > score_b THEN 'A +' || (score_a - score_b) ELSE 'B +' || (score_b - score_a) END"


def _pairs(graded: DataFrame) -> DataFrame:
    return graded.where("repo_id <> 'r0'").select(F.lit("r0").alias("a"), F.col("repo_id").alias("b"))


@query(f"{FOUND}, {SCORED}, {GRADED}, {DUEL} SELECT a, b, category, score_a, score_b, score_a - score_b AS diff, {TOLD} AS told FROM duel")
def duel_table(spark, d):
    """The first repository against every other."""
    r = _Run(spark, d)
    scores, graded = r.scores, r.graded
    return outputs.duel(scores, graded, _pairs(graded))


@query(f"{FOUND}, {SCORED}, {GRADED}, {DUEL}, won AS (SELECT a, b, count(*) FILTER (WHERE score_a > score_b) AS wins_a, count(*) FILTER (WHERE score_a < score_b) AS wins_b FROM duel GROUP BY 1, 2) SELECT w.a, w.b, wins_a, wins_b, CASE WHEN wins_a = wins_b THEN 'even, ' || wins_a || ' categories each, ' || x.overall || '% against ' || y.overall || '% overall' ELSE CASE WHEN wins_a > wins_b THEN w.a ELSE w.b END || ' wins ' || greatest(wins_a, wins_b) || ' of 5 categories, ' || CASE WHEN x.overall = y.overall THEN 'equal overall' ELSE greatest(x.overall, y.overall) || '% against ' || least(x.overall, y.overall) || '% overall' END END AS verdict FROM won w JOIN graded x ON x.repo_id = w.a JOIN graded y ON y.repo_id = w.b")
def duel_verdicts(spark, d):
    r = _Run(spark, d)
    scores, graded = r.scores, r.graded
    return outputs.verdict(outputs.duel(scores, graded, _pairs(graded)), graded).select("a", "b", "wins_a", "wins_b", "verdict")


@query(None)
def duel_cards(spark, d):
    r = _Run(spark, d)
    scores, graded = r.scores, r.graded
    rows = outputs.duel(scores, graded, _pairs(graded))
    return outputs.card(rows, outputs.verdict(rows, graded))


BAR = "rpad(l, 16, ' ') || ' ' || repeat('█', CAST(floor(s / 5 + 0.5) AS INTEGER)) || repeat('░', 20 - CAST(floor(s / 5 + 0.5) AS INTEGER)) || ' ' || lpad(CAST(s AS VARCHAR), 3, ' ') || '%'"
LABEL = "(VALUES " + ", ".join(f"({i}, '{c}', '{R.LABELS[c]}')" for i, c in enumerate(outputs.ORDER)) + ") v(k, c, l)"


@query(f"{FOUND}, {SCORED}, {GRADED} SELECT repo_id, 'overall: ' || any_value(overall) || '/100 (grade ' || any_value(grade) || ')' || chr(10) || string_agg({BAR}, chr(10) ORDER BY k) || chr(10) || 'findings (' || (SELECT count(*) FROM found f WHERE f.repo_id = x.repo_id) || '):' AS head FROM (SELECT g.*, k, l, coalesce((SELECT score FROM score s WHERE s.repo_id = g.repo_id AND s.category = c), 100) AS s FROM graded g, {LABEL}) x GROUP BY repo_id")
def report_head(spark, d):
    """The text report up to the list of findings."""
    return report_texts(spark, d).select("repo_id", F.regexp_extract("report", r"(?s)\A(.*?findings \(\d+\):)", 1).alias("head"))


@query(None)
def report_texts(spark, d):
    r = _Run(spark, d)
    return outputs.text_report(r.graded, r.scores, r.found, audit.plan(r.found))


@query(f"{FOUND}, {SCORED}, {GRADED} SELECT g.repo_id, 'repository: ' || g.repo_id || chr(10) || 'overall: ' || overall || ' (grade ' || grade || ')' || chr(10) || (SELECT string_agg('- ' || category || ': ' || score, chr(10) ORDER BY list_position([{sql_list(outputs.ORDER)}], category)) FROM score s WHERE s.repo_id = g.repo_id) || chr(10) || 'size: ' || k.analysed || ' files, ' || k.loc || ' lines' || chr(10) || 'findings:' AS head FROM graded g JOIN known k USING (repo_id)")
def prescription_head(spark, d):
    """The digest up to the list of findings."""
    r = _Run(spark, d)
    whole = outputs.digest(r.graded, r.scores, r.known.select("repo_id", "analysed", "loc"), r.found, audit.plan(r.found))
    return whole.select("repo_id", F.regexp_extract("digest", r"(?s)\A(.*?findings:)", 1).alias("head"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    r = _Run(spark, d)
    r.found = audit.findings(r.known, r.p.code, p=r.p)
    refs = r.known.select("repo_id", F.concat(F.lit("https://code.example/"), "repo_id").alias("url"), F.lit("local").alias("owner"), F.col("repo_id").alias("name"), F.lit("main").alias("ref"))
    run = results.Analysis(r.p, r.known, r.found, r.scores, r.graded, audit.plan(r.found), r.notes, r.meta, refs)
    return run.documents("2025-01-01T00:00:00Z")


@query(f"{FOUND}, {SCORED}, {GRADED}, {PLACED} SELECT g.repo_id AS id, overall, grade, (SELECT count(*) FROM found f WHERE f.repo_id = g.repo_id) AS findings, least((SELECT count(*) FROM planned p WHERE p.repo_id = g.repo_id), 12) AS plan, k.loc, '2025-01-01T00:00:00Z' AS analyzed_at FROM graded g JOIN known k USING (repo_id)")
def result_documents(spark, d):
    """Result documents, read again from their JSON."""
    r = _documents(spark, d).select("id", F.from_json("document", LA.RESULT).alias("r"))
    return r.select("id", F.col("r.scores.overall").cast("long").alias("overall"), "r.scores.grade", F.size("r.findings").cast("long").alias("findings"), F.size("r.plan").cast("long").alias("plan"), F.col("r.stats.totalLoc").alias("loc"), F.col("r.analyzedAt").alias("analyzed_at"))


def _pieces(*pieces: str) -> str:
    return " || '|' || ".join(f"coalesce(CAST({x} AS VARCHAR), '')" for x in pieces)


FIELDS = " UNION ALL ".join(
    f"SELECT repo_id AS id, '{part}' AS part, {key} AS key, {value} AS value FROM ({sql}) {name}"
    for name, part, key, value, sql in (
        ("a", "module", "id", _pieces("id", "'module'", "loc", "complexity", "fan_in", "fan_out", "in_cycle"), ORACLES["tree_module_nodes"]),
        ("b", "module edge", "src || '>' || dst", _pieces("weight"), ORACLES["tree_module_edges"]),
        ("c", "module cycle", "id", "''", f"SELECT * FROM ({ORACLES['tree_module_nodes']}) x WHERE in_cycle"),
        ("d", "file", "id", _pieces("string_split(id, '/')[-1]", "'file'", "loc", "complexity", "fan_in", "fan_out", "in_cycle"), ORACLES["tree_file_nodes"]),
        ("e", "file edge", "src || '>' || dst", _pieces("weight"), ORACLES["tree_file_edges"]),
        ("f", "fan in", "CAST(place AS VARCHAR)", _pieces("id", "fan_in"), ORACLES["tree_top_fan_in"]),
        ("g", "package", "CAST(place AS VARCHAR)", _pieces("package", "n"), ORACLES["tree_packages"]),
        ("h", "score", "category", _pieces("score", "100 - score"), f"SELECT k.repo_id, c AS category, coalesce(s.score, 100) AS score FROM (SELECT DISTINCT repo_id FROM ({ORACLES['audit_scores']}) y) k, (SELECT unnest([{sql_list(outputs.ORDER)}]) AS c) LEFT JOIN ({ORACLES['audit_scores']}) s ON s.repo_id = k.repo_id AND s.category = c"),
        ("i", "made of", "category || ' ' || place", _pieces("penalty"), ORACLES["audit_contributions"]),
        ("j", "finding", "id", _pieces("category", "severity", "penalty", "path", "line"), f"SELECT f.*, p.path, p.line FROM ({ORACLES['audit_findings']}) f LEFT JOIN (SELECT * FROM ({ORACLES['audit_places']}) z WHERE place = 1) p USING (repo_id, id)"),
        ("k", "plan", "CAST(place AS VARCHAR)", _pieces("id", "impact", "effort"), ORACLES["audit_plan"]),
        ("l", "language", "lang", _pieces("files", "loc"), f"{WALK} SELECT repo_id, coalesce(lang, 'Env/Key') AS lang, count(*) AS files, CAST(sum(lines) AS BIGINT) AS loc FROM loaded GROUP BY 1, 2"),
        ("m", "advisory", "name || '@' || version", _pieces("ecosystem", "vulns"), ORACLES["tree_vulnerable"]),
        ("n", "meta", "name", _pieces("owner", "stars", "license", "replace(pushed_at, ' ', 'T') || 'Z'", "contributors", "bus_factor", "archived"), ORACLES["repo_meta"]),
        ("o", "stats", "'all'", _pieces("analysed", "files_total", "loc", "files_total > walked"), f"SELECT n.repo_id, n.analysed, n.loc, n.walked, w.files_total FROM ({WALK} SELECT k.repo_id, k.walked, count(l.path) AS analysed, CAST(coalesce(sum(l.lines), 0) AS BIGINT) AS loc FROM (SELECT repo_id, count(*) AS walked FROM walked GROUP BY 1) k LEFT JOIN loaded l ON l.repo_id = k.repo_id GROUP BY 1, 2) n JOIN ({ORACLES['tree_walk_stats']}) w ON w.repo_id = n.repo_id"),
    )
)


@query(FIELDS)
def result_fields(spark, d):
    """Every member of the result documents, read again from their JSON, a row a field."""
    r = _documents(spark, d).select("id", F.from_json("document", LA.RESULT).alias("r"))
    told = lambda part, key, *xs: F.struct(F.lit(part).alias("part"), key.cast("string").alias("key"), F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in xs]).alias("value"))
    each = lambda xs, f: F.coalesce(F.transform(xs, f), F.array().cast("array<struct<part:string,key:string,value:string>>"))
    node = lambda part: lambda n: told(part, n["id"], n["label"], n["kind"], n["loc"], n["complexity"], n["fanIn"], n["fanOut"], n["inCycle"])
    edge = lambda part: lambda e: told(part, F.concat(e["source"], F.lit(">"), e["target"]), e["weight"])
    m = F.col("r.meta")
    rows = [
        each(F.col("r.architecture.nodes"), node("module")),
        each(F.col("r.architecture.edges"), edge("module edge")),
        each(F.flatten("r.architecture.cycles"), lambda x: told("module cycle", x)),
        each(F.col("r.fileGraph.nodes"), node("file")),
        each(F.col("r.fileGraph.edges"), edge("file edge")),
        each(F.col("r.architecture.topFanIn"), lambda x, i: told("fan in", i + 1, x["id"], x["fanIn"])),
        each(F.col("r.architecture.externalDeps"), lambda x, i: told("package", i + 1, x["name"], x["count"])),
        each(F.col("r.scores.categories"), lambda x: told("score", x["key"], x["score"], x["penalty"])),
        F.flatten(F.transform("r.scores.categories", lambda c: F.transform(c["contributions"], lambda x, i: told("made of", F.concat_ws(" ", c["key"], (i + 1).cast("string")), x["penalty"])))),
        each(F.col("r.findings"), lambda x: told("finding", x["id"], x["category"], x["severity"], x["penalty"], x["file"], x["line"])),
        each(F.col("r.plan"), lambda x: told("plan", x["rank"], x["relatedFindings"][0], x["impact"], x["effort"])),
        each(F.map_entries("r.stats.byLanguage"), lambda x: told("language", x["key"], x["value"]["files"], x["value"]["loc"])),
        each(F.col("r.vulnerableDeps"), lambda x: told("advisory", F.concat(x["name"], F.lit("@"), x["version"]), x["ecosystem"], F.array_join(x["vulns"]["id"], ","))),
        F.when(m.isNotNull(), F.array(told("meta", m["name"], m["owner"], m["stars"], m["license"], m["pushedAt"], m["contributors"], m["busFactor"], m["archived"]))).otherwise(F.array().cast("array<struct<part:string,key:string,value:string>>")),
        F.array(told("stats", F.lit("all"), F.col("r.stats.filesAnalyzed"), F.col("r.stats.filesTotal"), F.col("r.stats.totalLoc"), F.col("r.scores.confidence.partial"))),
    ]
    return r.select("id", F.explode(F.concat(*rows)).alias("x")).select("id", "x.*")


@query(f"{FOUND}, {SCORED}, {GRADED} SELECT repo_id AS id, 'local' AS owner, repo_id AS repo, CAST(overall AS INTEGER) AS overall, grade, '2025-01-01T00:00:00Z' AS analyzed_at FROM graded")
def result_list(spark, d):
    """Stored documents as a list: written to the shared folder, and only the listed fields read."""
    path = f"{folder(spark)}/treegauge/results-{uuid.uuid4().hex}"
    LA.save_results(_documents(spark, d), path)
    return outputs.listed(LA.stored_results(spark, path))


@query("SELECT user_id, CAST(s AS INTEGER) AS score, CASE WHEN s >= 85 THEN '#34d399' WHEN s >= 70 THEN '#a3e635' WHEN s >= 55 THEN '#fbbf24' WHEN s >= 40 THEN '#fb923c' ELSE '#fb7185' END AS donut, CASE WHEN s >= 75 THEN 'emerald' WHEN s >= 50 THEN 'amber' ELSE 'rose' END AS bar, CASE WHEN s >= 85 THEN 'healthy' WHEN s >= 70 THEN 'manageable' WHEN s >= 50 THEN 'needs attention' ELSE 'critical' END AS diagnosis, CASE WHEN t >= 1000 THEN printf('%.1f', t / 1000.0) || 'k' ELSE CAST(t AS VARCHAR) END AS short FROM (SELECT user_id, count(*) % 101 AS s, CAST(sum(event_id) AS BIGINT) AS t FROM events GROUP BY 1)")
def score_bands(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    kind, ids = e.schema["event_id"].dataType, F.col("event_id")
    # as in the SQL: whole ids may add up beyond a BIGINT on the way; a double's half goes to the even number, a decimal's away from zero
    total = F.rint(F.sum(ids)) if isinstance(kind, (FloatType, DoubleType)) else F.round(F.sum(ids if isinstance(kind, DecimalType) else ids.cast("decimal(20,0)")))
    e = e.groupBy("user_id").agg((F.count(F.lit(1)) % 101).cast("int").alias("score"), total.cast("long").alias("t"))
    return e.select("user_id", "score", T.band(F.col("score"), "donut").alias("donut"), T.band(F.col("score"), "bar").alias("bar"), T.diagnosis(F.col("score")).alias("diagnosis"), T.thousands(F.col("t")).alias("short"))
