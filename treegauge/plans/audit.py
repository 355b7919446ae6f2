"""The whole audit of source trees: all finding rules with their places, scores and the action plan.

    tree        repo_id, path, size, raw (null where a file was not read)
    meta        repo_id, license, contributors, bus_factor, archived, pushed_at, languages
    advisories  ecosystem, name, version, vuln_id

Every rule is an expression over one row of facts a repository, so that rules cost no joins of their
own: facts come from a few aggregates, and findings are one explode. Files and lexed code are written
once to the shared folder, since every aggregate reads them.

By default the rules' compatible behaviour holds: doc comments are never seen, since they are looked
for in blanked text; key files are read only if their whole name is an ending; two kinds of checks
are never found; the first README by path counts; headings count only at a README's first line; Yarn
and Go locks give nothing. With fixed=True these go as intended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treegauge.functions import rules as R
from treegauge.functions import text as T
from treegauge.operators import deps as D
from treegauge.operators import files as O
from treegauge.operators import graph as G
from treegauge.operators import ignore as IG
from treegauge.operators import imports as I
from treegauge.operators import lexing as L
from treegauge.operators import secrets as S
from treegauge.scratch import written

from . import architecture as A
from . import scoring

Progress = Callable[[str, int, str], None]


def _is(pattern: str, of: Column) -> Column:
    return of.rlike(T.java(pattern).replace("$", r"\z"))


def walked(tree: DataFrame, fixed: bool = False) -> DataFrame:
    """Classified files that are neither ignored nor binary, however many a repository has, with base and is_aux."""
    base = T.base_name(F.col("path"))
    rules = IG.ignore_rules(tree.select("repo_id", "path", "raw"), fixed)
    kept = IG.unignored(O.classify(tree), rules).where(~F.col("is_binary"))
    more = (".circleci/config.yml", ".travis.yml") if fixed else ()
    aux = base.isin(*R.AUX) | _is(R.README, base) | _is(R.WORKFLOW, F.col("path")) | F.col("path").rlike(R.AUX_FOLDER) | F.col("path").isin(*more)
    return kept.withColumn("base", base).withColumn("is_aux", aux)


def loaded(files: DataFrame, fixed: bool = False) -> DataFrame:
    """The files analysed as code, whatever their texts add up to, with lines."""
    read = R.CREDENTIAL_READ.replace(r"|\.(pem", r"|.*\.(pem").replace(r"|tfstate)$", "|tfstate)") if fixed else R.CREDENTIAL_READ
    named = _is(read, F.col("base"))
    code = F.col("lang").isNotNull() & (F.col("analysis") != "none")
    own = files.where(~F.col("is_aux") & F.col("raw").isNotNull() & (named | code))
    return own.withColumn("analysis", F.when(F.col("lang").isNull(), "generic").otherwise(F.col("analysis"))).withColumn("lines", T.line_count(F.col("raw")))


def credential_kind(base: Column) -> Column:
    """The severity of a credential file by its name, or null."""
    out = None
    for pattern, but, severity in R.CREDENTIALS:
        hit = _is(pattern, base) & (~_is(but, base) if but else F.lit(True))
        out = F.when(hit, severity) if out is None else out.when(hit, severity)
    return out


def told(df: DataFrame, progress: Progress | None, stage: str, percent: int, message: str, *more: Column) -> DataFrame:
    """df written once; then progress hears its rows, and what more aggregates give, as they were counted while it was written."""
    if progress is None:
        return written(df)
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(f"more{i}") for i, c in enumerate(more)]))
    progress(stage, percent, message % tuple(seen.get.values()))
    return out


class Parts:
    """The tables that facts, findings and places are made of, each made when it is first asked for."""

    def __init__(self, tree: DataFrame, advisories: DataFrame, fixed: bool = False, progress: Progress | None = None) -> None:
        self.tree, self.advisories, self.fixed, self.progress = tree, advisories, fixed, progress

    @cached_property
    def files(self) -> DataFrame:
        return told(walked(self.tree, self.fixed), self.progress, "parse", 30, "%d files are listed")

    @cached_property
    def texts(self) -> DataFrame:
        """The files analysed as code before they are lexed, for what reads only their texts."""
        return O.spread(loaded(self.files, self.fixed))

    @cached_property
    def code(self) -> DataFrame:
        own = self.texts.withColumn("code", L.strip(F.col("raw"), F.col("analysis")))
        return told(own, self.progress, "parse", 45, "%d files are parsed, %d lines", F.coalesce(F.sum("lines"), F.lit(0)))

    @cached_property
    def functions(self) -> DataFrame:
        return told(L.functions(self.code), self.progress, "quality", 55, "%d functions are measured")

    @cached_property
    def manifests(self) -> DataFrame:
        return self.files.where("is_aux and raw is not null").select("repo_id", "path", F.col("raw").alias("content"))

    @cached_property
    def direct(self) -> DataFrame:
        return D.direct_count(self.manifests)

    @cached_property
    def bad(self) -> DataFrame:
        return told(D.vulnerable(D.pinned(self.manifests, self.fixed), self.advisories), self.progress, "security", 72, "%d dependencies have advisories")

    @cached_property
    def script(self) -> DataFrame:
        return self.code.where(F.col("analysis").isin("js", "python"))

    @cached_property
    def clones(self) -> DataFrame:
        return O.clone_groups(self.script, "code")

    @cached_property
    def refs(self) -> DataFrame:
        return I.imported(self.texts.where(F.col("analysis").isin("js", "python")))

    @cached_property
    def links(self) -> DataFrame:
        return told(I.links(self.refs, self.texts.where(F.col("analysis").isin("js", "python"))), self.progress, "graph", 80, "%d references are followed")

    @cached_property
    def edges(self) -> DataFrame:
        return I.file_edges(self.links)

    # found by many patterns in every line, and needed for findings and for their places: looked for once

    @cached_property
    def secrets(self) -> DataFrame:
        return written(_scanned(self.code))

    @cached_property
    def dangers(self) -> DataFrame:
        return written(O.first_lines(O.pattern_lines(self.code)))

    @cached_property
    def loops(self) -> DataFrame:
        """(repo_id, cycle, id) of the cycles among all modules of a repository."""
        return written(G.strong_components(I.module_edges(self.edges)))


def parts(tree: DataFrame, advisories: DataFrame, fixed: bool = False, progress: Progress | None = None) -> Parts:
    """All parts in the order of a run, so that progress hears of each after its rows are there."""
    p = Parts(tree, advisories, fixed, progress)
    for name in ("files", "code", "functions", "bad", "links"):
        getattr(p, name)
    return p


def _file_facts(files: DataFrame, fixed: bool) -> DataFrame:
    path, base, text = F.col("path"), F.col("base"), F.col("raw")
    flow = _is(R.WORKFLOW, path) & F.col("is_aux") & text.isNotNull()
    held = lambda *names: F.bool_or(path.isin(*names) & F.col("is_aux") & text.isNotNull())
    tells = lambda name, pattern: F.bool_or((path == name) & F.coalesce(text.rlike(pattern), F.lit(False)))
    order = F.struct(F.contains(path, F.lit("/")) if fixed else F.lit(False), T.file_order())
    checks = held(".gitlab-ci.yml", "Jenkinsfile", *((".circleci/config.yml", ".travis.yml") if fixed else ()))
    runs = flow | (path.isin(".gitlab-ci.yml", "Jenkinsfile", ".circleci/config.yml", ".travis.yml") & F.lit(fixed))
    return files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.min_by("raw", F.when(_is(R.README, base), order)).alias("readme"),
        F.bool_or(_is(R.LICENSE_FILE, base)).alias("license_file"),
        F.bool_or(_is(R.CONTRIBUTING, path)).alias("contributing"),
        (F.bool_or(flow) | checks).alias("ci"),
        F.bool_or(runs & _is(R.TEST_COMMAND, text)).alias("ci_tests"),
        (held("codecov.yml", ".coveragerc") | tells("pyproject.toml", r"\[tool\.coverage\]") | tells("setup.cfg", r"\[coverage") | F.bool_or(flow & text.rlike(R.COVERAGE))).alias("coverage"),
        (F.bool_or(F.lower(base).isin(*R.LINTER_FILES)) | tells("pyproject.toml", R.LINTER_TABLE) | tells("Cargo.toml", R.LINTER_TABLE)).alias("linter"),
        held("package.json").alias("package_json"),
        held("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json").alias("npm_lock"),
        (held("poetry.lock", "Pipfile.lock") | F.bool_or(_is(R.REQUIREMENTS, path) & F.col("is_aux") & text.isNotNull())).alias("pip_pins"),
    )


def _code_facts(code: DataFrame) -> DataFrame:
    lines, test, script = F.col("lines"), F.col("is_test"), F.col("analysis").isin("js", "python")
    tested = F.col("analysis") != "none"
    comment = F.size(F.filter(F.split("raw", "\n"), T.is_comment))
    n = lambda when: F.sum(F.when(when, 1).otherwise(0))
    kind = credential_kind(F.col("base"))
    return code.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("analysed"),
        F.sum("lines").alias("loc"),
        F.sum(comment).alias("comments"),
        F.sum(F.when(tested & test, lines).otherwise(0)).alias("test_loc"),
        F.sum(F.when(tested & ~test, lines).otherwise(0)).alias("source_loc"),
        n(tested & test).alias("test_files"),
        F.max(F.when(script, lines)).alias("longest"),
        n(script & (lines > 800)).alias("very_long"),
        n(script & (lines > 400) & (lines <= 800)).alias("rather_long"),
        F.bool_or(F.col("analysis") == "js").alias("has_js"),
        F.sum(F.regexp_count("raw", F.lit(T.java(R.MARKERS)))).alias("markers"),
        n(kind.isNotNull()).alias("credentials"),
        F.max(F.when(kind == "critical", 2).when(kind == "major", 1).otherwise(0)).alias("credential"),
    )


def known(p: Parts, meta: DataFrame, now: datetime, fixed: bool = False) -> DataFrame:
    """One row of facts a repository, written once: rows of every kind of fact are put under each other, and one aggregate takes each column's only value."""
    f = p.functions.groupBy("repo_id").agg(F.count(F.lit(1)).alias("functions"), F.sum(F.when(F.col("complexity") > 15, 1).otherwise(0)).alias("complex"), F.max("complexity").alias("most_complex"), F.avg("complexity").alias("mean_complex"), F.max("nesting").alias("nesting"), F.sum(F.when(F.col("nesting") > 5, 1).otherwise(0)).alias("deep"))
    bad = p.bad.groupBy("repo_id").agg(F.sum(F.size("vulns")).alias("vulns"), F.count(F.lit(1)).alias("bad_deps"))
    folder = F.regexp_extract("path", "^(.*)/", 1)
    each = p.code.where(F.contains("path", F.lit("/"))).groupBy("repo_id", folder.alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    crowded = each.groupBy("repo_id").agg(F.max("n").alias("crowd"), F.sum(F.when(F.col("n") >= 50, 1).otherwise(0)).alias("crowds"))
    twice = O.clone_ratio(p.script, "code").select("repo_id", F.col("ratio").alias("clones"), "blocks")
    loops = p.loops.groupBy("repo_id").agg(F.count_distinct("cycle").alias("cycles"))
    about = meta.select("repo_id", "license", "contributors", "bus_factor", "archived", "pushed_at", "languages")
    more = [_code_facts(p.code), f, p.direct, bad, crowded, twice, loops, A.unresolved(p.links), about]
    if fixed:
        more.append(p.script.groupBy("repo_id").agg(F.sum(F.regexp_count("raw", F.lit(r'\*/\s*\n\s*(?:export\s+)?(?:async\s+)?function\b|def [^\n]*:\s*\n\s*(?:"""|\x27\x27\x27)'))).alias("documented")))
    out = _file_facts(p.files, fixed).withColumn("here", F.lit(True))
    for rows in more:
        out = out.unionByName(rows, allowMissingColumns=True)
    out = out.groupBy("repo_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns if c != "repo_id"]).where("here").drop("here")
    if not fixed:
        out = out.withColumn("documented", F.lit(0).cast("long"))
    months = (F.lit(now.timestamp()) - F.unix_timestamp("pushed_at")) / (86400 * 30)
    out = out.withColumn("idle_months", months).withColumn("ratio", F.coalesce(F.try_divide("test_loc", "source_loc"), F.lit(0.0)))
    zero = ["analysed", "loc", "comments", "test_loc", "source_loc", "test_files", "longest", "very_long", "rather_long", "markers", "credentials", "credential", "functions", "complex", "most_complex", "nesting", "deep", "direct", "vulns", "bad_deps", "crowd", "crowds", "blocks", "cycles", "unresolved", "contributors", "bus_factor", "documented"]
    return written(out.fillna(0, zero).fillna(0.0, ["mean_complex", "clones"]).fillna(False, ["has_js", "archived"]))


def facts(tree: DataFrame, meta: DataFrame, advisories: DataFrame, now: datetime, fixed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(facts with one row a repository, loaded files)."""
    p = parts(tree, advisories, fixed)
    return known(p, meta, now, fixed), p.code


@dataclass
class Rule:
    """A finding that fires where severity is not null, over a row of facts."""

    id: str
    severity: Column
    title: Column
    critical: int = 30
    metric: Column | None = None

    @property
    def category(self) -> str:
        return "maintainability" if self.id.startswith("graph.") else self.id.split(".")[0]

    @property
    def penalty(self) -> Column:
        return F.when(self.severity == "critical", self.critical).otherwise(T.penalty(self.severity)).cast("int")


#: Rules of the user's own: functions that return a Rule, with (impact, effort, title) for the plan.
_MORE: list[tuple[Callable[[], Rule], tuple[str, str, str]]] = []


def register(rule: Callable[[], Rule], impact: str, effort: str, advice: str) -> None:
    """Adds a rule over the facts to all audits that follow, and what to do about its finding."""
    _MORE.append((rule, (impact, effort, advice)))


def _rules(fixed: bool = False) -> list[Rule]:
    c = F.col
    text = c("readme")
    missing = []
    for name, pattern in R.SECTIONS[:2]:
        missing.append(F.when(~F.lower(text).rlike(T.java(("(?m)" if fixed else "") + pattern)), name))
    missing = F.array_compact(F.array(*missing))
    one = lambda when, severity: F.when(when, severity)
    two = lambda x, high, low: F.when(x > high, "major").when(x > low, "minor")
    say = lambda pattern, *xs: F.format_string(pattern, *xs)
    share = F.floor(F.coalesce(F.try_divide(c("comments") * 1000, c("loc")), F.lit(0.0)) + 0.5) / 10
    density = F.coalesce(F.try_divide(c("markers") * 1000, c("loc")), F.lit(0.0))
    percent = lambda x: F.floor(x * 100 + 0.5).cast("long")
    told = F.coalesce(F.try_divide("documented", "functions"), F.lit(0.0))
    return [
        Rule("security.credentialfiles", F.when(c("credential") == 2, "critical").when(c("credential") == 1, "major"), say("credential files in the tree: %d", c("credentials"))),
        Rule("security.nolock", F.when(c("has_js") & c("package_json") & ~c("npm_lock"), "minor").when(c("has_js") & ~c("package_json") & ~c("pip_pins"), "info"), F.when(c("package_json"), "a manifest without a lock file").otherwise("neither manifest nor lock file")),
        Rule("security.deps", F.when((c("vulns") >= 8) | (c("bad_deps") >= 5), "critical").when(c("vulns") > 0, "major"), say("advisories: %d for %d dependencies", c("vulns"), c("bad_deps")), 25, say("%d advisories", c("vulns"))),
        Rule("quality.complexity", F.when(c("complex") >= 15, "critical").when(c("complex") >= 5, "major").when(c("complex") > 0, "minor"), say("functions of complexity over 15: %d", c("complex")), 25, say("most: %d", c("most_complex"))),
        Rule("quality.godfiles", one(c("longest") > 800, "major"), say("files over 800 lines: %d", c("very_long")), metric=say("longest: %d lines", c("longest"))),
        Rule("quality.longfiles", one((c("longest") > 400) & (c("longest") <= 800), "minor"), say("files over 400 lines: %d", c("rather_long"))),
        Rule("quality.nesting", one(c("nesting") > 5, "major"), say("functions nested deeper than 5: %d", c("deep"))),
        Rule("quality.duplication", two(c("clones"), 0.20, 0.05), say("repeated lines of code: about %d%%", percent(c("clones"))), metric=say("blocks: %d", F.least(c("blocks"), F.lit(6)))),
        Rule("documentation.readme", one(text.isNull(), "critical"), F.lit("no README")),
        Rule("documentation.readmemd", one(T.units(text) < 400, "major"), say("a README of %d characters", T.units(text))),
        Rule("documentation.sections", one((T.units(text) >= 400) & (F.size(missing) > 0), "minor"), F.concat(F.lit("README without: "), F.array_join(missing, ", "))),
        Rule("documentation.license", one(c("license").isNull() & ~c("license_file"), "major"), F.lit("no license")),
        Rule("documentation.contributing", one(~c("contributing") & (c("contributors") >= 3), "info"), say("no guide for %d contributors", c("contributors"))),
        Rule("documentation.docstrings", F.when(c("functions") >= 20, F.when(told < 0.05, "major").when(told < 0.20, "minor")), say("documented functions: %d%% of %d", percent(told), c("functions"))),
        Rule("documentation.comments", one((c("loc") > 3000) & (share < 1.5), "minor"), say("comment lines: %.1f%%", share)),
        Rule("testing.notests", one(c("test_files") == 0, "critical"), F.lit("no tests")),
        Rule("testing.ratio", F.when(c("test_files") > 0, F.when(c("ratio") < 0.05, "major").when(c("ratio") < 0.20, "minor")), say("test lines to source lines: %.1f%%", c("ratio") * 100)),
        Rule("testing.noci", one(~c("ci"), "major"), F.lit("no checks on changes")),
        Rule("testing.cinotests", one(c("ci") & ~c("ci_tests"), "minor"), F.lit("checks that run no tests")),
        Rule("testing.coverage", one(c("ci") & c("ci_tests") & ~c("coverage") & (c("ratio") >= 0.05), "info"), F.lit("no coverage report")),
        Rule("maintainability.linter", one(F.arrays_overlap("languages", F.array(*map(F.lit, R.STYLED))) & ~c("linter"), "minor"), F.lit("no linter settings")),
        Rule("maintainability.todos", one((density > 1.5) & (c("markers") >= 5), "minor"), say("open markers: %d, %.1f a thousand lines", c("markers"), density)),
        Rule("maintainability.busfactor", one((c("contributors") > 0) & (c("bus_factor") == 1), "major"), F.lit("one person made half of all contributions")),
        Rule("maintainability.archived", one(c("archived"), "info"), F.lit("an archived repository")),
        Rule("maintainability.stale", one(~c("archived") & (c("idle_months") > 24), "info"), say("at rest for %d years", F.floor(c("idle_months") / 12 + 0.5).cast("long"))),
        Rule("maintainability.deps", one(c("direct") > 80, "minor"), say("direct dependencies: %d", c("direct"))),
        Rule("maintainability.fanout", one(c("crowd") >= 50, "minor"), say("folders of 50 files or more: %d", c("crowds"))),
        Rule("graph.cycles", one(c("cycles") > 0, "major"), say("import cycles between modules: %d", c("cycles"))),
        *[make() for make, _ in _MORE],
    ]


def order_of_findings() -> list[str]:
    """Ids as a report lists them: quality, security, dependencies, documentation, tests, upkeep, graph."""
    plain = [r.id for r in _rules()]
    of = lambda kind: [x for x in plain if x.startswith(kind + ".")]
    security = [s[0] for s in R.SECRETS] + ["security.credentialfiles"] + [d[0] for d in R.DANGEROUS] + ["security.nolock", "security.deps"]
    ids = [*of("quality"), *security, *of("documentation"), *of("testing"), *of("maintainability"), *of("graph")]
    return ids + [x for x in plain if x not in ids]


def findings(facts_: DataFrame, code: DataFrame, fixed: bool = False, p: Parts | None = None) -> DataFrame:
    """(repo_id, seq, id, category, severity, penalty, title, metric) of all rules; seq is their order. With p, its matches are kept for places()."""
    none = F.lit(None).cast("string")
    each = F.array(*[F.struct(F.lit(r.id).alias("id"), F.lit(r.category).alias("category"), r.severity.alias("severity"), r.penalty.alias("penalty"), r.title.alias("title"), (none if r.metric is None else r.metric).alias("metric")) for r in _rules(fixed)])
    ruled = facts_.select("repo_id", F.explode(F.filter(each, lambda x: x["severity"].isNotNull())).alias("x")).select("repo_id", "x.*")
    secret = S.secret_findings(p.secrets if p else _scanned(code)).select("repo_id", F.col("pattern").alias("id"), "severity", "n")
    danger = (p.dangers if p else O.first_lines(O.pattern_lines(code))).groupBy("repo_id", F.col("pattern").alias("id")).agg(F.first("severity").alias("severity"), F.count(F.lit(1)).alias("n"))
    seen = secret.unionByName(danger)
    title = F.concat(F.regexp_replace("id", r"^security\.(pattern\.)?", ""), F.lit(": "), T.plural(F.col("n"), "place", "places"))
    seen = seen.select("repo_id", "id", F.lit("security").alias("category"), "severity", T.penalty(F.col("severity")).cast("int").alias("penalty"), title.alias("title"), none.alias("metric"))
    seq = F.array_position(F.array(*map(F.lit, order_of_findings())), F.col("id")).cast("int")
    return written(ruled.unionByName(seen).withColumn("seq", seq))


def _scanned(code: DataFrame) -> DataFrame:
    return S.secret_matches(code.where("size <= 300000 and not is_lock and analysis <> 'none'"))


def places(p: Parts) -> DataFrame:
    """(repo_id, id, place, path, line, note): where findings are, as many as a finding shows or counts."""
    top = lambda df, n, *by: df.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(*by))).where(F.col("place") <= n)
    row = lambda df, id_, path, line, note: df.select("repo_id", (F.lit(id_) if isinstance(id_, str) else id_).alias("id"), F.col("place").cast("int").alias("place"), path.alias("path"), line.cast("int").alias("line"), note.alias("note"))
    path, line, no = F.col("path"), F.col("line"), F.lit(None)
    script = p.code.where(F.col("analysis").isin("js", "python"))
    by_file = T.file_order()
    long = lambda id_, low, high: row(top(script.where((F.col("lines") > low) & (F.col("lines") <= high)), 5, by_file), id_, path, no, F.col("lines").cast("string"))
    kind = credential_kind(F.col("base"))
    mark = F.regexp_count("raw", F.lit(T.java(R.MARKERS)))
    folder = F.regexp_extract("path", "^(.*)/", 1)
    crowd = p.code.where(F.contains("path", F.lit("/"))).groupBy("repo_id", folder.alias("path")).agg(F.count(F.lit(1)).alias("n")).where("n >= 50")
    bad = D.top_vulnerable(p.bad)
    clone = O.clone_places(script, most=3, text="code")
    loop = p.loops.groupBy("repo_id", "cycle").agg(F.array_join(F.array_sort(F.collect_list("id")), " > ").alias("x"))
    every = [
        row(S.first_matches(p.secrets), F.col("pattern"), path, line, F.concat(F.left("value", F.lit(6)), F.lit("…"))),
        row(p.dangers, F.col("pattern"), path, line, no.cast("string")),
        row(top(p.functions.where("complexity > 15"), 5, F.desc("complexity"), by_file, "line"), "quality.complexity", path, line, F.concat("name", F.lit(" "), F.col("complexity").cast("string"))),
        row(top(p.functions.where("nesting > 5"), 5, by_file, "line"), "quality.nesting", path, line, F.concat("name", F.lit(" "), F.col("nesting").cast("string"))),
        long("quality.godfiles", 800, 1 << 30),
        long("quality.longfiles", 400, 800),
        row(clone.withColumn("place", (F.col("place") - 1) * 4 + F.col("k")), "quality.duplication", path, line, F.col("key")),
        row(top(p.code.where(kind.isNotNull()), 6, by_file), "security.credentialfiles", path, no, kind),
        row(bad, "security.deps", F.concat("ecosystem", F.lit(" "), "name", F.lit("@"), "version"), no, F.array_join(F.slice("vulns", 1, 3), ", ")),
        row(top(p.code.withColumn("n", mark).where("n > 0"), 4, F.desc("n"), by_file), "maintainability.todos", path, no, F.col("n").cast("string")),
        row(top(crowd, 4, F.desc("n"), by_file), "maintainability.fanout", path, no, F.col("n").cast("string")),
        row(top(loop, 3, "cycle"), "graph.cycles", no.cast("string"), no, F.col("x")),
    ]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


def detailed(found: DataFrame, where: DataFrame, shown: int = 5) -> DataFrame:
    """findings with file and line of the first place and detail: a line for each of the first `shown` places, and what to do."""
    at = F.concat(F.lit("- "), F.concat_ws(" ", F.concat_ws(":", "path", F.col("line").cast("string")), F.when(F.col("note") != "", F.concat(F.lit("("), "note", F.lit(")")))))
    g = where.groupBy("repo_id", "id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "path", "line")).alias("first"), F.array_sort(F.collect_list(F.struct("place", at.alias("x")))).alias("all"))
    rest = F.when(F.col("n") > shown, F.format_string("and %d more", F.col("n") - shown))
    advice = F.create_map(*[F.lit(x) for id_, _, _, words in R.PLAN for x in (id_, words)])
    lines = F.concat_ws("\n", F.array_join(F.transform(F.slice("all", 1, shown), lambda x: x["x"]), "\n"), rest, F.try_element_at(advice, F.col("id")))
    return found.join(g, ["repo_id", "id"], "left").select(*[found[c] for c in found.columns], F.col("first.path").alias("file"), F.col("first.line").alias("line"), F.regexp_replace(lines, r"^\n", "").alias("detail"))


def scores(facts_: DataFrame, found: DataFrame) -> DataFrame:
    """(repo_id, category, penalty, score); testing follows the share of test lines less its other penalties."""
    plain = scoring.category_scores(found.where("category <> 'testing'"))
    other = found.where("category = 'testing' and id not in ('testing.notests', 'testing.ratio')").groupBy("repo_id").agg(F.sum("penalty").alias("other"))
    score = F.greatest(F.lit(5), F.least(F.lit(100), 100 - scoring.test_curve() - F.coalesce("other", F.lit(0)))).cast("long")
    tested = facts_.select("repo_id", "test_loc", "source_loc").join(other, "repo_id", "left").select("repo_id", F.lit("testing").alias("category"), (100 - score).alias("penalty"), score.alias("score"))
    return plain.unionByName(tested)


def by_complexity(functions: DataFrame) -> DataFrame:
    """All functions with their place in their repository: the most complex first, then in file order."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("complexity"), T.file_order(), "line")
    return functions.withColumn("place", F.row_number().over(w))


def contributions(facts_: DataFrame, found: DataFrame) -> DataFrame:
    """(repo_id, category, place, title, penalty): what each category's score is made of, the most costly first; testing begins with its share of test lines."""
    percent = F.floor(F.coalesce(F.try_divide("test_loc", "source_loc"), F.lit(0.0)) * 100 + 0.5).cast("long")
    curve = facts_.select("repo_id", F.lit("testing").alias("category"), F.format_string("test lines to source lines: %d%%, aim 60%%", percent).alias("title"), scoring.test_curve().cast("int").alias("penalty"), F.lit(0).alias("seq"))
    rest = found.where("id not in ('testing.notests', 'testing.ratio')").select("repo_id", "category", "title", "penalty", "seq")
    cost = F.when(F.col("category") == "testing", 0).otherwise(-F.col("penalty"))
    w = Window.partitionBy("repo_id", "category").orderBy(cost, "seq")
    return curve.unionByName(rest).select("repo_id", "category", F.row_number().over(w).alias("place"), "title", "penalty")


def plan(found: DataFrame, most: int = 12) -> DataFrame:
    """(repo_id, place, id, impact, effort, title): what to do first; impact, then effort, then the fixed order."""
    more = [(make().id, *words) for make, words in _MORE]
    rows = [(i, *x) for i, x in enumerate([*R.PLAN, *more])]
    dim = F.broadcast(found.sparkSession.createDataFrame(rows, "k int, id string, impact string, effort string, title string"))
    rank = lambda name, order: F.array_position(F.array(*map(F.lit, order)), F.col(name))
    w = Window.partitionBy("repo_id").orderBy(rank("impact", ("high", "medium", "low")), rank("effort", ("low", "medium", "high")), "k")
    due = found.select("repo_id", "id").distinct().join(dim, "id")
    return due.select("repo_id", F.row_number().over(w).alias("place"), "id", "impact", "effort", "title").where(F.col("place") <= most)


def notes(facts_: DataFrame, stats: DataFrame, found: DataFrame) -> DataFrame:
    """(repo_id, partial, notes array<string>) with stats (repo_id, files_total) of ignore.walk_stats.

    partial holds wherever a file outside ignored folders was left out, binary and ignored ones too.
    """
    secret = found.where(F.col("id").isin("security.credentialfiles", *[s[0] for s in R.SECRETS])).select("repo_id").distinct().withColumn("secret", F.lit(True))
    x = facts_.select("repo_id", "files", "unresolved").join(stats.select("repo_id", "files_total"), "repo_id", "left").join(secret, "repo_id", "left")
    partial = F.coalesce(F.col("files_total") > F.col("files"), F.lit(False))
    told = F.array_compact(F.array(
        F.when(partial, F.format_string("%d of %d files were looked at", "files", "files_total")),
        F.when(F.col("secret"), "replace every secret that was found, and clean the history"),
        F.when(F.col("unresolved") > 20, F.format_string("%d imports lead to no file", "unresolved")),
    ))
    return x.select("repo_id", partial.alias("partial"), told.alias("notes"))


def report(facts_: DataFrame, found: DataFrame) -> DataFrame:
    """(repo_id, files, loc, findings, overall, grade), one row a repository."""
    n = found.groupBy("repo_id").agg(F.count(F.lit(1)).alias("findings"))
    return facts_.select("repo_id", "files", "loc").join(n, "repo_id", "left").fillna(0, ["findings"]).join(scoring.overall(scores(facts_, found)), "repo_id")
