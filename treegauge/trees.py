"""Source trees made of the driver's pages, in SQL that Spark and DuckDB read alike.

Forty pages are one repository. Every page is a file with its whole html, and each of the first
twenty-one is besides it one of the files that the rules look at; what it holds differs between
six kinds of repositories (g), so that every rule fires somewhere and stays silent elsewhere.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

REPO = 40
KINDS = 6


def lit(text: str) -> str:
    """text as an expression, with chr() for what the two dialects write differently."""
    out, run = [], ""
    for c in text:
        if c in "\n'\\":
            out += [f"'{run}'"] * bool(run) + [f"chr({ord(c)})"]
            run = ""
        else:
            run += c
    out += [f"'{run}'"] * bool(run or not out)
    return "(" + " || ".join(out) + ")"


def by_kind(*texts: str | None) -> str:
    """The text of each kind of repository; the last stands for all that follow."""
    last = len(texts) - 1
    whens = " ".join(f"WHEN {i} THEN {lit(t)}" for i, t in enumerate(texts[:-1]))
    return f"(CASE g {whens} ELSE {lit(texts[last])} END)" if whens else lit(texts[0])


# put together here, so that no token stands in the source
AWS = ["AK" + "IA" + x for x in ("Q7RTZ2MN5PLW9XKC", "W3ERT8YU1IOP5ASD")]
TOKENS = [
    "gh" + "p_" + "q8Zr3LmWv6Tn1KpXc5Bd7", "AI" + "za" + "q8Zr3LmWv6Tn1KpXc5Bd7Hf2Js9Lg4M", "xo" + "xb-" + "q8Zr3LmWv6Tn", "sk_" + "live_" + "q8Zr3LmWv6Tn1KpX", "npm" + "_" + "q8Zr3LmWv6Tn1KpXc5Bd7Hf2Js9Lg4",
    "gl" + "pat-" + "q8Zr3LmWv6Tn1KpXc5Bd", "sk" + "-" + "q8Zr3LmWv6Tn1KpXc5Bd7Hf2Js9Lg4Mq8Zr3LmWv6Tn1", "S" + "G." + "q8Zr3LmWv6Tn1KpX." + "c5Bd7Hf2Js9Lg4Mq8", "81726354" + ":A" + "A" + "q8Zr3LmWv6Tn1KpXc5Bd7Hf2Js9Lg4Mq8",
]
STRONG = "q8Zr3LmWv6Tn1KpX"
KEYS = (
    f'const a = "{AWS[0]}", b = "{AWS[1]}";\n-----BEGIN ' + "RSA PRIVATE KEY-----\n" + "".join(f'use("{t}");\n' for t in TOKENS)
    + f'secret = "{STRONG}" || process.env.S;\nlet token = "changeme-now", pwd :\n "{STRONG}9", PASSWORD="aaaaaaaaaaaa";\n'
)
SAME = "".join(f"const shared_value_{i} = compute({i});\n" for i in range(12))
DEEP = "def deep(a):\n" + "".join("    " * i + "if a:\n" for i in range(1, 8)) + "    " * 8 + "return a\n"
RISKY = "subprocess.run(c, shell=True)\nrequests.get(u, verify=False)\npickle.load(f)\nyaml.load(f)\nexec(c)\ntempfile.mktemp()\n"
NPM = json.dumps({"packages": {"": {"version": "1.0.0"}, "node_modules/a": {"version": "1.2.3"}, "node_modules/a/node_modules/b": {"version": "9.9.9"}, "node_modules/@s/c": {"version": "^2"}, "packages/w": {"version": "0.1.0"}, "node_modules/d": {"version": "1.*"}}})
NPM1 = json.dumps({"dependencies": {"a": {"version": "1.2.3", "dependencies": {"b": {"version": "2.0.0"}, "c": {"version": "^1"}}}, "e": {"version": "5.0.1"}}})
COMPOSER = json.dumps({"packages": [{"name": "p/q", "version": "v3.1"}], "packages-dev": [{"name": "p/r", "version": "dev-main"}, {"name": "p/s", "version": "2.0"}]})
MANY = json.dumps({"dependencies": {f"d{i}": "1" for i in range(85)}})
SOME = json.dumps({"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"c": "3"}})

#: (k, path, text) of the files that the rules look at.
FILES: list[tuple[int, str, str]] = [
    (0, by_kind("README.md", "README.md", "README.md", "README.md", "docs/README.md", "docs/guide.txt"), f"(CASE g WHEN 1 THEN {lit('# Hi')} WHEN 2 THEN {lit('# Tool' + chr(10))} || repeat('What it does, at length. ', 30) ELSE {lit('# Usage' + chr(10) + '```' + chr(10) + 'npm install x' + chr(10) + '```' + chr(10))} || repeat('What it does. ', 40) || html END)"),
    (1, by_kind("package.json", "package.json", "package.json", "web/package.json", "package.json"), by_kind(MANY, "{broken", '{"dependencies": {"a": "1"}}', SOME)),
    (2, by_kind("package-lock.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock"), by_kind(NPM, NPM1, '# yarn\n"@s/q@^1":\n  version "1.4.0"\n\nleft@^2, left@^2.1:\n  version "2.1.0"\n', "packages:\n  /p@1.0.0:\n    x: y\n  '@s/t@2.0.0':\n  /@s/u@3.1.0(peer):\n", '[[package]]\nname = "Old_Lib"\nversion = "1.0"\n', '[[package]]\nname = "x"\nversion = "0.1.0"\n\n[[package]]\nname = "y"\nversion = "2.*"\n')),
    (3, by_kind("requirements.txt", "go.mod", "composer.lock", "go.sum", "pom.xml", "requirements-dev.txt"), by_kind("Foo_Bar==1.0\nbaz>=2\noldlib == 1.0 ; python\n# c\n", "module m\nrequire (\n  a/b v1\n  c v2\n)\n", COMPOSER, "ex/a v1.2.0 h1:x\nex/a v1.2.0/go.mod h1:y\nex/b v2.0.0\n", "<dependency></dependency><dependency>", "pytest==8.0\n")),
    (4, by_kind(".gitignore", ".gitignore", ".gitignore", "sub/.gitignore", ".gitignore"), lit("generated/\n*.tmp.js\n/legacy\n!keep\n# c\nsecret.txt\n.cache.js\nlib/skip\n  \n/\n")),
    (5, lit("generated/auto.ts"), lit("export const g = 1;\n")),
    (6, by_kind("src/x.tmp.js", "src/x.cache.js"), lit("const t = 1;\n")),
    (7, lit("lib/skip/y.py"), lit("y = 1\n")),
    (8, lit("legacy/z.py"), lit("z = 1\n")),
    (9, lit("src/auth/login.ts"), f"{lit('import { a } from ' + chr(34) + '../util/a' + chr(34) + ';' + chr(10) + 'import React from ' + chr(34) + 'react' + chr(34) + ';' + chr(10) + 'export function gate(a) {' + chr(10))} || repeat({lit('  if (a === 1 && a) { a += 1; }' + chr(10))}, CASE WHEN g < 3 THEN 10 ELSE 3 END) || {lit('  return eval(a);' + chr(10) + '}' + chr(10) + 'const apiKey = ' + chr(34) + STRONG + chr(34) + ';' + chr(10))}"),
    (10, lit("src/util/a.ts"), by_kind(*['import "../auth/login";\n' + SAME] * 4, SAME)),
    (11, lit("src/util/b.ts"), lit(SAME + 'export { q } from "./a";\nconst z = require("@s/p/deep");\nimport("left-pad");\nimport "./gone";\n')),
    (12, lit("app/worker.py"), by_kind("from app.helper import f\nimport subprocess\nx = 1\n" + RISKY + "# TODO fix\n" * 6 + DEEP, *["from app.helper import f\nimport subprocess\nx = 1\n" + RISKY + "# TODO fix\n" * 6] * 2, "from app.helper import f\nimport os, sys\nx = 1\n")),
    (13, by_kind("app/helper.py", "app/helper.py", "app/helper.py", "go.mod", "app/helper.py"), by_kind("from app.worker import w\ndef f(a):\n    b = a\n    c = b\n    return c\n", "from app.worker import w\n" + "def f(a):\n    b = a\n    c = b\n    return c\n" * 25, "import lonely\n", "module m\nrequire a v1\nrequire b v2\n", "import lonely\n")),
    (14, by_kind("tests/a.test.ts", "tests/a.test.ts", "src/more.ts", "tests/a.test.ts"), f"repeat({lit('t(1);' + chr(10))}, CASE g WHEN 0 THEN 3 WHEN 1 THEN 700 WHEN 3 THEN 12 ELSE 60 END)"),
    (15, by_kind(".github/workflows/ci.yml", ".github/workflows/ci.yml", ".github/workflows/ci.yml", ".gitlab-ci.yml", ".travis.yml", ".github/workflows/ci.yaml"), by_kind("run: npm test\n", "run: npm run test --coverage\n", "run: build\n", "run: pytest\n", "script: pytest\n", "run: cargo test\n")),
    (16, by_kind(".editorconfig", "pyproject.toml", "codecov.yml", ".coveragerc", "setup.cfg", "LICENSE"), by_kind("root = true\n", "[tool.ruff]\n[tool.coverage]\n", "x: y\n", "[run]\n", "[coverage:run]\n", "free\n")),
    (17, by_kind(".env", ".env.example", "conf/id_rsa", "credentials.json", "server.pem", "service-account-x.json"), by_kind(f"KEY={AWS[0]}\n", f"KEY={AWS[1]}\n", "words\n", "{}", "words\n", "{}")),
    (18, lit("src/big.js"), f"repeat({lit('x=1;' + chr(10))}, CASE g WHEN 0 THEN 900 WHEN 1 THEN 500 ELSE 20 END)"),
    (19, by_kind("src/keys.ts", "latest/keys.ts", "src/keys.test.ts", "src/keys.ts", "src/keys.ts", "CONTRIBUTING.md"), by_kind(KEYS, KEYS, KEYS, "let a = 1;\n", KEYS * 7, "help\n")),
    (20, lit("srv/main.go"), f"repeat({lit('a=1' + chr(10))}, CASE g WHEN 5 THEN 3500 ELSE 5 END)"),
]
PATH = "CASE k " + " ".join(f"WHEN {k} THEN {p}" for k, p, _ in FILES) + " ELSE 'pages/q' || CAST(k AS STRING) || '.rb' END"
TEXT = "CASE k " + " ".join(f"WHEN {k} THEN {t}" for k, _, t in FILES) + " ELSE 'x = ' || CAST(k AS STRING) END"
BASE = ["page_id", f"page_id % {REPO} AS k", f"CAST((page_id - page_id % {REPO}) / {REPO} AS BIGINT) % {KINDS} AS g", f"'r' || CAST(page_id - page_id % {REPO} AS STRING) AS repo_id", "coalesce(html, '') AS html"]
ROLES = ["repo_id", f"{PATH} AS path", f"{TEXT} AS raw"]
WHOLE = ["repo_id", "'pages/p' || CAST(k AS STRING) || '.go' AS path", "html AS raw"]

#: What the code host says of a repository, as it would land: three JSON texts, the last two missing at times.
LANDED = [
    "repo_id",
    f"""{lit('{"name": "')} || repo_id || {lit('", "owner": {"login": "o')} || CAST(g AS STRING) || {lit('"}, "stargazers_count": ')} || CAST(g * 700 AS STRING) || {lit(', "forks_count": 2, "open_issues_count": 3, "default_branch": "main", "language": "TypeScript", "license": ')} || {by_kind('null', '{"spdx_id": "NOASSERTION"}', '{"spdx_id": "MIT"}')} || {lit(', "created_at": "2019-05-01T00:00:00Z", "pushed_at": "')} || {by_kind(*["2024-12-01T00:00:00Z"] * 5, "2020-01-01T00:00:00Z")} || {lit('", "archived": ')} || {by_kind(*["false"] * 4, "true", "false")} || {lit('}')} AS repo""",
    f"CASE g WHEN 5 THEN NULL ELSE {by_kind(*['{' + chr(34) + 'TypeScript' + chr(34) + ': 10, ' + chr(34) + 'Python' + chr(34) + ': 50, ' + chr(34) + 'Go' + chr(34) + ': 20}'] * 3, '{}', '{' + chr(34) + 'Python' + chr(34) + ': 1}')} END AS languages",
    f"CASE g WHEN 3 THEN NULL ELSE {by_kind('[{' + chr(34) + 'contributions' + chr(34) + ': 10}, {' + chr(34) + 'contributions' + chr(34) + ': 3}, {' + chr(34) + 'contributions' + chr(34) + ': 2}]', '[{' + chr(34) + 'contributions' + chr(34) + ': 4}, {' + chr(34) + 'contributions' + chr(34) + ': 4}, {' + chr(34) + 'contributions' + chr(34) + ': 4}]', '[]', '[]', '[{' + chr(34) + 'contributions' + chr(34) + ': 1}]')} END AS contributors",
]
ADVICE = [("PyPI", "oldlib", "1.0", "V-1"), ("PyPI", "old-lib", "1.0", "V-2"), ("crates.io", "x", "0.1.0", "V-3"), ("npm", "p", "1.0.0", "V-4"), *[("npm", "a", "1.2.3", f"V-{i}") for i in range(10, 20)]]


def _base(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").selectExpr(*BASE)


def tree(spark: SparkSession, d: str) -> DataFrame:
    """(repo_id, path, size, raw) of all repositories."""
    base = _base(spark, d)
    both = base.selectExpr(*ROLES).union(base.selectExpr(*WHOLE))
    return both.selectExpr("repo_id", "path", "CAST(octet_length(raw) AS BIGINT) AS size", "raw")


def landed(spark: SparkSession, d: str) -> DataFrame:
    """(repo_id, repo, languages, contributors): JSON texts of each repository."""
    return _base(spark, d).where("k = 0").selectExpr(*LANDED)


def advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVICE, "ecosystem string, name string, version string, vuln_id string")


BASE_SQL = f"(SELECT {', '.join(BASE)} FROM pages)"
TREE_SQL = f"(SELECT repo_id, path, strlen(raw) AS size, raw FROM (SELECT {', '.join(ROLES)} FROM {BASE_SQL} UNION ALL SELECT {', '.join(WHOLE)} FROM {BASE_SQL}))"
LANDED_SQL = f"(SELECT {', '.join(LANDED)} FROM {BASE_SQL} WHERE k = 0)"
ADVICE_SQL = "(SELECT * FROM (VALUES " + ", ".join(str(x) for x in ADVICE) + ") v(ecosystem, name, version, vuln_id))"
