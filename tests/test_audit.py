"""The whole audit over trees written here, and references between files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from treegauge.operators import imports as I
from treegauge.plans import audit

META = "repo_id string, license string, contributors int, bus_factor int, archived boolean, pushed_at timestamp, languages array<string>"
ADVICE = "ecosystem string, name string, version string, vuln_id string"
BRANCHY = "export function gate(a) {\n" + "".join(f"  if (a === {i} && a) {{ a += {i}; }}\n" for i in range(10)) + "  return eval(a);\n}\n"
SAME = "".join(f"const shared_value_{i} = compute({i});\n" for i in range(12))


def tree(spark, repo, files):
    return spark.createDataFrame([(repo, p, len(t), t) for p, t in files.items()], "repo_id string, path string, size long, raw string")


@pytest.fixture(scope="module")
def audited(spark):
    poor = {
        "package.json": '{"dependencies": {"a": "1"}}',
        "requirements.txt": "oldlib==1.0\n",
        "README.md": "# Hi\n",
        "src/auth/login.ts": 'import { a } from "../util/a";\nimport React from "react";\n' + BRANCHY + 'const apiKey = "' + "q8Zr3LmW" + "v6Tn1KpX" + '";\n',
        "src/util/a.ts": 'import "../auth/login";\n' + SAME,
        "src/util/b.ts": SAME,
        "app/worker.py": "import subprocess\nsubprocess.run(c, shell=True)\n" + "# TODO fix\n" * 6,
        ".env": "KEY=" + "AKIA" + "Z7QW2N5R8T1Y4U6P" + "\n",
        "node_modules/x.js": "eval(1)",
    }
    good = {
        "README.md": "# Tool\n```\nnpm install tool\n```\n" + "What it does, at length. " * 30,
        "LICENSE": "free",
        ".github/workflows/ci.yml": "run: npm test --coverage\n",
        ".editorconfig": "root = true",
        "package.json": "{}",
        "yarn.lock": "",
        "src/a.ts": "export const a = 1;\n",
        "tests/a.test.ts": "test(1);\n",
    }
    files = tree(spark, "poor", poor).unionByName(tree(spark, "good", good))
    meta = spark.createDataFrame([("poor", None, 3, 1, False, datetime(2020, 1, 1), ["TypeScript"]), ("good", "MIT", 4, 2, False, datetime(2024, 12, 1), ["TypeScript"])], META)
    advice = spark.createDataFrame([("pip", "oldlib", "1.0", "V-1")], ADVICE)
    known, code = audit.facts(files, meta, advice, datetime(2025, 1, 1))
    return known, audit.findings(known, code)


def test_findings(audited):
    got = {(r.repo_id, r.id): (r.severity, r.penalty) for r in audited[1].collect()}
    poor = {id_ for repo, id_ in got if repo == "poor"}
    assert poor == {
        "security.awskeys", "security.generic", "security.credentialfiles", "security.pattern.eval", "security.pattern.shell", "security.nolock", "security.deps",
        "quality.complexity", "quality.duplication", "documentation.readmemd", "documentation.license", "documentation.contributing", "testing.notests", "testing.noci",
        "maintainability.linter", "maintainability.todos", "maintainability.busfactor", "maintainability.stale", "graph.cycles",
    }
    assert got["poor", "security.awskeys"] == ("critical", 30) and got["poor", "quality.complexity"] == ("minor", 4) and got["poor", "security.deps"] == ("major", 10)
    assert {id_ for repo, id_ in got if repo == "good"} == {"documentation.contributing"}


def test_report(audited):
    known, found = audited
    rows = {r.repo_id: r for r in audit.report(known, found).collect()}
    assert rows["good"].grade in ("A+", "A") and rows["poor"].grade == "F" and rows["poor"].findings == 19
    score = {(r.repo_id, r.category): r.score for r in audit.scores(known, found).collect()}
    assert score["poor", "security"] == 16 and score["poor", "testing"] == 5 and score["good", "testing"] == 100


def test_plan(audited):
    got = [(r.place, r.id) for r in audit.plan(audited[1]).where("repo_id = 'poor'").orderBy("place").collect()]
    assert len(got) == 12 and got[:3] == [(1, "security.awskeys"), (2, "security.generic"), (3, "security.credentialfiles")]
    assert got[6][1] == "security.pattern.eval"


def test_references(spark):
    js = 'import x from "./b";\nexport { y } from "../lib/c";\nconst z = require("@s/p/q");\nimport("left-pad");\nimport "./gone";\n'
    files = spark.createDataFrame([("r", "src/a.ts", js, "js"), ("r", "src/B.ts", "", "js"), ("r", "lib/c/index.js", "", "js"), ("r", "m.py", "from pkg.mod import f\nimport os\n", "python"), ("r", "src/pkg/mod.py", "", "python")], "repo_id string, path string, raw string, analysis string")
    refs = I.imported(files)
    assert {(r.package, r.n) for r in I.packages(refs).collect()} == {("@s/p", 1), ("left-pad", 1)}
    found = I.links(refs, files)
    assert {(r.src, r.dst) for r in I.file_edges(found).collect()} == {("src/a.ts", "src/B.ts"), ("src/a.ts", "lib/c/index.js"), ("m.py", "src/pkg/mod.py")}
    assert found.where(F.col("target").isNull()).count() == 2
    assert {(r.src, r.dst) for r in I.module_edges(I.file_edges(found)).collect()} == {("src", "lib/c"), ("(root)", "src/pkg")}


def test_paths_above_the_root(spark):
    row = spark.range(1).select(I.joined(F.lit("a/b"), F.lit("../../../c/./d")).alias("p")).first()
    assert row.p == "c/d"
