"""What lands beside trees, ignore files, rules of the user's own, the intended mode, and outputs."""

import io
import json
import tarfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from treegauge import scratch
from treegauge.operators import deps as D
from treegauge.operators import ignore as IG
from treegauge.operators import layout as LO
from treegauge.operators import secrets as S
from treegauge.plans import architecture as A
from treegauge.plans import audit, outputs
from treegauge.sources import landed as LA
from treegauge.streaming import jobs as ST


@pytest.mark.parametrize(("text", "want"), [
    ("https://github.com/a/b.git", ("a", "b", None)), ("www.github.com/a/b/tree/dev/x", ("a", "b", "dev")), (" a/b ", ("a", "b", None)), ("a/b/c", None), ("https://elsewhere.org/a/b", None), ("", None), (None, None),
])
def test_addresses(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(LA.parsed_address(F.col("x")).alias("a")).first().a
    assert (None if got is None else tuple(got)) == want


def archive(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "one.tar.gz").write_bytes(archive({"r-1/a.py": "x", "r-1/src/b.py": "y"}))
    (tmp_path / "two.tgz").write_bytes(archive({"r-2/wrap/c.py": "z", "r-2/wrap/d/e.py": "", "r-2/wrap/.env": "A=1"}))
    (tmp_path / "bad.tar").write_bytes(b"no archive")
    (tmp_path / "none.tar").write_bytes(archive({}))
    tree, refused = LA.archives(spark, str(tmp_path))
    assert {(r.repo_id, r.path, r.raw) for r in tree.collect()} == {("one", "a.py", "x"), ("one", "src/b.py", "y"), ("two", "c.py", "z"), ("two", "d/e.py", ""), ("two", ".env", "A=1")}
    assert {(r.repo_id, r.status) for r in refused.collect()} == {("bad", 422), ("none", 422)}
    tree, refused = LA.archives(spark, str(tmp_path), most=20)
    assert {(r.repo_id, r.status) for r in refused.where("status = 413").collect()} == {("one", 413), ("two", 413), ("none", 413)}


def test_metadata(spark):
    rows = [
        ("a", json.dumps({"name": "n", "owner": {"login": "o"}, "license": {"spdx_id": "NOASSERTION"}, "pushed_at": "2024-01-02T03:04:05Z"}), '{"Go": 1, "C": 5}', '[{"contributions": 1}, {"contributions": 1}]'),
        ("b", "{}", None, None),
        ("c", "{broken", "[]", "{}"),
    ]
    got = {r.repo_id: r for r in LA.repo_meta(spark.createDataFrame(rows, "repo_id string, repo string, languages string, contributors string")).collect()}
    assert got["a"].languages == ["C", "Go"] and got["a"].license is None and got["a"].bus_factor == 1 and got["a"].pushed_at == datetime(2024, 1, 2, 3, 4, 5)
    assert got["b"].contributors == 0 and got["b"].bus_factor == 0 and got["b"].archived is False and len(got) == 3
    local = LA.local_meta(spark.createDataFrame([("x",)], "repo_id string"), datetime(2025, 1, 1))
    assert local.columns == LA.repo_meta(spark.createDataFrame([], "repo_id string, repo string, languages string, contributors string")).columns
    assert (local.first().bus_factor, local.first().languages) == (1, [])


def test_stored_jobs_and_results(spark, tmp_path):
    assert LA.stored_jobs(spark, str(tmp_path / "none.json")).count() == 0
    jobs = [{"id": "j1", "owner": "o", "repo": "r", "status": "done", "progress": 100, "createdAt": "2024-01-01T00:00:00Z", "resultId": "x", "summary": {"overall": 70, "grade": "C"}}, {"id": "j2", "status": "queued"}]
    (tmp_path / "jobs.json").write_text(json.dumps(jobs, indent=2))
    got = {r.id: r for r in LA.stored_jobs(spark, str(tmp_path / "jobs.json")).collect()}
    assert got["j1"].summary.grade == "C" and got["j1"].seq == 0 and got["j2"].seq == 1 and got["j2"].resultId is None
    doc = lambda n: json.dumps({"id": "x", "repo": {"owner": "o", "name": "r"}, "scores": {"overall": n, "grade": "C"}, "analyzedAt": "2024"})
    at = str(tmp_path / "results")
    LA.save_results(spark.createDataFrame([("x", doc(1)), ("y", doc(2))], "id string, document string"), at)
    LA.save_results(spark.createDataFrame([("x", doc(3))], "id string, document string"), at)
    assert sorted(r.overall for r in outputs.listed(LA.stored_results(spark, at)).collect()) == [2, 3]


def test_ignore_rules(spark):
    text = "build2/\r\n*.gen.js\n!keep.js\n# no\n/only\nname.txt\n.local\na/b\n\n"
    files = [".gitignore", "x/build2/f.js", "f.gen.js", "keep.js", "only/f.js", "name.txt", "q.local", "a/b/c.js", "x/a/b/c.js", "src/f.js"]
    df = spark.createDataFrame([("r", p, text if p == ".gitignore" else "") for p in files] + [("s", p, "") for p in files], "repo_id string, path string, raw string")
    rules = IG.ignore_rules(df)
    assert {(r.kind, r.pattern) for r in rules.collect()} == {("dir", "build2"), ("suffix", ".gen.js"), ("dir", "only"), ("path", "*name.txt"), ("suffix", ".local"), ("path", "a/b")}
    kept = {(r.repo_id, r.path) for r in IG.unignored(df, rules).collect()}
    assert kept == {("r", p) for p in (".gitignore", "keep.js", "name.txt", "x/a/b/c.js", "src/f.js")} | {("s", p) for p in files}
    fixed = {r.path for r in IG.unignored(df, IG.ignore_rules(df, fixed=True)).where("repo_id = 'r'").collect()}
    assert "name.txt" not in fixed and "src/f.js" in fixed
    assert IG.unignored(df.limit(0), rules).count() == 0


def test_secrets_of_one_line_and_over_lines(spark):
    keys = ["AK" + "IA" + x for x in ("Q7RTZ2MN5PLW9XKC", "W3ERT8YU1IOP5ASD")]
    rows = [("r", "src/latest/a.ts", f'\nx = "{keys[0]}"; y = "{keys[1]}"\n'), ("r", "src/b.test.ts", 'pwd\n:\n"q8Zr3LmWv6Tn1KpX"'), ("r", "c.ts", 'secret = "password"'), ("r", "d.ts", "é" + keys[0]), ("r", "e.ts", None), ("r", "f.ts", "")]
    m = S.secret_matches(spark.createDataFrame(rows, "repo_id string, path string, raw string"))
    assert {(r.path, r.pattern, r.nth, r.line, r.value) for r in m.collect()} == {("src/latest/a.ts", "security.awskeys", 0, 2, keys[0]), ("src/latest/a.ts", "security.awskeys", 1, 2, keys[1]), ("src/b.test.ts", "security.generic", 0, 1, "q8Zr3LmWv6Tn1KpX"), ("d.ts", "security.awskeys", 0, 1, keys[0])}
    # paths that end in test/ count less, names that hold .test. don't
    assert {(r.pattern, r.severity) for r in S.secret_findings(m).collect()} == {("security.awskeys", "major"), ("security.generic", "major")}


def test_nested_locks(spark):
    deep = {"version": "9.9.9"}
    for i in range(12):
        deep = {"version":f"1.0.{i}","dependencies":{f"n{i}":deep}}
    files = [(1,json.dumps({"dependencies":{"a":{"version":"1.0","dependencies":{"b":{"version":"2.0"},"x.y/z $":{"version":"3"}}},"s":"text","n":None,"num":{"version":5},"l":[1],"c":{"dependencies":{"d":{"version":"4"}}}}})),(2,"{broken"),(3,None),(4,"[]"),(5,json.dumps({"dependencies":{"top":deep}})),(6,'{"dependencies":5}')]
    got = sorted(tuple(r) for r in D.nested_versions(spark.createDataFrame(files,"repo_id int, content string")).collect())
    assert [r for r in got if r[0]==1]==[(1,"a","1.0"),(1,"b","2.0"),(1,"d","4"),(1,"x.y/z $","3")], got
    assert len([r for r in got if r[0]==5])==13 and {r[0] for r in got}=={1,5}
    assert D.nested_versions(spark.createDataFrame([],"repo_id int, content string")).count()==0


def test_layout_is_still_and_inside(spark):
    n = spark.createDataFrame([("r", f"m{i}", i) for i in range(6)], "repo_id string, id string, loc int")
    e = spark.createDataFrame([("r", "m0", "m1", 3), ("r", "m1", "gone", 1)], "repo_id string, src string, dst string, weight int")
    a, b = (sorted(map(tuple, LO.layout(n, e).collect())) for _ in range(2))
    assert a == b and len(a) == 6 and all(70 <= x <= 790 and 50 <= y <= 510 for _, _, x, y in a)
    left = 1.0  # what gravity leaves of the distance to the middle
    for turn in range(260):
        left *= 1 - 0.025 * (1 - turn / 260)
    assert LO.settle(1, [])[0] == pytest.approx((430 + 140 * left, 280))


def test_file_graph_only_of_small_repositories(spark):
    files = spark.createDataFrame([("big", f"f{i}.js", 1, "js") for i in range(101)] + [("small", p, 2, "js") for p in ("a.js", "b.js")], "repo_id string, path string, lines long, analysis string")
    edges = spark.createDataFrame([("big", "f1.js", "f2.js", 1), ("small", "a.js", "b.js", 2), ("small", "b.js", "a.js", 1)], "repo_id string, src string, dst string, weight long")
    none = spark.createDataFrame([], "repo_id string, path string, complexity int")
    nodes, held = A.file_graph(files, none, edges)
    assert {(r.id, r.fan_in, r.fan_out, r.in_cycle) for r in nodes.collect()} == {("a.js", 1, 2, True), ("b.js", 2, 1, True)}
    assert all(r.in_cycle for r in held.collect()) and held.count() == 2
    assert A.module_nodes(files, none).where("repo_id = 'big'").first().loc == 101


def test_fixed_mode_and_own_rules(spark, monkeypatch):
    monkeypatch.setattr(audit, "_MORE", [])
    tree = {"docs/README.md": "# Hi", "README.md": "# Tool\n\n## Install\n\n## Usage\n" + "Words. " * 80, "server.pem": "KEY", ".travis.yml": "script: pytest", "src/a.ts": "/** told */\nfunction f(a) {\n  if (a) {\n    return 1;\n  }\n}\n" * 22}
    df = spark.createDataFrame([("r", p, len(t), t) for p, t in tree.items()], "repo_id string, path string, size long, raw string")
    meta = LA.local_meta(spark.createDataFrame([("r",)], "repo_id string"), datetime(2025, 1, 1))
    none = spark.createDataFrame([], "ecosystem string, name string, version string, vuln_id string")
    audit.register(lambda: audit.Rule("house.size", F.when(F.col("files") > 3, "minor"), F.lit("many files")), "low", "low", "Remove files")
    said = []

    def ids(fixed):
        p = audit.parts(df, none, fixed, lambda stage, percent, message: said.append((stage, percent)))
        k = audit.known(p, meta, datetime(2025, 1, 1), fixed)
        return audit.findings(k, p.code, fixed)

    compat, fixed = ids(False), ids(True)
    a, b = ({r.id: r.severity for r in x.collect()} for x in (compat, fixed))
    assert a["documentation.readmemd"] == "major" and "documentation.readmemd" not in b and "documentation.sections" not in b
    assert "security.credentialfiles" not in a and b["security.credentialfiles"] == "critical"
    assert a["testing.noci"] == "major" and "testing.noci" not in b and "testing.cinotests" not in b
    assert a["documentation.docstrings"] == "major" and "documentation.docstrings" not in b
    assert a["house.size"] == b["house.size"] == "minor" and audit.plan(compat).where("id = 'house.size'").first().title == "Remove files"
    assert said[0] == ("parse", 30) and said[-1] == ("graph", 80)
    rows = audit.detailed(compat, audit.places(audit.parts(df, none))).collect()
    assert all(r.title and r.detail is not None for r in rows)


def test_pushed_updates(spark, tmp_path):
    spark.createDataFrame([(1, 1, "queued"), (1, 2, "done"), (2, 1, "queued"), (3, 1, "running"), (3, 2, "error")], "job_id int, seq int, status string").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("job_id int, seq int, status string").parquet(str(tmp_path / "in"))
    assert ST.awaited(stream(), [1, 2, 3], str(tmp_path / "c1")) == {1: "done", 3: "error"}
    got = []
    q = ST.pushed(stream(), lambda batch, i: got.extend(tuple(r) for r in batch.collect()), str(tmp_path / "c2"), [2])
    q.processAllAvailable()
    q.stop()
    assert got == [(2, "queued", 1)]


def test_cards_escape_and_cut(spark):
    graded = spark.createDataFrame([("a<b", 90, "A"), ("x" * 60, 40, "F")], "repo_id string, overall long, grade string")
    scores = spark.createDataFrame([("a<b", "quality", 90), ("x" * 60, "quality", 20)], "repo_id string, category string, score long")
    rows = outputs.duel(scores, graded, spark.createDataFrame([("a<b", "x" * 60)], "a string, b string"))
    v = outputs.verdict(rows, graded)
    assert v.first().verdict == "a<b wins 1 of 5 categories, 90% against 40% overall"
    svg = outputs.card(rows, v).first().svg
    assert "a&lt;b" in svg and "x" * 27 + "…" in svg and svg.startswith("<svg") and svg.endswith("</svg>") and "#34d399" in svg
    assert {r.colour for r in outputs.badge(graded).collect()} == {"#97ca00", "#e05d44"}


def test_scratch_tables(spark):
    t = scratch.written(spark.range(3))
    path = t._treegauge_path
    assert t.count() == 3
    scratch.forget(t)
    with pytest.raises(Exception, match="(?i)does not exist|not found|PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_small_documents_are_shared_out_among_tasks(spark, tmp_path):
    # as in results.Analysis: one aggregate makes the documents, which are too small for more than one task by size
    docs = spark.range(40).groupBy(F.col("id").cast("string").alias("id")).agg(F.lit('{"id": "x"}').alias("document"))
    LA.save_results(docs, str(tmp_path / "many"))
    tasks = {f.name.split("-")[1] for f in (tmp_path / "many").rglob("part-*.txt")}
    assert len(list((tmp_path / "many").iterdir())) >= 40
    assert len(tasks) > 1


def test_matches_are_looked_for_once(spark, monkeypatch):
    looked = []
    one = audit.O.pattern_lines
    monkeypatch.setattr(audit.O, "pattern_lines", lambda files: looked.append(1) or one(files))
    df = spark.createDataFrame([("r", "app/x.py", 9, "eval(c)\n"), ("r", "README.md", 4, "# Hi")], "repo_id string, path string, size long, raw string")
    none = spark.createDataFrame([], "ecosystem string, name string, version string, vuln_id string")
    p = audit.Parts(df, none)
    # what is asked for by findings and by places is one table
    monkeypatch.setattr(audit.Parts, "functions", spark.createDataFrame([], "repo_id string, path string, name string, line int, complexity int, nesting int"))
    monkeypatch.setattr(audit.Parts, "bad", spark.createDataFrame([], "repo_id string, ecosystem string, name string, version string, vulns array<string>"))
    facts = spark.createDataFrame([], audit.known(p, LA.local_meta(df.select("repo_id").distinct(), datetime(2025, 1, 1)), datetime(2025, 1, 1)).schema)
    found = audit.findings(facts, p.code, p=p)
    assert {r.id for r in found.collect()} == {r.id for r in audit.places(p).select("id").distinct().collect()} != set()
    assert looked == [1]
