"""From folders and archives to stored documents in one call, with progress."""

import json
import tarfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from treegauge.__main__ import main
from treegauge.plans import audit, results
from treegauge.sources import landed as LA

NOW = datetime(2025, 1, 1)
FILES = {
    "README.md": "# Demo\n",
    "package.json": json.dumps({"dependencies": {"left": "1.0.0"}}),
    "package-lock.json": json.dumps({"packages": {"": {}, "node_modules/left": {"version": "1.0.0"}, "node_modules/right": {"version": "2.1.0"}}}),
    "src/core/a.ts": "import { b } from '../util/b';\nimport x from 'left';\nexport function a(p: number) {\n  if (p && p > 1) { return b(p); }\n  return eval('1');\n}\n",
    "src/util/b.ts": "import { a } from '../core/a';\nimport y from '@s/right/deep';\nexport const b = (q: number) => {\n  return q ? a(q) : 0;\n};\n",
    "app/worker.py": "import os\n\n\ndef run(x):\n    if x:\n        return 1\n    return 2\n",
    ".env": "KEY=1\n",
    "image.png": "x",
    "node_modules/skip/me.js": "var a = 1;\n",
}


@pytest.fixture
def roots(tmp_path):
    for repo, files in (("one", FILES), ("two", {"main.py": "def f():\n    return 1\n"}), ("bare", {"notes.txt": "nothing to see"})):
        for path, text in files.items():
            at = tmp_path / repo / path
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
    return {r: str(tmp_path / r) for r in ("one", "two", "bare")}


def test_folders_to_documents(spark, roots, monkeypatch):
    seen, written = [], []
    real = audit.written

    def noted(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(audit, "written", noted)
    advice = spark.createDataFrame([("npm", "left", "1.0.0", "V-1"), ("npm", "left", "1.0.0", "V-2")], "ecosystem string, name string, version string, vuln_id string")
    docs = results.of_folders(spark, roots, NOW, advice, progress=lambda *x: seen.append((*x, len(written))))
    got = {r.id: json.loads(r.document) for r in docs.collect()}
    assert set(got) == {"one", "two", "bare"}
    one = got["one"]
    assert list(one) == list(results.MEMBERS)
    assert one["repo"] == {"url": None, "owner": "local", "name": "one", "ref": "main"} and one["prescription"] is None
    assert one["meta"]["contributors"] == 1 and one["meta"]["languages"] == {} and one["meta"]["pushedAt"] == "2025-01-01T00:00:00Z"
    assert [c["key"] for c in one["scores"]["categories"]] == ["security", "quality", "testing", "documentation", "maintainability"] or len(one["scores"]["categories"]) == 5
    assert all(c["penalty"] == 100 - c["score"] for c in one["scores"]["categories"])
    testing = next(c for c in one["scores"]["categories"] if c["key"] == "testing")
    assert testing["note"] == results.TESTING_NOTE and testing["contributions"][0]["penalty"] == 100
    assert {f["id"] for f in one["findings"]} >= {"security.pattern.eval", "security.credentialfiles", "security.deps", "testing.notests", "graph.cycles"}
    assert one["architecture"]["cycles"] == [["src/core", "src/util"]] and one["fileGraph"]["cycles"] == [["src/core/a.ts", "src/util/b.ts"]]
    assert {(e["source"], e["target"], e["weight"]) for e in one["fileGraph"]["edges"]} == {("src/core/a.ts", "src/util/b.ts", 1), ("src/util/b.ts", "src/core/a.ts", 1)}
    assert {(x["name"], x["count"]) for x in one["architecture"]["externalDeps"]} >= {("left", 1), ("@s/right", 1)}
    assert [n["label"] for n in one["fileGraph"]["nodes"]][0] in ("a.ts", "worker.py") and one["fileGraph"]["level"] == "file"
    assert one["stats"]["byLanguage"]["TypeScript"]["files"] == 2 and "Env/Key" in one["stats"]["byLanguage"]
    assert set(one["scores"]["confidence"]["languages"]) == set(one["stats"]["byLanguage"])
    assert one["vulnerableDeps"] == [{"name": "left", "version": "1.0.0", "ecosystem": "npm", "vulns": [{"id": i, "url": f"https://osv.dev/vulnerability/{i}"} for i in ("V-1", "V-2")]}]
    assert one["scores"]["confidence"]["partial"] and any("files were looked at" in n for n in one["notes"])
    assert all(p["detail"] for p in one["plan"]) and [p["rank"] for p in one["plan"]] == list(range(1, len(one["plan"]) + 1))
    assert got["bare"]["findings"] and got["bare"]["vulnerableDeps"] == [] and got["bare"]["scores"]["confidence"]["languages"] == []
    back = docs.select(F.from_json("document", LA.RESULT).alias("r")).where("r.id = 'two'").first().r
    assert back.stats.byLanguage["Python"].loc == 3 and back.architecture.nodes[0].kind == "module"
    # each message tells what had been written before it
    percents = [p for _, p, _, _ in seen]
    assert percents == sorted(percents) and percents[0] == 30 and percents[-1] == 96
    counts = {p: (m, n) for _, p, m, n in seen}
    assert counts[30] == (f"{written[0]} files are listed", 1) and counts[45][0].startswith(f"{written[1]} files are parsed") and counts[45][1] == 2
    assert counts[55] == (f"{written[2]} functions are measured", 3) and counts[72] == ("1 dependencies have advisories", 4) and counts[80][1] == 5


def test_archives_to_documents(spark, roots, tmp_path):
    (tmp_path / "landed").mkdir()
    for repo, root in roots.items():
        with tarfile.open(tmp_path / "landed" / f"{repo}.tar.gz", "w:gz") as z:
            z.add(root, arcname=f"{repo}-main")
    (tmp_path / "landed" / "bad.tar").write_text("no archive")
    docs, bad = results.of_archives(spark, str(tmp_path / "landed"), NOW)
    assert {r.id for r in docs.select("id").collect()} == {"one", "two", "bare"}
    assert [(r.repo_id, r.status) for r in bad.collect()] == [("bad", 422)]
    assert docs.where("id = 'one'").select(F.get_json_object("document", "$.architecture.cycles")).first()[0] == '[["src/core","src/util"]]'


def test_command(spark, roots, tmp_path, capsys):
    assert main([roots["one"], roots["two"], "--out", str(tmp_path / "store")], spark) == 0
    said = capsys.readouterr()
    assert "one: " in said.out and "two: " in said.out and "files are listed" in said.err
    stored = LA.stored_results(spark, str(tmp_path / "store"))
    assert {r.id for r in stored.select("id").collect()} == {"one", "two"}
    assert main([str(tmp_path / "none")], spark) == 2
