"""Order of versions and advisories by ranges against plain comparison."""

import random
import re

from pyspark.sql import functions as F

from treegauge.operators import versions
from treegauge.operators.versions import in_ranges, version_key

ORDERED = ["0", "0.0.1-1", "0.0.1", "0.9", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.post1", "1.0.post2", "1.0.0.1", "1.0.1", "1.2", "1.10.0-rc.1", "1.10", "2.0b1", "2.0rc1", "2.0rc12", "2", "10.0.0-a", "10", "99999999999999999999999.1"]
SAME = [("1.0", "1"), ("1.0.0+build.5", "1"), ("v1.2.0", "1.2"), ("1.0-rc1", "1.0rc1"), ("01.02", "1.2"), ("1.0.0-rc.1+x", "1.0.0-rc.1"), (" 1.2 ", "1.2")]


def test_versions_sort(spark):
    mixed = ORDERED[:]
    random.Random(1).shuffle(mixed)
    df = spark.createDataFrame([(v,) for v in mixed], "v string")
    assert [r.v for r in df.orderBy(version_key(F.col("v"))).collect()] == ORDERED
    both = spark.createDataFrame(SAME, "a string, b string").select(version_key(F.col("a")).alias("a"), version_key(F.col("b")).alias("b"))
    assert all(r.a == r.b for r in both.collect())
    none = spark.createDataFrame([("",), (None,), ("latest",), ("*",), ("-1",)], "v string")
    assert {r.k for r in none.select(version_key(F.col("v")).alias("k")).collect()} == {None}


def plain(v):
    m = re.match(r"([0-9]+)\.([0-9]+)(?:-rc\.([0-9]+))?$", v)
    return (int(m[1]), int(m[2]), 1 if m[3] is None else 0, int(m[3] or 0))


def test_ranges_against_every_pair(spark):
    rng = random.Random(3)
    v = lambda: f"{rng.randrange(4)}.{rng.randrange(12)}" + (f"-rc.{rng.randrange(12)}" if rng.random() < 0.3 else "")
    deps = [(rng.randrange(30), rng.choice(["pip", "npm"]), rng.choice(["hot", "hot", "a", "b", "c"]), v()) for _ in range(600)] + [(1, "pip", "a", "unknown"), (1, "pip", None, "1.0"), (1, "pip", "a", None)]
    ranges = [(rng.choice(["PyPI", "npm"]), rng.choice(["hot", "a", "b", "zz"]), f"V{rng.randrange(25):02}", rng.choice([None, "0", v(), v()]), *rng.choice([(None, None), (v(), None), (None, v()), (v(), v())])) for _ in range(60)]
    ranges += [("PyPI", "a", "V99", "x", "2.0", None), ("PyPI", "a", "V98", "2.0", "2.0", None), ("PyPI", "a", "V97", "3.0", "1.0", None), ("PyPI", None, "V96", "0", None, None)]

    def inside(d, r):
        _, eco, name, version = d
        if {"PyPI": "pip"}.get(r[0], r[0]) != eco or r[1] != name or name is None or version in (None, "unknown") or r[3] == "x":
            return False
        x = plain(version)
        low = r[3] in (None, "0") or plain(r[3]) <= x
        return low and (x < plain(r[4]) if r[4] else x <= plain(r[5]) if r[5] else True)

    want = sorted((*d, sorted({r[2] for r in ranges if inside(d, r)})[:8]) for d in deps if any(inside(d, r) for r in ranges))
    got = in_ranges(spark.createDataFrame(deps, "repo_id long, ecosystem string, name string, version string"), spark.createDataFrame(ranges, "ecosystem string, name string, vuln_id string, introduced string, fixed string, last_affected string"))
    assert sorted((r.repo_id, r.ecosystem, r.name, r.version, r.vulns) for r in got.collect()) == want
    assert len(want) > 200


def test_texts_become_keys_once(spark, monkeypatch):
    deps = spark.createDataFrame([(i, "npm", f"p{i % 3}", v) for i in range(9) for v in ("1.0", "1.0.0", "1.2-rc.1", "2.1", "x")], "repo_id long, ecosystem string, name string, version string")
    ranges = spark.createDataFrame([("npm", f"p{i % 2}", f"V{i:02}", "1.0", "2.0" if i % 4 else None, None) for i in range(24)] + [("npm", "p1", None, "0", None, "1.0")], "ecosystem string, name string, vuln_id string, introduced string, fixed string, last_affected string")

    def rows():
        got = in_ranges(deps, ranges)
        # keys come from a table: neither the versions nor the ranges of the plan are lexed
        assert "regexp_extract" not in got._jdf.queryExecution().optimizedPlan().toString()
        return sorted((r.repo_id, r.name, r.version, r.vulns) for r in got.collect())

    few = rows()
    assert len(few) == 3 * 4 + 3 * 3
    assert few[0] == (0, "p0", "1.0", [f"V{i:02}" for i in range(0, 16, 2)])
    assert (0, "p0", "2.1", [f"V{i:02}" for i in range(0, 24, 4)]) in few
    monkeypatch.setattr(versions, "FEW_TEXTS", 0)
    assert rows() == few
