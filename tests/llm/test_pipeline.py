"""The pipeline's stages on a small table: what each drops, and that all keep the columns."""

import re
from pathlib import Path

import pytest

import corpus_pipeline as P
from treegauge.llm import common as C
from treegauge.llm import queries as Q

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
def test_pipeline(spark):
    docs = C.table(spark, str(DATA), "documents")
    kept = {}
    for name, stage in P.STAGES:
        docs = C.materialize(stage(spark, docs, str(DATA)))
        kept[name] = docs
    first = C.table(spark, str(DATA), "documents")
    for name in ("language", "near_duplicate", "benchmark", "mixture"):
        assert kept[name].columns == first.columns
    assert kept["language"].count() == first.count()  # every text has letters here
    text = {r.doc_id: r.text for r in kept["language"].collect()}
    sets = {}
    for d, t in text.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[d] = set(zip(*(w[i:] for i in range(5)), strict=False)) or {tuple(w)}
    stays = {r.doc_id for r in kept["near_duplicate"].collect()}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(linked(a, b) for a in stays for b in stays if a < b)
    assert all(any(linked(d, o) for o in sets if o != d) for d in set(sets) - stays)
    assert {r.doc_id for r in kept["mixture"].collect()} == {r.doc_id for r in kept["benchmark"].collect()}
    assert kept["shards"].count() == kept["mixture"].count()


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(Q.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = Q.QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(want.fetchall())
