"""Every query that SQL can express, against DuckDB at the smallest scale."""

import math
from pathlib import Path

import pytest

from treegauge import catalog, catalog_code, catalog_graphs, catalog_streams, catalog_trees

DATA = Path("/root/testdata/sf0.001")
ALL = (catalog, catalog_trees, catalog_code, catalog_graphs, catalog_streams)
ORACLES, QUERIES = ({k: v for c in ALL for k, v in getattr(c, kind).items()} for kind in ("ORACLES", "QUERIES"))


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda x: None if x is None else round(x, 6) if isinstance(x, float) and not math.isnan(x) else str(x) if not isinstance(x, int) or isinstance(x, bool) else int(x)
    return sorted((tuple(clean(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
