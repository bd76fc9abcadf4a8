"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tracemill.plans import registry

SF = "/root/testdata/sf0.001"


def cell(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def con():
    with duckdb.connect() as c:
        for f in os.listdir(SF):
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        yield c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    assert got
    if name in registry.ORACLE:
        out = con.execute(registry.ORACLE[name])
        found = [x[0] for x in out.description]
        assert sorted(found) == names
        want = sorted(tuple(cell(r[found.index(c)]) for c in names) for r in out.fetchall())
        assert len(got) == len(want)
        wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
        assert not wrong, (len(wrong), wrong[:2])
