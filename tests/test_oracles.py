"""Every registered query of the history analytics against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tidemark import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.toArrow().to_pylist()
    found = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert [KINDS.get(t, "") or str(dict((c[0], c[1]) for c in found.description)[c]) for c, t in df.dtypes] == [str(dict((c[0], c[1]) for c in found.description)[c]) for c in df.columns]
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs_and_repeats(spark, name):
    a, b = (sorted(map(repr, registry.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b
