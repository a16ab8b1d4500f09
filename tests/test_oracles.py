"""Every query that has SQL gives the same rows in both engines."""

import duckdb
import pytest

from quilter.plans import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def comparable(rows):
    return sorted((tuple(0.0 if isinstance(v, float) and v == 0 else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(REGISTRY.oracles))
def test_same_rows(spark, data, duck, name):
    df = REGISTRY.queries[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(REGISTRY.oracles[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    assert got
    assert comparable(got) == comparable(want)
