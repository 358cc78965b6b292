"""Every registered query of the engine against its SQL, over whole tables."""

import duckdb
import pytest

from strataloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def db(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, tiny, db, name):
    got = QUERIES[name](spark, tiny)
    want = db.execute(ORACLES[name])
    heads = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(heads)
    ours = sorted(tuple(plain(r[c]) for c in sorted(heads)) for r in got.collect())
    theirs = sorted(tuple(plain(dict(zip(heads, r))[c]) for c in sorted(heads)) for r in want.fetchall())
    assert ours == theirs


def test_entry_names_and_columns(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
