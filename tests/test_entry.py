import duckdb
import pytest

import __spark_entry__ as entry
from tarn.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    import os

    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_equals_sql(spark, sf_dir, con, name):
    df = queries.Q[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = con.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert plain(df.select(*cols).collect()) == plain([tuple(r[names.index(c)] for c in cols) for r in got.fetchall()])


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
