import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["i", "j", "jaccard", "flag", "n_i", "n_j"]
    assert set(own.SQL) <= set(own.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(own.SQL[name])
    columns = [d[0] for d in want.description]
    shown = lambda v: None if v is None else round(float(v), 6) if isinstance(v, float) else str(v)
    rows = lambda found, names: sorted((str([shown(r[names.index(c)]) for c in sorted(names)]) for r in found))
    got = own.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL) - {"cluster_grid"}))
def test_query_runs(spark, name):
    assert own.QUERIES[name](spark, SF).count() > 0
