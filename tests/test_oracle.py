"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import __spark_entry__ as entry
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.queries() if n in entry.oracle_sql())
#: The linking queries share their plan; some of them stand for all here, the driver runs every one.
SLOW = {"direct_links", "candidate_scores", "digest_topics"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or x != x else x.isoformat() if hasattr(x, "isoformat") else x
    return sorted((tuple(clean(x) for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SLOW])
def test_query_equals_its_sql(name, spark, sf, duck):
    got = entry.queries()[name](spark, sf).toArrow().to_pandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["word", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
