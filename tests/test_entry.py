import os

import duckdb
import pytest

import __spark_entry__ as entry
from scrivel.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_oracle(spark, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE_SQL:
        con = duckdb.connect()
        for t in os.listdir(SF):
            con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
        want = con.sql(catalogue.ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda f: sorted(map(tuple, f[columns].astype(str).values.tolist()))
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
