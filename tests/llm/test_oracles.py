"""The corpus queries that SQL can express, against DuckDB on the driver tables."""

import glob
import os

import duckdb
import pytest

from lodestone.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_corpus_query(spark, name):
    folder, con = "/root/testdata/sf0.01", duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, folder)
    found = con.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, found.fetchall()))
