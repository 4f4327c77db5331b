"""Every query that has SQL gives what DuckDB gives for it on the same tables."""

import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from inkwell.plans import queries as plans

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, sf_dir=SF):
    """The columns and rows of both are the same, in any order."""
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    got = query(spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    a, b = rows_of(got.columns, got.collect()), rows_of(names, want.fetchall())
    assert a == b, (sum(a.values()), sum(b.values()), list((a - b).items())[:2], list((b - a).items())[:2])


@pytest.mark.skipif(not Path(SF).is_dir(), reason="the tables are not there")
@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, plans.QUERIES[name], plans.ORACLES[name])
