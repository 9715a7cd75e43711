"""Registered queries against their oracles on the small tables, where these are there."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from cellwright.plans import registry

SMALL = "/root/testdata/sf0.001"
#: One query of each family; the driver compares all of them.
CHOSEN = ("systemic_layout_problems", "f6_encode_uncontracted", "m5_replay_check", "j3_pair_between_anchors", "j16_split_to_pages", "a17_block_status", "j24_deletion_anchor", "j28_match_candidates")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_oracle(spark, name):
    base = duckdb.connect()
    for table in ("documents",):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = registry.QUERIES[name](spark, SMALL)
    result = base.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(result.columns) == columns
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    places = [result.columns.index(c) for c in columns]
    theirs = sorted(repr(tuple(plain(r[i]) for i in places)) for r in result.fetchall())
    assert ours == theirs


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "issue_type", "pages", "total"]
