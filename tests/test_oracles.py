"""Every query with SQL against DuckDB on sf0.001, as a bag of rows with six decimal places."""

import math
import os
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def bag(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag([c[0] for c in cur.description], cur.fetchall())


#: Keys of one row each; queries that give several rows for a key, or none on the smallest tables.
KEYS = {"record_id", "item_id", "sample_id", "req_no", "row_id", "doc_id", "line_id"}
REPEATED = {"str_32_pack_sentences", "str_33_pack_chinese"}
EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    if name == "sel_01_greedy_quota":
        with pytest.raises(ValueError, match="quota"):
            QUERIES[name](spark, SF)
        return
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows or name in EMPTY
    kinds = dict(df.dtypes)
    for key in KEYS & set(df.columns):
        if len(set(df.columns) - {key}) and name not in REPEATED:
            assert len({r[key] for r in rows}) == len(rows), f"{key} repeats"
    for c in (c for c in df.columns if kinds[c] in ("float", "double")):
        assert all(r[c] is None or math.isfinite(r[c]) for r in rows)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
