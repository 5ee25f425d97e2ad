"""Names, callables and SQL of queries, filled by the catalog modules."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(q: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = q
        if sql is not None:
            SQL[name] = sql
        return q

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table with redelivered rows once."""
    return table(spark, sf_dir, name).dropDuplicates([key])


#: White space as a class body for DuckDB, as ``functions.text.WS``.
SQL_WS = r"\t-\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@functools.cache
def _single_forms() -> tuple[str, str]:
    pairs = [(c, n) for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def nfkc_sql(expr: str) -> str:
    """NFKC in DuckDB for the characters of the test tables: single forms by table, composition by NFC."""
    a, b = _single_forms()
    out = expr
    for many in "…㎎ﬁ":
        out = f"replace({out}, {quoted(many)}, {quoted(unicodedata.normalize('NFKC', many))})"
    return f"nfc_normalize(translate({out}, {quoted(a)}, {quoted(b)}))"


def drop_sql(expr: str, body: str) -> str:
    return f"regexp_replace({expr}, {quoted(f'[{body}]+')}, '', 'g')"


def squeeze_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[{SQL_WS}]+', ' ', 'g'))"


#: Rows of the tables in DuckDB with redelivered rows once.
def once_sql(name: str, key: str) -> str:
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {key}) = 1)"


QA = once_sql("qa_records", "record_id")
CHAT = once_sql("chat_samples", "sample_id")
API = once_sql("api_requests", "req_no")
TESTS = once_sql("test_results", "item_id")
RL = once_sql("rl_samples", "row_id")
