"""Queries of the training-data problems, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import oracles
from corpusloom.llm import p1_cross_split as p1
from corpusloom.llm import p2_near_duplicates as p2
from corpusloom.llm import p3_pairs as p3
from corpusloom.llm import p4_confusables as p4
from corpusloom.llm import p5_ledger as p5
from corpusloom.llm import p6_leaks as p6
from corpusloom.llm import p7_encoding as p7
from corpusloom.llm import p8_packing as p8
from corpusloom.llm import p9_splitting as p9


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1.p1_found,
        "p1_report": p1.p1_report,
        "p2_found": p2.p2_found,
        "p2_groups": p2.p2_groups,
        "p3_found": p3.p3_found,
        "p3_report": p3.p3_report,
        "p4_found": p4.p4_found,
        "p4_forms": p4.p4_forms,
        "p5_found": p5.p5_found,
        "p5_collapsed": p5.p5_collapsed,
        "p6_found": p6.p6_found,
        "p6_clean": p6.p6_clean,
        "p6_clean_spans": p6.p6_clean_spans,
        "p7_ids": p7.p7_ids,
        "p8_containers": p8.p8_containers,
        "p8_fill": p8.p8_fill,
        "p9_pieces": p9.p9_pieces,
    }


def oracle_sql() -> dict[str, str]:
    """The other queries are tested against brute force, round trips and a public implementation in tests/llm."""
    names = ("p1_found", "p1_report", "p2_found", "p4_found", "p5_found", "p5_collapsed", "p6_found", "p6_clean")
    return {n: getattr(oracles, n)() for n in names}
