"""The queries of the training-data problems and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import capping, history, leakage, neardup, packing, pii, sqltext, topn, truncation

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {"p1_found": neardup.found, "p1_groups": neardup.classes, "p2_found": topn.found, "p3_found": truncation.found, "p3_sources": truncation.by_source, "p4_found": history.found, "p5_found": capping.found, "p6_packed": packing.packed, "p6_utilisation": packing.utilisation, "p7_found": leakage.found, "p7_coverage": leakage.coverage, "p8_found": pii.found, "p8_redacted": pii.redacted}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": sqltext.P1_FOUND, "p1_groups": sqltext.P1_GROUPS, "p2_found": topn.SQL, "p4_found": sqltext.P4_FOUND, "p5_found": capping.SQL}
