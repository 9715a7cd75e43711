"""All registered queries of the library's operators, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellwright.plans import alignment, corpus, differences, encoding, evaluation, findings, layout, localization, mathspans, planning, validation

FLAGSHIP = "systemic_layout_problems"

FAMILIES = (layout, encoding, corpus, planning, alignment, differences, mathspans, findings, localization, evaluation, validation)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for f in FAMILIES for k, v in f.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for f in FAMILIES for k, v in f.ORACLE_SQL.items()}
