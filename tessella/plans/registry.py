"""All queries of the phrase-pair operators, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chart_plans, count_plans, numeric_plans, score_plans, text_plans

FLAGSHIP = "f1_f2_relative_frequencies"
MODULES = (text_plans, count_plans, score_plans, chart_plans, numeric_plans)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
