"""The library's own queries, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairlead.plans import queries as q
from fairlead.plans import sql


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked risk of the fleet, both models included."""
    return q.ranked_risk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in q.ALL}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
