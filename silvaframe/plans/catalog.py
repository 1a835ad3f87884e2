"""The registered queries: name to DataFrame builder, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silvaframe.plans import calls, detect, detector, extra, files, labels, pixels, shapes, site, tiling, verdicts  # noqa: F401  they register their queries
from silvaframe.plans.registry import ORACLES, QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["crowns_by_source"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
