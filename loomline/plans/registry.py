"""Every query of the engine's own operators by name, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.plans import aggregates, graphs, joins, scalars, scans
from loomline.plans.base import ORACLES, QUERIES

MODULES = (scans, scalars, joins, aggregates, graphs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
