"""Queries of the general training-data operators in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcat.operators.units import common_units
from loomcat.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements not recorded as one plain number of their common unit, converted."""
    return common_units(*(table(spark, sf_dir, t) for t in ("attributes", "items", "units", "label_classes")))


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}
