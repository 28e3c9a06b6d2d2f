"""Registered queries over the driver's tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinquery.suite import files, kin, rules, tables

QUERIES: dict = {**kin.QUERIES, **tables.QUERIES, **files.QUERIES, **rules.QUERIES}
ORACLES: dict = {**kin.ORACLES, **tables.ORACLES, **files.ORACLES, **rules.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many daughters has the sibling of each person asked about?"""
    return kin.q_count_per_binding(spark, sf_dir)
