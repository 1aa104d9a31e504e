"""Queries of the core and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parolumi.operators.schema_drift import Drift
from parolumi.plans import asr, corpus, evaluation, pipeline, sampling, streams
from parolumi.sources import tables as T


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Drift(T.table(spark, sf_dir, "raw_sidecars")).changes()


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sidecars as one table of consistent columns."""
    drift = Drift(T.table(spark, sf_dir, "raw_sidecars"))
    return drift.table(drift.schema(drift.changes()))


_PLANS = (evaluation, corpus, asr, sampling, pipeline, streams)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_table": p2_table}
ORACLES: dict[str, str] = {}
for _plan in _PLANS:
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
