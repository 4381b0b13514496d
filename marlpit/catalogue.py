"""Registered queries of the lecture engine and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlpit.plans import evaluation, experiments, library, media, operations, records, search, transcripts

_PLANS = (library, search, transcripts, evaluation, operations, records, media, experiments)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for plan in _PLANS for name, q in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
