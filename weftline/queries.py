"""Queries of the library's own operators over the test tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import contract_queries, evaluation_queries, export_queries, history_queries, label_queries, motion_queries, pick_queries, report_queries, sequence_queries, shop_queries, verdict_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = contract_queries.QUERIES | evaluation_queries.QUERIES | export_queries.QUERIES | history_queries.QUERIES | label_queries.QUERIES | motion_queries.QUERIES | pick_queries.QUERIES | report_queries.QUERIES | sequence_queries.QUERIES | shop_queries.QUERIES | verdict_queries.QUERIES
ORACLES: dict[str, str] = contract_queries.ORACLES | evaluation_queries.ORACLES | export_queries.ORACLES | history_queries.ORACLES | label_queries.ORACLES | motion_queries.ORACLES | pick_queries.ORACLES | report_queries.ORACLES | sequence_queries.ORACLES | shop_queries.ORACLES | verdict_queries.ORACLES
