"""The registered queries of the frame, rig and ledger operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import frames, rigs, sources, timeline

_ALL = frames.QUERIES | timeline.QUERIES | rigs.QUERIES | sources.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: fn for k, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
