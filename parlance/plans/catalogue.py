"""All registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.plans import audio, live, profiles, scores, states, store, tables, texts, timeline, vectors

MODULES = (timeline, scores, tables, vectors, texts, states, live, profiles, audio, store)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
