"""All named queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import extensions
from tessera.functions.scalars import SCALARS
from tessera.operators import graphs, joins, ordered, passages, sketches, vectors, windows
from tessera.operators.relational import RELATIONAL
from tessera.sources import bucketed, connectors, tables
from tessera.streaming import events, stateful


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tables.sql(spark, sf_dir, text)


_TEXTS = {name: q if isinstance(q, tuple) else (q, q) for name, q in (RELATIONAL | SCALARS).items()}
_MODULES = (joins, graphs, ordered, passages, sketches, vectors, windows, extensions, connectors, bucketed, events, stateful)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(q[0]) for name, q in _TEXTS.items()}
SQL: dict[str, str] = {name: q[1] for name, q in _TEXTS.items()}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
