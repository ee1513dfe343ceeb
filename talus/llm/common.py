"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.lineage import cut

__all__ = ["ID_RULE", "cut", "hidden", "register", "remainder", "table"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Puts a query, and the SQL that returns the same rows, into the registry of this package."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A null id counts as the empty string.
ID_RULE = "crc32(coalesce(cast({0} AS string), ''))"


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo: the fixed split into training and held-out rows."""
    return F.expr(f"{ID_RULE.format(f'`{column}`')} % {modulus}")


def hidden(*names: str) -> list[str]:
    """Column names that no input table has."""
    tag = uuid.uuid4().hex[:12]
    return [f"__{n}_{tag}" for n in names]
