"""Named queries over the given tables, each next to the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = lambda spark, sf: plain(fn(spark, sf))
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return register


def plain(df: DataFrame) -> DataFrame:
    """Widen integers to BIGINT and floats to DOUBLE so that both engines report one schema."""
    def widen(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return F.col(f.name).cast("bigint").alias(f.name)
        if isinstance(f.dataType, T.FloatType):
            return F.col(f.name).cast("double").alias(f.name)
        return F.col(f.name)

    return df.select(*[widen(f) for f in df.schema.fields])


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, digits) + F.lit(0.0)).alias(name or c)


def load() -> Catalog:
    from swathline.catalog import base  # noqa: F401
    import importlib

    for module in base.MODULES:
        importlib.import_module(f"swathline.catalog.{module}")
    return base.CATALOG
