"""Queries beside their SQL, and literal relations that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioframe.runtime import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


class Literal:
    """A small relation given as rows: a DataFrame for Spark, a common table expression for SQL."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        kinds = {"int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "long": "BIGINT", "boolean": "BOOLEAN"}
        cols = [c.split() for c in self.schema.split(",")]

        def lit(v, kind: str) -> str:
            if v is None:
                return f"NULL::{kinds[kind]}"
            if kind == "string":
                return "'" + str(v).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
            return f"{v}::{kinds[kind]}"

        rows = ", ".join("(" + ", ".join(lit(v, k) for v, (_, k) in zip(r, cols)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(c for c, _ in cols)}) AS (VALUES {rows})"
