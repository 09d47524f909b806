"""Where query modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its oracle SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values_sql(rows: list[tuple]) -> str:
    """Inline rows as a relation with columns a, b, c, ... for the oracle."""
    names = ", ".join("abcdefgh"[: len(rows[0])])
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") v({names})"


def values(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The same rows as a table."""
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(f"{n} {kinds[type(next((r[i] for r in rows if r[i] is not None), ''))]}" for i, n in enumerate("abcdefgh"[: len(rows[0])]))
    return spark.createDataFrame(rows, schema)
