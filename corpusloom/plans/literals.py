"""Literal rows for subjects that no table holds, as a frame and as SQL."""

import datetime

from pyspark.sql import DataFrame, SparkSession

SQL = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<long>": "BIGINT[]", "date": "DATE", "timestamp": "TIMESTAMP"}


def frame(spark: SparkSession, types: dict[str, str], rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{name} {kind}" for name, kind in types.items()))


def _literal(x, kind: str) -> str:
    if x is None:
        return f"CAST(NULL AS {SQL[kind]})"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (datetime.date, datetime.datetime)):
        return f"CAST('{x}' AS {SQL[kind]})"
    if isinstance(x, (list, tuple)):
        return f"CAST([{', '.join(_literal(y, kind[6:-1]) for y in x)}] AS {SQL[kind]})"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return f"CAST({x} AS {SQL[kind]})"


def values(name: str, types: dict[str, str], rows: list[tuple]) -> str:
    """A common table expression of the same rows."""
    body = ", ".join("(" + ", ".join(_literal(x, kind) for x, kind in zip(row, types.values(), strict=True)) + ")" for row in rows)
    return f"{name}({', '.join(types)}) AS (VALUES {body})"
