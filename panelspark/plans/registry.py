"""Queries by name, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.star import Star, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Doubles to so many digits (None: as they are), without negative zeros; small integers as BIGINT."""
    def fit(n: str, kind: str):
        if kind in ("double", "float") and digits is not None:
            return (F.round(F.col(n).cast("double"), digits) + F.lit(0.0)).alias(n)
        return F.col(n).cast("bigint").alias(n) if kind == "int" else F.col(n)

    return df.select(*(fit(n, k) for n, k in df.dtypes))


def query(name: str, tables: str = "", sql: str | None = None, doubles: str = "", digits: int | None = 6):
    """Registers f(star) -> DataFrame under name; sql runs over the named tables, its columns `doubles` are rounded alike."""

    def add(f: Callable[[Star], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Star(spark, sf_dir)), digits)
        if sql is not None:
            whole = with_tables(sql, *tables.split()) if tables else sql.strip()
            fix = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split() if digits is not None)
            ORACLES[name] = f"SELECT * REPLACE ({fix}) FROM ({whole}) AS q" if fix else whole
        return f

    return add


def oracle(name: str, tables: str, sql: str, doubles: str = "", digits: int | None = 6) -> None:
    """Adds SQL to a query that is registered already."""
    whole = with_tables(sql, *tables.split()) if tables else sql.strip()
    fix = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split() if digits is not None)
    ORACLES[name] = f"SELECT * REPLACE ({fix}) FROM ({whole}) AS q" if fix else whole
