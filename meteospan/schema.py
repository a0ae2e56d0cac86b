"""Column names of the long tables and the checks made at the boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SERIES_COLUMNS = ("ensemble", "realization", "station", "variable")


def series_keys(df: DataFrame) -> list[str]:
    """Columns that identify one time series of a long table."""
    return [c for c in SERIES_COLUMNS if c in df.columns]


def pair_keys(df: DataFrame) -> list[str]:
    """Columns that identify one group of rank pairs."""
    names = ("ensemble", "realization", "station", "var_u", "var_v")
    return [c for c in names if c in df.columns]


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def finite(name: str | Column) -> Column:
    """True where a double is neither null, NaN nor infinite."""
    c = F.col(name) if isinstance(name, str) else name
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nan_to_null(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn(column, F.when(~F.isnan(column), F.col(column)))
