"""Deterministic scenario transforms of given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meteospan.functions.normal import with_norm_cdf
from meteospan.operators.ordering import with_position
from meteospan.operators.ranks import ecdf_cdf, ecdf_ppf
from meteospan.schema import series_keys


def _shift(m, m_t, trend) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return as_col(m) + as_col(m_t) + as_col(trend) * F.col("pos") / F.col("pos_total")


def apply_scenario(
    df: DataFrame, variable: str, m=0.0, m_t=0.0, trend=0.0, column: str = "value"
) -> DataFrame:
    """Add m + m_t + trend·t/T to the primary variable, t counted from 0."""
    placed = with_position(df, series_keys(df))
    shifted = F.when(
        F.col("variable") == variable, F.col(column) + _shift(m, m_t, trend)
    ).otherwise(F.col(column))
    return placed.withColumn(column, shifted).drop("pos", "pos_total")


def site_increments(df: DataFrame, increments, variable: str | None = None) -> DataFrame:
    """Add one number, or one number per station (table station, increment)."""
    chosen = F.lit(True) if variable is None else F.col("variable") == variable
    if isinstance(increments, DataFrame):
        rows = df.join(increments, "station", "left")
        add = F.coalesce(F.col("increment"), F.lit(0.0))
    else:
        rows, add = df, F.lit(float(increments))
    return rows.withColumn(
        "value", F.when(chosen, F.col("value") + add).otherwise(F.col("value"))
    ).select(*df.columns)


def rank_space_shift(
    df: DataFrame, knots: DataFrame, m=0.0, trend=0.0, column: str = "u",
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """u' = F(F⁻¹(u) + m + trend·t/T) with a given distribution F."""
    placed = with_position(df, series_keys(df))
    raw = ecdf_ppf(placed, knots, column, keys, "_x")
    moved = raw.withColumn("_x", F.col("_x") + _shift(m, 0.0, trend)).drop(column)
    return ecdf_cdf(moved, knots, "_x", keys, column).drop("_x", "pos", "pos_total")


def intensify_masked_days(
    df: DataFrame, mask: DataFrame, diff: float, column: str = "z"
) -> DataFrame:
    """Add ``diff`` in normal space on masked days (table station, time), then u = Φ(z)."""
    days = mask.select("station", F.to_date("time").alias("_day")).distinct()
    rows = df.withColumn("_day", F.to_date("time")).join(
        days.withColumn("_hit", F.lit(True)), ["station", "_day"], "left"
    )
    raised = F.col(column) + F.when(F.col("_hit"), F.lit(float(diff))).otherwise(0.0)
    return (
        with_norm_cdf(rows.withColumn(column, raised), "u", F.col(column)).drop("_day", "_hit")
    )
