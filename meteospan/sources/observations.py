"""Observation tables in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from meteospan.operators.reshape import to_long, to_wide
from meteospan.operators.timeops import resample_mean
from meteospan.schema import nan_to_null, require, series_keys

CSV_SCHEMA = "station string, variable string, time timestamp, value double"


def read_observations(
    spark: SparkSession, path: str, fmt: str = "parquet", variables: Sequence[str] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Long or wide station tables as (station, variable, time, value); NaN becomes null.

    A wide table (one column per variable) needs ``variables``.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).schema(schema or CSV_SCHEMA)
    elif schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if "variable" not in df.columns:
        if not variables:
            raise ValueError("a wide table needs the list of variables")
        df = to_long(require(df, "station", "time", *variables), ["station", "time"], variables)
    elif variables:
        df = df.filter(F.col("variable").isin(list(variables)))
    long = require(df, "station", "variable", "time", "value").select(
        "station", "variable", F.col("time").cast("timestamp").alias("time"),
        F.col("value").cast("double").alias("value"),
    )
    return nan_to_null(long)


def station_tables(
    df: DataFrame, variables: Sequence[str], hourly_variables: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Wide tables to be written; with hourly variables the others become daily means."""
    fine = list(hourly_variables or [])
    if not fine:
        return {"": to_wide(df, variables)}
    rest = [v for v in variables if v not in fine]
    hourly = df.filter(F.col("variable").isin(fine))
    daily = resample_mean(df.filter(F.col("variable").isin(rest)), "day")
    return {"_daily": to_wide(daily, rest), "_hourly": to_wide(hourly, fine)}


def write_station_csv(
    df: DataFrame, path: str, variables: Sequence[str],
    hourly_variables: Sequence[str] | None = None, prefix: str = "", digits: int = 3,
) -> None:
    """One CSV folder per station, numbers rounded; time is sorted inside each file."""
    for suffix, wide in station_tables(df, variables, hourly_variables).items():
        names = [c for c in wide.columns if c in variables]
        rounded = wide.withColumns({c: F.round(c, digits) for c in names})
        (
            # the year in the key keeps one station from being one task
            rounded.withColumn("_year", F.year("time"))
            .repartition("station", "_year")
            .sortWithinPartitions("station", "time")
            .drop("_year")
            .write.mode("overwrite").partitionBy("station").option("header", True)
            .csv(f"{path}/{prefix}stations{suffix}")
        )
