"""Selection, reshaping and table algebra on long tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from meteospan.operators.ordering import join_on, with_position
from meteospan.schema import finite, require, series_keys


def to_long(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Variables from columns to rows."""
    return df.unpivot(list(keys), list(variables), "variable", "value")


def to_wide(df: DataFrame, variables: Sequence[str], value: str = "value") -> DataFrame:
    """Variables from rows to columns; the list is explicit, so no extra job is run."""
    rest = [c for c in df.columns if c not in ("variable", value)]
    return df.groupBy(*rest).agg(
        *[F.first(F.when(F.col("variable") == v, F.col(value)), ignorenulls=True).alias(v) for v in variables]
    )


def attach_stations(
    obs: DataFrame, stations: DataFrame, require_finite: bool = True
) -> DataFrame:
    """Join coordinates; a station without finite coordinates is an error.

    The check is part of the plan: the offending row raises when it is read.
    """
    joined = obs.join(stations.select("station", "longitude", "latitude"), "station", "left")
    if not require_finite:
        return joined
    known = finite("longitude") & finite("latitude")
    message = F.concat(F.lit("no finite coordinates for station "), F.col("station"))
    return joined.withColumn(
        "longitude",
        F.when(known, F.col("longitude")).otherwise(F.raise_error(message).cast("double")),
    )


def filter_stations(
    stations: DataFrame,
    lon_min: float = -180.0,
    lat_min: float = -90.0,
    lon_max: float = 180.0,
    lat_max: float = 90.0,
    start=None,
    end=None,
) -> DataFrame:
    """Stations inside a box whose record (``start``, ``end`` columns) covers the period."""
    inside = F.col("longitude").between(lon_min, lon_max) & F.col("latitude").between(
        lat_min, lat_max
    )
    out = stations.filter(inside)
    if start is not None:
        out = out.filter(F.col("start") <= F.lit(start))
    if end is not None:
        out = out.filter(F.col("end") >= F.lit(end))
    return out


def keep_stations(obs: DataFrame, stations: DataFrame) -> DataFrame:
    return obs.join(stations.select("station"), "station", "left_semi")


def select(
    obs: DataFrame,
    stations: Sequence[str] | None = None,
    variables: Sequence[str] | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Label selection; both ends of the time range are included."""
    if stations is not None:
        obs = obs.filter(F.col("station").isin(list(stations)))
    if variables is not None:
        obs = obs.filter(F.col("variable").isin(list(variables)))
    if start is not None:
        obs = obs.filter(F.col("time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        obs = obs.filter(F.col("time") <= F.lit(end).cast("timestamp"))
    return obs


def short_station_names(df: DataFrame) -> DataFrame:
    """Text before the first comma, else before the first dash."""
    separator = F.when(F.instr("station", ",") > 0, ",").otherwise("-")
    return df.withColumn("station_short", F.split_part("station", separator, F.lit(1)))


def pad_first_day(obs: DataFrame) -> DataFrame:
    """Complete the first day of a data set that starts at hour h > 0.

    Steps [24 − h, 24) of the hourly axis are copied one day back.
    """
    axis = obs.select("time").distinct()
    start_hour = axis.select(F.hour(F.min("time"))).scalar()
    # only the first two calendar days can hold the first 24 steps of an hourly axis
    first_day = axis.select(F.date_trunc("day", F.min("time"))).scalar()
    early = axis.filter(F.col("time") < first_day + F.expr("INTERVAL 2 DAYS"))
    steps = with_position(early, []).filter((F.col("pos") >= 24 - start_hour) & (F.col("pos") < 24))
    pad = obs.join(steps.select("time"), "time", "left_semi").withColumn(
        "time", F.col("time") - F.expr("INTERVAL 1 DAY")
    )
    return obs.unionByName(pad)


def overlay(daily: DataFrame, hourly: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Outer alignment; the second table replaces the values of ``variables``.

    Every station and variable gets the union of the time axes; what neither table has is null.
    """
    keys = [*series_keys(daily), "time"]
    second = hourly.filter(F.col("variable").isin(list(variables))).select(
        *keys, F.col("value").alias("_new")
    )
    # the axis of a station and variable: all times of either table at that station
    series = daily.select(*keys[:-1]).unionByName(second.select(*keys[:-1])).distinct()
    site = [k for k in keys[:-1] if k != "variable"]
    times = daily.select(*site, "time").unionByName(hourly.select(*site, "time")).distinct()
    axis = join_on(series, times, site)
    both = axis.join(daily, keys, "left").join(second, keys, "left")
    value = F.when(
        F.col("variable").isin(list(variables)), F.coalesce("_new", "value")
    ).otherwise(F.col("value"))
    return both.select(*keys, value.alias("value"))


def merge_external(df: DataFrame, ext: DataFrame) -> DataFrame:
    """Add the variables of another table."""
    return df.unionByName(ext.select(*df.columns))


def convert(
    df: DataFrame,
    fns: Sequence[Callable[[DataFrame], DataFrame]],
    renames: dict[str, str] | None = None,
) -> DataFrame:
    """Apply user conversions one after another, then rename variables."""
    for fn in fns:
        df = df.transform(fn)
    for old, new in (renames or {}).items():
        df = df.withColumn(
            "variable", F.when(F.col("variable") == old, new).otherwise(F.col("variable"))
        )
    return df
