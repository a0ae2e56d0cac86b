"""Resampling, gap filling, calendar windows and harmonics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from meteospan.operators.ordering import calendar_block, carry, join_on, with_halo, with_position
from meteospan.schema import finite, require, series_keys

DAYS_IN_CYCLE = 365


def _keys(df: DataFrame, keys: Sequence[str] | None) -> list[str]:
    return series_keys(df) if keys is None else list(keys)


def seconds(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp")) / 1e6


def resample_mean(df: DataFrame, freq: str = "day", column: str = "value") -> DataFrame:
    """Mean per calendar unit, missing values skipped."""
    return (
        df.groupBy(*series_keys(df), F.date_trunc(freq, "time").alias("time"))
        .agg(F.avg(F.when(finite(column), F.col(column))).alias(column))
    )


def resample_day_night(df: DataFrame) -> DataFrame:
    """Daily maximum (``day``) and minimum (``night``)."""
    value = F.when(finite("value"), F.col("value"))
    return (
        df.groupBy(*series_keys(df), F.date_trunc("day", "time").alias("time"))
        .agg(F.max(value).alias("day"), F.min(value).alias("night"))
    )


def interpolate_time(
    df: DataFrame,
    column: str = "value",
    extrapolate: bool = False,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Linear interpolation in time between finite neighbours.

    With ``extrapolate`` the line through the two nearest finite points is continued at
    the ends of the series.
    """
    keys = _keys(df, keys)
    known = F.when(
        finite(column), F.struct(F.col("time").alias("time"), F.col(column).alias("v"))
    )
    rows = carry(df, keys, "time", {"known": known}, calendar_block())
    a, b = F.col("prev_known"), F.col("next_known")
    share = F.try_divide(
        seconds("time") - seconds(a["time"]), seconds(b["time"]) - seconds(a["time"])
    )
    filled = F.when(finite(column), F.col(column)).otherwise(a["v"] + (b["v"] - a["v"]) * share)
    if not extrapolate:
        return rows.withColumn(column, filled).drop("prev_known", "next_known")

    points = with_position(df.filter(finite(column)), keys)
    end = lambda at: F.max(F.when(at, F.struct("time", F.col(column).alias("v"))))
    from_end = F.col("pos_total") - F.col("pos")
    ends = points.groupBy(*keys).agg(
        end(F.col("pos") == 0).alias("_first"),
        end(F.col("pos") == 1).alias("_second"),
        end(from_end == 2).alias("_last2"),
        end(from_end == 1).alias("_last1"),
    )
    line = lambda p, q: p["v"] + (q["v"] - p["v"]) * F.try_divide(
        seconds("time") - seconds(p["time"]), seconds(q["time"]) - seconds(p["time"])
    )
    rows = join_on(rows, ends, keys, "left")
    outside = F.when(a.isNull(), line(F.col("_first"), F.col("_second"))).when(
        b.isNull(), line(F.col("_last2"), F.col("_last1"))
    )
    return rows.withColumn(column, F.coalesce(filled, outside)).drop(
        "prev_known", "next_known", "_first", "_second", "_last2", "_last1"
    )


def fill_edges(
    df: DataFrame, column: str = "value", keys: Sequence[str] | None = None
) -> DataFrame:
    """Backward fill, then forward fill."""
    keys = _keys(df, keys)
    known = F.when(
        finite(column), F.struct(F.col("time").alias("time"), F.col(column).alias("v"))
    )
    rows = carry(df, keys, "time", {"known": known}, calendar_block())
    return rows.withColumn(
        column, F.coalesce(F.col("next_known")["v"], F.col("prev_known")["v"])
    ).drop("prev_known", "next_known")


def missing_report(df: DataFrame, fail: bool = False) -> DataFrame:
    """Rows, missing rows and the all-missing flag per series; with ``fail`` a series with missing
    values raises when the plan runs."""
    report = df.groupBy(*series_keys(df)).agg(
        F.count("*").alias("n"),
        F.count_if(~finite("value")).alias("missing"),
        (F.count_if(finite("value")) == 0).alias("all_missing"),
    )
    if not fail:
        return report
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in series_keys(df)])
    problem = F.when(F.col("all_missing"), F.concat(F.lit("series without any value: "), name)).when(
        F.col("missing") > 0, F.concat(F.lit("missing values, fill them first: "), name)
    )
    checked = F.when(problem.isNotNull(), F.raise_error(problem).cast("long")).otherwise(F.col("n"))
    return report.withColumn("n", checked)


def missing_series(df: DataFrame) -> DataFrame:
    """The rows of ``missing_report`` whose series has no value at all."""
    return missing_report(df).filter("all_missing")


def clean_ranks(df: DataFrame, column: str = "u", keys: Sequence[str] | None = None) -> DataFrame:
    """Ranks outside (0, 1) are dropped, interpolated, and filled at the ends."""
    inside = (F.col(column) > 0) & (F.col(column) < 1)
    cleaned = df.withColumn(column, F.when(inside, F.col(column)))
    return fill_edges(interpolate_time(cleaned, column, keys=keys), column, keys=keys)


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "DJF")
        .when(month.isin(3, 4, 5), "MAM")
        .when(month.isin(6, 7, 8), "JJA")
        .otherwise("SON")
    )


def calendar_keys(df: DataFrame, position: bool = False) -> DataFrame:
    """Add doy, month, year and season (and the position within the series)."""
    out = df.withColumns(
        {
            "doy": F.dayofyear("time"),
            "month": F.month("time"),
            "year": F.year("time"),
            "season": season(F.month("time")),
        }
    )
    return with_position(out, series_keys(df)) if position else out


def doy_targets(doy: str, w: int) -> Column:
    """Days of year whose window holds an observation made on ``doy``.

    The window of target d is (d − w, d + w]. Towards the other side of the year it also
    takes doy > 365 − w + d (d < w) and doy < d + w − 365 (d + w > 365).
    """
    x = F.col(doy)
    every = F.sequence(F.lit(1), F.lit(DAYS_IN_CYCLE + 1))

    def holds(d):
        plain = (x > d - w) & (x <= d + w)
        early = (d < w) & (x > DAYS_IN_CYCLE - w + d)
        late = (d + w > DAYS_IN_CYCLE) & (x < d + w - DAYS_IN_CYCLE)
        return plain | early | late

    near = F.sequence(F.greatest(x - w, F.lit(1)), F.least(x + w, F.lit(DAYS_IN_CYCLE + 1)))
    at_edge = (x <= 2 * w) | (x >= DAYS_IN_CYCLE - 2 * w)
    return F.filter(F.when(at_edge, every).otherwise(near), holds)


def doy_window(df: DataFrame, w: int = 15) -> DataFrame:
    """Copy every row to the days of year (``doy``) whose window holds it.

    Targets are limited to days of year that occur in the data.
    """
    rows = df.withColumn("_x", F.dayofyear("time"))
    present = F.broadcast(rows.select(F.col("_x").alias("doy")).distinct())  # ≤ 366 rows
    return (
        rows.withColumn("doy", F.explode(doy_targets("_x", w)))
        .join(present, "doy", "left_semi")
        .drop("_x")
    )


def lag_pairs(
    df: DataFrame, k: int = 1, column: str = "value", keys: Sequence[str] | None = None
) -> DataFrame:
    """(u, v): the value now and the value k steps later in the same series."""
    keys = _keys(df, keys)
    ahead = lambda w: F.lead(column, k).over(w)
    rows = with_halo(with_position(df, keys), keys, 0, k, {"v": ahead})
    return (
        rows.withColumn("u", F.col(column))
        .filter((F.col("pos") + k < F.col("pos_total")))
        .select(*keys, "time", "u", "v")
    )


def rolling_sum(
    df: DataFrame,
    n: int = 3,
    center: bool = True,
    column: str = "value",
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Rolling sum over n rows; windows that are incomplete or hold a gap are dropped."""
    keys = _keys(df, keys)
    before, after = (n // 2, n - 1 - n // 2) if center else (n - 1, 0)
    rows = with_halo(
        with_position(df, keys),
        keys,
        before,
        after,
        {
            "rolled": lambda w: F.sum(column).over(w.rowsBetween(-before, after)),
            "_full": lambda w: F.count(column).over(w.rowsBetween(-before, after)),
        },
    )
    return rows.filter(F.col("_full") == n).select(*keys, "time", F.col("rolled").alias(column))


def rolling_pool(
    df: DataFrame, n: int, center: bool = True, column: str = "value",
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """One row per member of the rolling window around each row (``value`` of the member)."""
    keys = _keys(df, keys)
    before, after = (n // 2, n - 1 - n // 2) if center else (n - 1, 0)
    members = lambda w: F.collect_list(column).over(w.rowsBetween(-before, after))
    rows = with_halo(with_position(df, keys), keys, before, after, {"_members": members})
    return rows.select(*keys, "time", F.explode("_members").alias("value"))


def hyd_year(time: str | Column = "time", start_month: int = 10) -> Column:
    """Hydrological year, named after the calendar year in which it ends."""
    return F.year(F.add_months(F.to_date(time), (13 - start_month) % 12))


def hyd_year_sums(
    df: DataFrame, full_years: bool = True, start_month: int = 10, column: str = "value"
) -> DataFrame:
    """Sum per hydrological year; optionally only years with a value on every day."""
    sums = df.groupBy(
        *series_keys(df), hyd_year("time", start_month).alias("hyd_year")
    ).agg(F.sum(column).alias("total"), F.count(column).alias("days"))
    if full_years:
        first = F.make_date(
            F.col("hyd_year") - (1 if start_month > 1 else 0), F.lit(start_month), F.lit(1)
        )
        sums = sums.filter(F.col("days") == F.datediff(F.add_months(first, 12), first))
    return sums


def annual_extremes(sums: DataFrame) -> DataFrame:
    """Min, max, population std and sorted list of the yearly sums of each series."""
    return sums.groupBy(*series_keys(sums)).agg(
        F.min("total").alias("min_total"),
        F.max("total").alias("max_total"),
        F.stddev_pop("total").alias("std_total"),
        F.sort_array(F.collect_list("total")).alias("totals"),  # one entry per year
    )


def period_band(
    spark: SparkSession, length: int, lower: float | None = None, upper: float | None = None
) -> DataFrame:
    """Harmonics k of a series of ``length`` steps with lower ≤ length/k < upper."""
    # the shortest period has k = length // 2; open bounds leave out both ends
    shortest = length / (length // 2)
    lower = shortest + 1 if lower is None else lower
    upper = float(length) if upper is None else upper
    period = F.lit(float(length)) / F.col("k")
    return (
        spark.range(1, length // 2 + 1)
        .withColumnRenamed("id", "k")
        .withColumn("period", period)
        .filter((period >= lower) & (period < upper))
    )


def _wave_sums(df: DataFrame, band: DataFrame, column: str, keys: Sequence[str], group: Column | None = None) -> DataFrame:
    """(keys, [part,] k, length, re, im, c, s): sums over a series (or its parts) of x·cos, −x·sin, cos and sin of every chosen harmonic.

    A task turns its rows into one array of sums for each series and part; rows per harmonic exist only after that. The chosen
    band is a short list by construction and goes to the tasks as such.
    """
    ks = np.array(sorted(r["k"] for r in band.select("k").collect()), np.int64)
    parts = [] if group is None else ["_part"]
    rows = with_position(df, keys)
    rows = rows.select(*keys, *([group.alias("_part")] if parts else []), "pos", "pos_total", F.col(column).cast("double").alias("_x"))
    by = [*keys, *parts, "pos_total"]

    def evaluate(batches):
        sums: dict = {}

        def ship():
            out = pd.DataFrame(list(sums), columns=by)
            out["k"], out["sums"] = [ks] * len(sums), [x.ravel() for x in sums.values()]
            return out

        for frame in batches:
            for key, at in frame.groupby(by, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                pos, x = frame["pos"].to_numpy()[at], np.nan_to_num(frame["_x"].to_numpy(float)[at])
                # the angle of k · pos steps, with whole turns taken off in integers
                turn = 2 * math.pi * ((pos[:, None] * ks[None, :]) % key[-1]) / key[-1]
                c, s = np.cos(turn), np.sin(turn)
                table = np.stack([x @ c, -(x @ s), c.sum(0), s.sum(0)])
                sums[key] = sums[key] + table if key in sums else table
            if len(sums) * max(len(ks), 1) > 1 << 18:
                yield ship()
                sums.clear()
        if sums:
            yield ship()

    fields = [f for f in rows.schema.fields if f.name in by]
    fields = [next(f for f in fields if f.name == c) for c in by]
    schema = T.StructType([*fields, T.StructField("k", T.ArrayType(T.LongType())), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    n = len(ks)
    at = lambda i: F.sum(F.get("sums", F.col("_i") + i * n))
    spread = rows.mapInPandas(evaluate, schema).select(*by, "sums", F.posexplode("k").alias("_i", "k"))
    return spread.groupBy(*keys, *parts, "k", F.col("pos_total").alias("length")).agg(
        at(0).alias("re"), at(1).alias("im"), at(2).alias("c"), at(3).alias("s")
    )


def harmonic_amplitudes(
    df: DataFrame, band: DataFrame, column: str = "value", keys: Sequence[str] | None = None
) -> DataFrame:
    """Fourier coefficients (re, im) of the chosen harmonics of each series."""
    keys = _keys(df, keys)
    return _wave_sums(df, band, column, keys).drop("c", "s")


def harmonic_year_integrals(
    df: DataFrame,
    band: DataFrame,
    start_month: int = 10,
    column: str = "value",
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Contribution of every chosen harmonic to every hydrological year."""
    keys = _keys(df, keys)
    years = _wave_sums(df, band, column, keys, hyd_year("time", start_month)).withColumnRenamed("_part", "hyd_year")
    whole = years.groupBy(*keys, "k").agg(F.sum("re").alias("_re"), F.sum("im").alias("_im"))
    wave = F.lit(2.0) / F.col("length") * (F.col("_re") * F.col("c") - F.col("_im") * F.col("s"))
    return years.join(whole, [*keys, "k"]).select(*keys, "k", "hyd_year", wave.alias("integral"))


def smooth_by_doy(
    table: DataFrame, keys: Sequence[str], columns: Sequence[str], order: int
) -> DataFrame:
    """Keep harmonics 0…order of columns tabulated by ``doy`` (at most 366 rows per key)."""
    keys = list(keys)
    placed = with_position(table, keys, ["doy"], F.lit(0))
    angle = lambda k: F.lit(2 * math.pi) * k * F.col("pos") / F.col("pos_total")
    sums = []
    for c in columns:
        for k in range(order + 1):
            sums.append(F.sum(F.col(c) * F.cos(angle(k))).alias(f"_re_{c}_{k}"))
            sums.append(F.sum(-F.col(c) * F.sin(angle(k))).alias(f"_im_{c}_{k}"))
    spectra = placed.groupBy(*keys).agg(*sums)
    rebuilt = {}
    for c in columns:
        total = F.col(f"_re_{c}_0")
        for k in range(1, order + 1):
            share = F.col(f"_re_{c}_{k}") * F.cos(angle(k)) - F.col(f"_im_{c}_{k}") * F.sin(angle(k))
            # a harmonic at half the number of days has no mirror image
            total = total + F.when(F.col("pos_total") == 2 * k, share).when(
                F.col("pos_total") > 2 * k, 2.0 * share
            ).otherwise(0.0)
        rebuilt[c] = total / F.col("pos_total")
    rest = [c for c in table.columns if c not in columns]
    return join_on(placed.select(*rest, "pos", "pos_total"), spectra, keys).select(
        *rest, *[e.alias(c) for c, e in rebuilt.items()]
    )
