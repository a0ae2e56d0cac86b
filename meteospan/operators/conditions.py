"""Penalty scoring of yearly sums (K1–K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meteospan.operators.ordering import exact_quantiles
from meteospan.operators.timeops import hyd_year_sums, period_band
from meteospan.schema import finite, series_keys

COLUMNS = "name string, station string, kind string, lower double, upper double, lower_period double, upper_period double"


def condition(spark, name, station, kind, lower=None, upper=None, lower_period=None, upper_period=None):
    """One row of the conditions table. ``kind`` is bounds, std or mean; std uses ``upper``."""
    if kind == "std" and (upper is None or upper <= 0):
        raise ValueError("a std condition needs upper > 0")
    if kind != "std" and lower is None and upper is None:
        raise ValueError("give lower or upper")
    if kind == "mean" and lower is not None and upper is not None and lower > upper:
        raise ValueError("lower has to be below upper")
    row = (name, station, kind, lower, upper, lower_period, upper_period)
    row = tuple(float(x) if i > 2 and x is not None else x for i, x in enumerate(row))
    return spark.createDataFrame([row], COLUMNS)


def _below(x, bound):
    return F.when(x < bound, F.pow(x - bound, 2)).otherwise(0.0)


def _above(x, bound):
    return F.when(x > bound, F.pow(x - bound, 2)).otherwise(0.0)


def yearly_bounds(sums: DataFrame, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """Squared distance of yearly sums outside the bounds, summed over years."""
    if lower is None and upper is None:
        raise ValueError("give lower or upper")
    penalty = F.lit(0.0)
    if lower is not None:
        penalty = penalty + _below(F.col("total"), F.lit(float(lower)))
    if upper is not None:
        penalty = penalty + _above(F.col("total"), F.lit(float(upper)))
    return sums.groupBy(*series_keys(sums)).agg(F.sum(penalty).alias("penalty"))


def yearly_std(sums: DataFrame, std_max: float) -> DataFrame:
    """Squared excess of the population std of yearly sums."""
    if std_max is None or std_max <= 0:
        raise ValueError("std_max has to be positive")
    spread = sums.groupBy(*series_keys(sums)).agg(F.stddev_pop("total").alias("_s"))
    return spread.withColumn("penalty", _above(F.col("_s"), F.lit(float(std_max)))).drop("_s")


def yearly_mean(sums: DataFrame, mean_lower: float | None = None, mean_upper: float | None = None) -> DataFrame:
    """Squared distance of the mean yearly sum from the interval."""
    if mean_lower is None and mean_upper is None:
        raise ValueError("give mean_lower or mean_upper")
    if mean_lower is not None and mean_upper is not None and mean_lower > mean_upper:
        raise ValueError("mean_lower has to be below mean_upper")
    penalty = F.lit(0.0)
    if mean_lower is not None:
        penalty = penalty + _below(F.col("_m"), F.lit(float(mean_lower)))
    if mean_upper is not None:
        penalty = penalty + _above(F.col("_m"), F.lit(float(mean_upper)))
    means = sums.groupBy(*series_keys(sums)).agg(F.avg("total").alias("_m"))
    return means.withColumn("penalty", penalty).drop("_m")


def score_conditions(
    df: DataFrame, conditions: DataFrame, variable: str = "R",
    full_years: bool = True, start_month: int = 10,
) -> DataFrame:
    """Penalty per condition and its share of the total.

    All conditions are scored in one pass over the yearly sums of their station.
    """
    by = [k for k in ("ensemble", "realization") if k in df.columns]
    sums = hyd_year_sums(df.filter(F.col("variable") == variable), full_years, start_month)
    # conditions are written by hand, a few per station
    rows = sums.join(conditions, "station")
    group = [*by, "name", "station", "kind", "lower", "upper"]
    scored = rows.groupBy(*group).agg(
        F.sum(
            F.coalesce(_below(F.col("total"), F.col("lower")), F.lit(0.0))
            + F.coalesce(_above(F.col("total"), F.col("upper")), F.lit(0.0))
        ).alias("_bounds"),
        F.stddev_pop("total").alias("_std"),
        F.avg("total").alias("_mean"),
    )
    outside_mean = F.coalesce(_below(F.col("_mean"), F.col("lower")), F.lit(0.0)) + F.coalesce(
        _above(F.col("_mean"), F.col("upper")), F.lit(0.0)
    )
    penalty = (
        F.when(F.col("kind") == "bounds", F.col("_bounds"))
        .when(F.col("kind") == "std", _above(F.col("_std"), F.col("upper")))
        .otherwise(outside_mean)
    )
    single = scored.withColumn("penalty", penalty).select(*by, "name", "station", "kind", "penalty")
    if by:
        totals = single.groupBy(*by).agg(F.sum("penalty").alias("total_penalty"))
        out = single.join(totals, by)
    else:
        out = single.withColumn("total_penalty", single.select(F.sum("penalty")).scalar())
    share = F.coalesce(F.try_divide(100 * F.col("penalty"), F.col("total_penalty")), F.lit(0.0))
    return out.withColumn("share_percent", share)


def union_conditions(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def accept_realizations(
    ens: DataFrame, conditions: DataFrame, tol: float = 0.0, variable: str = "R", **options
) -> DataFrame:
    """Keep the realizations that every condition could score and whose total penalty is at most
    ``tol``. One without a complete year, or of other stations, cannot be scored and is not kept;
    ``unscored_realizations`` names it."""
    by = [k for k in ("ensemble", "realization") if k in ens.columns]
    return ens.join(_scored(ens, conditions, variable, **options).filter(F.col("_total") <= tol), by, "left_semi")


def unscored_realizations(ens: DataFrame, conditions: DataFrame, variable: str = "R", **options) -> DataFrame:
    """Realizations that some condition could not score."""
    by = [k for k in ("ensemble", "realization") if k in ens.columns]
    return ens.select(*by).distinct().join(_scored(ens, conditions, variable, **options), by, "left_anti")


def _scored(ens: DataFrame, conditions: DataFrame, variable: str, **options) -> DataFrame:
    """Total penalty of the realizations with a finite penalty for every condition."""
    by = [k for k in ("ensemble", "realization") if k in ens.columns]
    wanted = conditions.select("name", "station", "kind").distinct().agg(F.count("*")).scalar()
    known = score_conditions(ens, conditions, variable, **options).filter(finite("penalty"))
    scored = known.groupBy(*by).agg(
        F.sum("penalty").alias("_total"), F.count_distinct("name", "station", "kind").alias("_scored")
    )
    return scored.withColumn("_wanted", wanted).filter("_scored = _wanted").drop("_scored", "_wanted")


def band_union(conditions: DataFrame, length: int) -> DataFrame:
    """Harmonics of a series of ``length`` steps selected by any condition."""
    harmonics = period_band(conditions.sparkSession, length, 0.0, float("inf"))
    ranges = conditions.filter(F.col("lower_period").isNotNull() | F.col("upper_period").isNotNull()).select(
        F.coalesce("lower_period", F.lit(0.0)).alias("lo"),
        F.coalesce("upper_period", F.lit(float("inf"))).alias("hi"),
    )
    bands = ranges.agg(F.collect_set(F.struct("lo", "hi"))).scalar()
    chosen = F.exists("_bands", lambda b: (F.col("period") >= b["lo"]) & (F.col("period") < b["hi"]))
    return harmonics.withColumn("_bands", bands).filter(chosen).drop("_bands")


def default_bounds_from_obs(sums: DataFrame, k: float = 1.1, q: tuple[float, float] = (0.35, 0.65)) -> DataFrame:
    """std_max = k·std of the yearly sums, mean interval from two of their quantiles."""
    keys = series_keys(sums)
    spread = sums.groupBy(*keys).agg((k * F.stddev_pop("total")).alias("std_max"))
    levels = exact_quantiles(sums, keys, "total", list(q)).groupBy(*keys).agg(
        F.max(F.when(F.col("level_id") == 0, F.col("quantile"))).alias("mean_lower"),
        F.max(F.when(F.col("level_id") == 1, F.col("quantile"))).alias("mean_upper"),
    )
    return spread.join(levels, keys)
