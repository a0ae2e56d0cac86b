"""Heat-wave definitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meteospan.operators.ensemble import runs
from meteospan.operators.ordering import exact_quantiles, with_halo, with_position
from meteospan.operators.timeops import resample_day_night, rolling_pool, rolling_sum
from meteospan.schema import finite, series_keys


def islands(df: DataFrame, mask: str = "mask", min_length: int = 3, keys: Sequence[str] | None = None) -> DataFrame:
    """Runs of True of at least ``min_length`` days: (keys, wave_id, begin, end, days). A missing
    day ends a run."""
    keys = series_keys(df) if keys is None else list(keys)
    marked = runs(df.withColumn(mask, F.coalesce(F.col(mask), F.lit(False))), mask, keys)
    return (
        marked.filter(mask)
        .groupBy(*keys, F.col("run").alias("wave_id"))
        .agg(F.min("time").alias("begin"), F.max("time").alias("end"), F.count("*").alias("days"))
        .filter(F.col("days") >= min_length)
    )


def wave_mask(df: DataFrame, mask: str = "mask", min_length: int = 3, keys: Sequence[str] | None = None) -> DataFrame:
    """Replace ``mask`` by one that keeps only runs of at least ``min_length`` rows."""
    keys = series_keys(df) if keys is None else list(keys)
    marked = runs(df.withColumn(mask, F.coalesce(F.col(mask), F.lit(False))), mask, keys)
    lengths = marked.filter(mask).groupBy(*keys, "run").agg(F.count("*").alias("_days"))
    kept = lengths.filter(F.col("_days") >= min_length).withColumn(mask, F.lit(True))
    return (
        marked.drop("pos")
        .join(kept, [*keys, mask, "run"], "left")
        .withColumn(mask, F.col("_days").isNotNull())
        .drop("run", "_days")
    )


def heatwaves_hottest_n(
    df: DataFrame, n: int = 3, min_length: int = 3, month_start: int = 5, month_end: int = 9
) -> DataFrame:
    """Days of the n hottest periods of every summer.

    Within the summer months of a year, centred sums of the daily maximum are picked from
    the hottest down; a pick has to be more than ``min_length`` days from the earlier ones.
    """
    keys = series_keys(df)
    year = [*keys, "year"]
    summer = resample_day_night(df).filter(
        F.month("time").between(month_start, month_end)
    ).withColumn("year", F.year("time"))
    # a summer has at most 366 days, which bounds every group below
    tri = rolling_sum(summer.select(*year, "time", "day"), min_length, True, "day", year)
    placed = with_position(tri, year)
    ranked = placed.groupBy(*year).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("day").alias("heat"), "pos", "time")), asc=False
        ).alias("_candidates")
    )
    pick = lambda taken, c: F.when(
        (F.size(taken) < n) & F.forall(taken, lambda t: F.abs(t["pos"] - c["pos"]) > min_length),
        F.concat(taken, F.array(c)),
    ).otherwise(taken)
    none = F.filter(F.col("_candidates"), lambda c: F.lit(False))
    picks = ranked.select(
        *year, F.posexplode(F.aggregate("_candidates", none, pick)).alias("wave_rank", "centre")
    )
    half = min_length // 2
    days = picks.withColumn(
        "_offset", F.explode(F.sequence(F.lit(-half), F.lit(min_length - 1 - half)))
    )
    return days.select(
        *year, "wave_rank", F.date_add(F.to_date("centre.time"), F.col("_offset")).alias("day")
    )


def doy_threshold(
    df: DataFrame, q: float, window: int | None = None, over: str | None = None, column: str = "value"
) -> DataFrame:
    """Quantile per day of year.

    Members are either the centred rolling window around each day of all years, or (with
    ``over="realization"``) all days and realizations without a window.
    """
    keys = [k for k in series_keys(df) if k != over]
    rows = df.select(*series_keys(df), "time", F.col(column).alias("value"))
    if over is None and window:
        rows = rolling_pool(rows, window)
    pooled = rows.filter(finite("value")).withColumn("doy", F.dayofyear("time"))
    return exact_quantiles(pooled, [*keys, "doy"], "value", [q]).select(
        *keys, "doy", F.col("quantile").alias("bound")
    )


def _bounds(reference: DataFrame, column: str, q: float, window: int) -> DataFrame:
    if "realization" in reference.columns:
        return doy_threshold(reference, q, over="realization", column=column)
    return doy_threshold(reference, q, window, column=column)


def _hot(days: DataFrame, bounds: DataFrame, column: str, out: str) -> DataFrame:
    keys = [k for k in ("station", "variable") if k in bounds.columns]
    return (
        days.join(bounds, [*keys, "doy"], "left")
        .withColumn(out, F.coalesce(F.col(column) > F.col("bound"), F.lit(False)))
        .drop("bound")
    )


def heatwaves_zitis(
    df: DataFrame, reference: DataFrame | None = None, q: float = 0.9, window: int = 5,
    min_length: int = 3, months: tuple[int, int] = (5, 9), bounds: DataFrame | None = None,
) -> DataFrame:
    """Runs of days whose maximum exceeds the bound of the day of year."""
    days = resample_day_night(df).withColumn("doy", F.dayofyear("time"))
    if bounds is None:
        known = resample_day_night(df if reference is None else reference)
        bounds = _bounds(known, "day", q, window)
    hot = _hot(days, bounds, "day", "hot").withColumn(
        "mask", F.col("hot") & F.month("time").between(*months)
    )
    return islands(hot, "mask", min_length, series_keys(df))


def bridge(df: DataFrame, mask: str = "mask", keys: Sequence[str] | None = None) -> DataFrame:
    """A single False between two True of the days next to it becomes True (judged on the given mask)."""
    keys = series_keys(df) if keys is None else list(keys)
    rows = with_halo(
        with_position(df, keys), keys, 1, 1,
        {
            "_before": lambda w: F.lag(F.struct("time", F.col(mask).alias("mask"))).over(w),
            "_after": lambda w: F.lead(F.struct("time", F.col(mask).alias("mask"))).over(w),
        },
    )
    day = F.expr("INTERVAL 1 DAY")
    next_to = (F.col("_before.time") + day >= F.col("time")) & (F.col("time") + day >= F.col("_after.time"))
    joined = F.coalesce(F.col("_before.mask") & F.col("_after.mask") & next_to, F.lit(False))
    return rows.withColumn(mask, F.col(mask) | joined).drop("_before", "_after", "pos", "pos_total")


def heatwaves_kuglitsch(
    df: DataFrame, reference: DataFrame | None = None, q: float = 0.95, window: int = 15,
    min_length: int = 3, months: tuple[int, int] = (6, 9),
    bound_day: DataFrame | None = None, bound_night: DataFrame | None = None,
) -> DataFrame:
    """Runs of days with hot day and hot night; one normal day inside does not end a wave."""
    keys = series_keys(df)
    days = resample_day_night(df).withColumn("doy", F.dayofyear("time"))
    if bound_day is None or bound_night is None:
        known = resample_day_night(df if reference is None else reference)
        bound_day = _bounds(known, "day", q, window) if bound_day is None else bound_day
        bound_night = _bounds(known, "night", q, window) if bound_night is None else bound_night
    hot = _hot(_hot(days, bound_day, "day", "hot_day"), bound_night, "night", "hot_night")
    mask = F.col("hot_day") & F.col("hot_night") & F.month("time").between(*months)
    bridged = bridge(hot.select(*keys, "time", mask.alias("mask")), "mask", keys)
    return islands(bridged, "mask", min_length, keys)


def ensemble_member_heatwaves(
    ens: DataFrame, reference: DataFrame, n: int | None = None, definition=heatwaves_kuglitsch,
    drop_variables: Sequence[str] = ("R",), **options,
) -> DataFrame:
    """Waves of every realization against bounds pooled from a reference ensemble, all of it
    unless ``n`` asks for its first realizations."""
    keep = ~F.col("variable").isin(list(drop_variables))
    known = reference.filter(keep)
    if n is not None and "realization" in known.columns:
        known = known.filter(F.col("realization") < n)
    return definition(ens.filter(keep), reference=known, **options)


def heatwaves_by_year(waves: DataFrame, years: DataFrame) -> DataFrame:
    """Waves and wave days per year; years without any are reported with 0.

    ``years`` holds the series keys and ``year``.
    """
    keys = [k for k in series_keys(waves) if k in years.columns]
    counts = waves.groupBy(*keys, F.year("begin").alias("year")).agg(
        F.count("*").alias("waves"), F.sum("days").alias("wave_days")
    )
    return years.select(*keys, "year").distinct().join(counts, [*keys, "year"], "left").fillna(
        0, ["waves", "wave_days"]
    )
