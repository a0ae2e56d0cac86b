"""Evaluation of ensembles against observations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from meteospan.operators.ordering import (
    exact_quantiles,
    regular_quantiles,
    running_sums,
    calendar_block,
    value_block,
    with_halo,
    with_position,
)
from meteospan.operators.pairs import nan_corr
from meteospan.operators.ranks import plotting_positions
from meteospan.operators.timeops import hyd_year_sums, resample_mean
from meteospan.schema import finite, require, series_keys

SITE = ["station", "variable"]


def compare_means(obs: DataFrame, ens: DataFrame, n_eval: int | None = None, by: str = "station") -> DataFrame:
    """Observed and simulated means, difference and difference in percent, rounded to 3.

    ``by="station"`` gives one row per station and variable, ``by="all"`` averages the
    station means, ``by="both"`` returns the two in one pass (station null = all). All
    realizations count unless ``n_eval`` asks for the first ones.
    """
    chosen = ens if n_eval is None else ens.filter(F.col("realization") < n_eval)
    mean = lambda df, name: df.filter(finite("value")).groupBy(*SITE).agg(F.avg("value").alias(name))
    means = mean(obs, "obs").join(mean(chosen, "sim"), SITE)
    if by == "all":
        means = means.groupBy("variable").agg(F.avg("obs").alias("obs"), F.avg("sim").alias("sim"))
    elif by == "both":
        means = means.groupingSets(
            [[F.col("station"), F.col("variable")], [F.col("variable")]],
            "station", "variable",
        ).agg(F.avg("obs").alias("obs"), F.avg("sim").alias("sim"))
    diff = F.col("sim") - F.col("obs")
    out = means.withColumns({"diff": diff, "diff_percent": F.try_divide(100 * diff, F.col("obs"))})
    return out.withColumns({c: F.round(c, 3) for c in ("obs", "sim", "diff", "diff_percent")})


STATISTICS = {
    "mean": F.avg, "std": F.stddev_pop, "skewness": F.skewness, "kurtosis": F.kurtosis,
    "min": F.min, "max": F.max,
}


def ensemble_stats(
    df: DataFrame, fn: str | Callable = "mean", transformed: bool = False,
    by_realization: bool = True,
) -> DataFrame:
    """One statistic per series. ``fn`` is a name, or a function Column → Column; a pandas
    grouped-aggregate UDF is such a function too."""
    column = "z" if transformed else "value"
    keys = [k for k in series_keys(df) if by_realization or k != "realization"]
    make = STATISTICS[fn] if isinstance(fn, str) else fn
    return df.filter(finite(column)).groupBy(*keys).agg(make(F.col(column)).alias("statistic"))


def meteogram_bands(ens: DataFrame, freq: str | None = None) -> DataFrame:
    """Min, 10 %, 90 % and max over realizations at every time step.

    A group holds one value per realization, so the exact percentile stays small.
    """
    rows = ens if freq is None else resample_mean(ens, freq)
    band = F.percentile("value", F.array(F.lit(0.1), F.lit(0.9)))
    return (
        rows.filter(finite("value"))
        .groupBy(*SITE, "time")
        .agg(F.min("value").alias("low"), band.alias("_b"), F.max("value").alias("high"))
        .select(*SITE, "time", "low", F.col("_b")[0].alias("q10"), F.col("_b")[1].alias("q90"), "high")
    )


def value_histogram(ens: DataFrame, bins: int = 40) -> DataFrame:
    """Density histogram over all realizations and times of a series."""
    rows = ens.filter(finite("value"))
    limits = rows.groupBy(*SITE).agg(
        F.min("value").alias("_a"), F.max("value").alias("_b"), F.count("*").alias("_n")
    )
    width = F.col("_b") - F.col("_a")
    place = F.least(
        F.floor(F.coalesce(F.try_divide((F.col("value") - F.col("_a")) * bins, width), F.lit(0.0))),
        F.lit(bins - 1),
    )
    return (
        rows.join(limits, SITE)
        .groupBy(*SITE, place.alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.max(F.col("_a")).alias("_a"), F.max(width).alias("_w"), F.max("_n").alias("_n"),
        )
        .select(
            *SITE, "bin", "n",
            (F.col("_a") + F.col("bin") * F.col("_w") / bins).alias("left_edge"),
            F.try_divide(F.col("n") * bins, F.col("_n") * F.col("_w")).alias("density"),
        )
    )


def _bands(levels: DataFrame, group: Sequence[str], lower_q: float, upper_q: float) -> DataFrame:
    """Median, two quantiles, min and max over realizations (one value each)."""
    wanted = F.array(F.lit(lower_q), F.lit(0.5), F.lit(upper_q))
    return (
        levels.groupBy(*group)
        .agg(
            F.percentile("quantile", wanted).alias("_p"),
            F.min("quantile").alias("sim_min"),
            F.max("quantile").alias("sim_max"),
        )
        .select(
            *group, F.col("_p")[1].alias("sim_median"), F.col("_p")[0].alias("sim_lower"),
            F.col("_p")[2].alias("sim_upper"), "sim_min", "sim_max",
        )
    )


def _even(count: int) -> dict:
    return {"start": F.lit(0.0), "step": F.lit(1.0 / (count - 1)), "count": F.lit(count)}


def qq_bands(
    obs: DataFrame, ens: DataFrame, lower_q: float = 0.01, upper_q: float = 0.99, n: int = 200
) -> DataFrame:
    """Quantiles over time at n levels: observed, and their spread over realizations."""
    sim = regular_quantiles(ens, ["realization", *SITE], "value", **_even(n))
    observed = regular_quantiles(obs, SITE, "value", **_even(n)).withColumnRenamed("quantile", "obs")
    bands = _bands(sim, [*SITE, "level_id"], lower_q, upper_q)
    extreme = lambda df, a, b: df.filter(finite("value")).groupBy(*SITE).agg(
        F.min("value").alias(a), F.max("value").alias(b)
    )
    limits = extreme(obs, "_o0", "_o1").join(extreme(ens, "_s0", "_s1"), SITE).select(
        *SITE, F.least("_o0", "_s0").alias("global_min"), F.greatest("_o1", "_s1").alias("global_max")
    )
    return observed.join(bands, [*SITE, "level_id"]).join(limits, SITE)


def exceedance_depth(
    obs: DataFrame, ens: DataFrame, threshold: float, variable: str = "R", length: int | None = None
) -> DataFrame:
    """Quantiles of wet values at (i + 0.5)/n, n = half the number of simulated steps, with
    the exceedance level 1 − level reversed once."""
    wet = lambda df: df.filter((F.col("variable") == variable) & (F.col("value") > threshold))
    steps = (
        F.lit(length)
        if length is not None
        else ens.filter(F.col("variable") == variable).select(F.countDistinct("time")).scalar()
    )
    count = F.ceil(steps / 2)
    half = steps / 2
    grid = {"start": 0.5 / half, "step": 1.0 / half, "count": count}
    # for an odd number of steps the last level passes 1 and has no quantile
    inside = F.col("level") <= 1.0
    sim = regular_quantiles(wet(ens), ["realization", *SITE], "value", **grid).filter(inside)
    observed = regular_quantiles(wet(obs), SITE, "value", **grid).filter(inside)
    observed = observed.withColumnRenamed("quantile", "obs")
    bands = _bands(sim, [*SITE, "level_id"], 0.5, 0.5).drop("sim_lower", "sim_upper")
    out = observed.join(bands, [*SITE, "level_id"])
    return out.withColumn("exceedance", 1.0 - F.col("level"))


def runs(df: DataFrame, flag: str, keys: Sequence[str] | None = None, step: str = "1 day") -> DataFrame:
    """Number every run of equal ``flag`` values along time: adds pos and run.

    A run ends where the flag changes or the next row is more than ``step`` later.
    """
    keys = series_keys(df) if keys is None else list(keys)
    before = {"_before": lambda w: F.lag(F.struct("time", F.col(flag).alias("flag"))).over(w)}
    rows = with_halo(with_position(df, keys), keys, 1, 0, before)
    near = F.col("_before.time") + F.expr(f"INTERVAL {step}") >= F.col("time")
    start = ~F.coalesce(near & (F.col("_before.flag") == F.col(flag)), F.lit(False))
    rows = rows.withColumn("_start", start.cast("long")).drop("_before", "pos_total")
    numbered = running_sums(rows, keys, ["time"], {"run": F.col("_start")}, calendar_block())
    return numbered.withColumn("run", F.col("run") + F.col("_start") - 1).drop("_start")


def spell_lengths(df: DataFrame, threshold: float, variable: str | None = None) -> DataFrame:
    """Length of every dry and wet run of days; wet is value > threshold. A missing day ends a run."""
    rows = df.filter(finite("value"))
    if variable is not None:
        rows = rows.filter(F.col("variable") == variable)
    keys = series_keys(df)
    numbered = runs(rows.withColumn("wet", F.col("value") > threshold), "wet", keys)
    return numbered.groupBy(*keys, "wet", "run").agg(
        F.min("time").alias("begin"), F.count("*").alias("length")
    ).drop("run")


def spell_bands(obs: DataFrame, ens: DataFrame, threshold: float, variable: str = "R") -> DataFrame:
    """Percentiles of spell lengths at as many levels as there are observed spells."""
    spells = lambda df: spell_lengths(df, threshold, variable)
    seen = spells(obs)
    levels = seen.groupBy(*SITE, "wet").agg(F.count("*").alias("_levels"))
    grid = {
        "start": F.lit(0.0),
        "step": F.coalesce(F.try_divide(F.lit(1.0), F.col("_levels") - 1), F.lit(0.0)),
        "count": F.col("_levels"),
        "extra": levels,
    }
    keys = [*SITE, "wet"]
    sim = regular_quantiles(spells(ens), ["realization", *keys], "length", **grid)
    observed = regular_quantiles(seen, keys, "length", **grid).withColumnRenamed("quantile", "obs")
    bands = _bands(sim, [*keys, "level_id"], 0.5, 0.5).drop("sim_lower", "sim_upper")
    return observed.join(bands, [*keys, "level_id"])


def monthly_means(obs: DataFrame, ens: DataFrame) -> DataFrame:
    """Mean per calendar month: observed next to every realization."""
    mean = lambda df, *more: df.filter(finite("value")).groupBy(
        *more, *SITE, F.month("time").alias("month")
    ).agg(F.avg("value").alias("mean"))
    sim = mean(ens, "realization").withColumnRenamed("mean", "sim")
    return sim.join(mean(obs).withColumnRenamed("mean", "obs"), [*SITE, "month"])


def hyd_year_cdf_bands(
    obs: DataFrame, ens: DataFrame, lower_q: float = 0.01, upper_q: float = 0.99,
    n: int = 200, full_years: bool = True, start_month: int = 10,
) -> DataFrame:
    """Distribution of yearly sums: the observed quantiles at n levels (``obs``, null without a whole observed year)
    beside the spread over realizations of theirs."""
    sums = hyd_year_sums(ens, full_years, start_month)
    sim = regular_quantiles(sums, ["realization", *SITE], "total", **_even(n))
    seen = regular_quantiles(hyd_year_sums(obs, full_years, start_month), SITE, "total", **_even(n))
    seen = seen.select(*SITE, "level_id", F.col("quantile").alias("obs"))
    bands = _bands(sim, [*SITE, "level_id"], lower_q, upper_q)
    return bands.join(seen, [*SITE, "level_id"], "left").withColumn("level", F.col("level_id") / (n - 1))


def hyd_year_cdf(obs: DataFrame, full_years: bool = True, start_month: int = 10) -> DataFrame:
    """Observed yearly sums with their plotting positions."""
    sums = hyd_year_sums(obs, full_years, start_month)
    return plotting_positions(sums, ["total", "hyd_year"], SITE)


def annual_error(obs_sums: DataFrame, sim_sums: DataFrame) -> DataFrame:
    """Sum of squared differences between sorted yearly sums, over stations and variables."""
    by = [k for k in ("realization",) if k in sim_sums.columns]
    ranked = lambda df, name, keys: with_position(
        df, keys, ["total", "hyd_year"], value_block("total")
    ).select(*keys, "pos", F.col("total").alias(name))
    pairs = ranked(sim_sums, "sim", [*by, *SITE]).join(
        ranked(obs_sums, "obs", SITE), [*SITE, "pos"]
    )
    return pairs.groupBy(*by).agg(F.sum(F.pow(F.col("obs") - F.col("sim"), 2)).alias("error"))


def check_means(sim: DataFrame, obs: DataFrame, tol: float = 0.15) -> DataFrame:
    """Relative difference of means per variable; an observed 0 asks for a simulated 0."""
    mean = lambda df, name: df.filter(finite("value")).groupBy("variable").agg(F.avg("value").alias(name))
    rows = mean(obs, "obs").join(mean(sim, "sim"), "variable")
    relative = F.abs(F.try_divide(F.col("sim") - F.col("obs"), F.col("obs")))
    return rows.withColumns(
        {
            "relative_difference": relative,
            "passed": F.when(F.col("obs") == 0, F.col("sim") == 0).otherwise(relative <= tol),
        }
    )


def check_correlations(
    sim: DataFrame, obs: DataFrame, variables: Sequence[str] | None = None, tol: float = 0.15
) -> DataFrame:
    """|difference of correlations| per variable pair that occurs in both tables."""
    if variables is not None:
        sim, obs = (d.filter(F.col("variable").isin(list(variables))) for d in (sim, obs))

    def corr(df, name):
        sample = [c for c in series_keys(df) if c != "variable"]
        # stations and realizations are stacked: they label samples, not groups
        stacked = df.withColumn("_sample", F.struct(*sample, "time")) if sample else df.withColumn("_sample", F.struct("time"))
        rows = stacked.select(F.col("_sample").alias("time"), "variable", "value")
        return nan_corr(rows, ("variable",), [], 1).select(
            "variable_i", "variable_j", F.col("corr").alias(name)
        )

    both = corr(obs, "obs").join(corr(sim, "sim"), ["variable_i", "variable_j"])
    gap = F.abs(F.col("sim") - F.col("obs"))
    return both.withColumns({"difference": gap, "passed": gap <= tol})


def check_structure(df: DataFrame) -> DataFrame:
    """Needs the columns station, variable, time; the table is returned unchanged."""
    return require(df, "station", "variable", "time")


def per_realization(report: Callable[[DataFrame], DataFrame], ens: DataFrame, freq: str | None = None):
    """A report on every realization at once: ``realization`` is one more series key."""
    return report(ens if freq is None else resample_mean(ens, freq))
