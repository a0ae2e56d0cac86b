"""Dependence statistics on pairs of series or ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meteospan.operators.gram import correlation, pair_moments
from meteospan.operators.ordering import join_on, with_halo, with_position
from meteospan.operators.inversions import tie_and_pair_counts
from meteospan.operators.ranks import rel_ranks
from meteospan.operators.timeops import calendar_keys, doy_targets
from meteospan.schema import finite, pair_keys, series_keys


def cross_section_pairs(
    df: DataFrame,
    within: Sequence[str],
    label: Sequence[str],
    ordered: bool = False,
    value: str = "value",
) -> DataFrame:
    """Rows (within, <label>_i, <label>_j, x, y) for labels observed at the same time.

    The table is shuffled once by ``within`` (which holds the time), where a group has one
    entry per label. Pairs are made after that shuffle and feed a partial aggregation, so
    they are not moved. Their number is the size of the requested matrix.
    """
    entry = F.struct(*label, F.when(finite(value), F.col(value)).alias("_v"))
    held = df.groupBy(*within).agg(F.collect_list(entry).alias("_entries"))
    left = held.withColumn("_i", F.explode("_entries"))
    both = left.withColumn("_j", F.explode("_entries"))
    names = lambda e: F.struct(*[F.col(f"{e}.{c}") for c in label])
    keep = names("_i") != names("_j") if ordered else names("_i") < names("_j")
    return both.filter(keep).select(
        *within,
        *[F.col(f"_i.{c}").alias(f"{c}_i") for c in label],
        *[F.col(f"_j.{c}").alias(f"{c}_j") for c in label],
        F.col("_i._v").alias("x"),
        F.col("_j._v").alias("y"),
    )


def nan_corr(
    df: DataFrame,
    label: Sequence[str] = ("variable",),
    by: Sequence[str] | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Pairwise-complete Pearson correlation, joint rows ``n`` and the share of overlap. With
    ``min_rows`` the correlation is null up to so many joint rows."""
    if by is None:
        by = [c for c in series_keys(df) if c not in label]
    group = [*by, *[f"{c}_i" for c in label], *[f"{c}_j" for c in label]]
    moments = pair_moments(df, by, label)
    out = moments.select(*group, correlation().alias("corr"), "n", (F.col("n") / F.col("rows")).alias("overlap"))
    return out if min_rows is None else out.withColumn("corr", F.when(F.col("n") > min_rows, F.col("corr")))


def corr_matrix(df: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Pearson correlation of every (station, variable) with every other."""
    return nan_corr(df, ("station", "variable"), [c for c in ("realization",) if c in df.columns], min_rows)


def _compare(obs, sim, label, by, min_rows):
    a = nan_corr(obs, (label,), by, min_rows).withColumnRenamed("corr", "obs_corr").drop("n", "overlap")
    b = nan_corr(sim, (label,), by, min_rows).withColumnRenamed("corr", "sim_corr").drop("n", "overlap")
    return a.join(b, [*by, f"{label}_i", f"{label}_j"])


def intra_site_corr(obs: DataFrame, sim: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Correlation of variable pairs within each station, observed and simulated."""
    return _compare(obs, sim, "variable", ["station"], min_rows)


def inter_site_corr(obs: DataFrame, sim: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Correlation of station pairs within each variable, observed and simulated."""
    return _compare(obs, sim, "station", ["variable"], min_rows)


def _band(obs, ens, label, by, min_rows):
    a = nan_corr(obs, (label,), by, min_rows).withColumnRenamed("corr", "obs_corr").drop("n", "overlap")
    group = [*by, f"{label}_i", f"{label}_j"]
    b = (
        nan_corr(ens, (label,), ["realization", *by], min_rows)
        .groupBy(*group)
        .agg(F.min("corr").alias("sim_min"), F.max("corr").alias("sim_max"))
    )
    return a.join(b, group)


def ensemble_intra_corr_band(obs: DataFrame, ens: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Observed variable-pair correlation next to the range over realizations."""
    return _band(obs, ens, "variable", ["station"], min_rows)


def ensemble_inter_corr_band(obs: DataFrame, ens: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Observed station-pair correlation next to the range over realizations."""
    return _band(obs, ens, "station", ["variable"], min_rows)


def corr_by_month(df: DataFrame, first: str) -> DataFrame:
    """Correlation of variable ``first`` with every other variable by calendar month."""
    by = [c for c in series_keys(df) if c != "variable"]
    held = df.groupBy(*by, "time").agg(
        F.max(F.when(F.col("variable") == first, F.col("value"))).alias("x"),
        F.collect_list(
            F.when(F.col("variable") != first, F.struct("variable", "value"))
        ).alias("_others"),
    )
    return (
        held.select(*by, F.month("time").alias("month"), "x", F.inline("_others"))
        .groupBy(*by, "variable", "month")
        .agg(F.corr("x", "value").alias("corr"), F.count("*").alias("n"))
    )


def corr_by_doy_window(pairs: DataFrame, w: int = 15, keys: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of (u, v) in the window around every day of year.

    Daily moments are merged, so the window copies at most 366 rows per key.
    """
    keys = pair_keys(pairs) if keys is None else list(keys)
    rows = pairs.filter(finite("u") & finite("v")).withColumn("_x", F.dayofyear("time"))
    daily = rows.groupBy(*keys, "_x").agg(
        F.count("*").alias("n"),
        F.avg("u").alias("mu"),
        F.avg("v").alias("mv"),
        F.var_pop("u").alias("vu"),
        F.var_pop("v").alias("vv"),
        F.covar_pop("u", "v").alias("cuv"),
    )
    spread = daily.withColumn("doy", F.explode(doy_targets("_x", w)))
    group = [*keys, "doy"]
    centre = spread.groupBy(*group).agg(
        (F.sum(F.col("n") * F.col("mu")) / F.sum("n")).alias("cu"),
        (F.sum(F.col("n") * F.col("mv")) / F.sum("n")).alias("cv"),
    )
    du, dv, n = F.col("mu") - F.col("cu"), F.col("mv") - F.col("cv"), F.col("n")
    return (
        spread.join(centre, group)
        .groupBy(*group)
        .agg(
            F.sum(n).alias("n"),
            F.sum(n * (F.col("cuv") + du * dv)).alias("_c"),
            F.sum(n * (F.col("vu") + du * du)).alias("_u"),
            F.sum(n * (F.col("vv") + dv * dv)).alias("_v"),
        )
        .select(*group, "n", F.try_divide(F.col("_c"), F.sqrt(F.col("_u") * F.col("_v"))).alias("corr"))
    )


def kendall_tau(
    pairs: DataFrame, keys: Sequence[str] | None = None, u: str = "u", v: str = "v"
) -> DataFrame:
    """Kendall's τ-b on rows finite in both, from discordant pairs counted block by block."""
    keys = pair_keys(pairs) if keys is None else list(keys)
    cells = (
        pairs.filter(finite(u) & finite(v)).groupBy(*keys, u, v).agg(F.count("*").alias("_w"))
    )
    counts = tie_and_pair_counts(cells, keys, u, v, "_w")
    n0 = F.col("n") * (F.col("n") - 1) / 2
    n1, n2, n3 = F.col("n1"), F.col("n2"), F.col("n3")
    tau = F.try_divide(n0 - n1 - n2 + n3 - 2.0 * F.col("d"), F.sqrt((n0 - n1) * (n0 - n2)))
    return counts.select(*keys, F.col("n").cast("long").alias("n"), tau.alias("tau"))


def tau_min(n: Column) -> Column:
    """5 % bound of |τ| under independence for n rows."""
    n = n.cast("double")
    return F.lit(1.96) / F.sqrt(F.lit(9.0) * n * (n - 1) / (2.0 * (2.0 * n + 5.0)))


def _spearman(u: Column, v: Column) -> Column:
    """Aggregate on relative ranks u = (rank − 0.5)/n."""
    n = F.count(u).cast("double")
    # Σ(nu+½)(nv+½) expanded, because n is itself an aggregate
    product = n * n * F.sum(u * v) + 0.5 * n * (F.sum(u) + F.sum(v)) + 0.25 * n
    return F.try_divide(12.0 * product, n * (n + 1) * (n - 1)) - F.try_divide(3.0 * (n + 1), n - 1)


def _asym1(u: Column, v: Column) -> Column:
    x, y = u - 0.5, v - 0.5
    return F.avg(x * y * (x + y))


def _asym2(u: Column, v: Column) -> Column:
    x, y = u - 0.5, v - 0.5
    return F.avg(-x * y * (x - y))


def asymmetry_means(u: Column, v: Column) -> tuple[Column, Column]:
    """Aggregates of both asymmetries."""
    return _asym1(u, v), _asym2(u, v)


def _per_group(pairs, keys, **aggregates):
    keys = pair_keys(pairs) if keys is None else list(keys)
    return pairs.groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()])


def spearman(pairs: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return _per_group(pairs, keys, rho=_spearman(F.col("u"), F.col("v")))


def asymmetry1(pairs: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Mean of xy(x + y) of centred ranks: difference between the two equal corners."""
    return _per_group(pairs, keys, asymmetry1=_asym1(F.col("u"), F.col("v")))


def asymmetry2(pairs: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Mean of −xy(x − y) of centred ranks: difference between the two opposite corners."""
    return _per_group(pairs, keys, asymmetry2=_asym2(F.col("u"), F.col("v")))


def asymmetry_sum(pairs: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Sum of u²v + uv² of centred ranks."""
    u, v = F.col("u") - 0.5, F.col("v") - 0.5
    return _per_group(pairs, keys, asymmetry_sum=F.sum(u * u * v + u * v * v))


def _lagged(df: DataFrame, lags: Sequence[int], label: str):
    """(by, label_i, label_j, lag, x, y): series i now against series j ``lag`` steps later.

    Steps are positions on the time axis of the group, so gaps stay gaps.
    """
    by = [c for c in series_keys(df) if c != label]
    times = df.select(*by, "time").distinct()
    axis = with_position(times, by)
    entry = F.struct(F.col(label).alias("name"), F.when(finite("value"), F.col("value")).alias("v"))
    held = (
        df.groupBy(*by, "time")
        .agg(F.collect_list(entry).alias("_now"))
        .join(axis, [*by, "time"])
    )
    span = max(lags)
    ahead = {f"_at{k}": (lambda k: lambda w: F.lead("_now", k).over(w))(k) for k in lags if k}
    rows = with_halo(held, by, 0, span, ahead) if ahead else held
    later = F.array(
        *[F.struct(F.lit(k).alias("lag"), F.col(f"_at{k}" if k else "_now").alias("then")) for k in lags]
    )
    return (
        rows.select(*by, "_now", F.inline(later))
        .withColumn("_i", F.explode("_now"))
        .withColumn("_j", F.explode("then"))
        .select(
            *by,
            F.col("_i.name").alias(f"{label}_i"),
            F.col("_j.name").alias(f"{label}_j"),
            "lag",
            F.col("_i.v").alias("x"),
            F.col("_j.v").alias("y"),
        )
    )


def _series_moments(df, by, label, means):
    m = df.filter(finite("value")).groupBy(*by, label).agg(
        F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std")
    )
    if means is not None:
        m = m.drop("_mean").join(means.withColumnRenamed("mean", "_mean"), [label])
    return m


def _cross(df, lags, label, means):
    by = [c for c in series_keys(df) if c != label]
    moments = _series_moments(df, by, label, means)
    products = pair_moments(df, by, [label], lags, ordered=True).withColumnsRenamed({"mean_i": "_about_i", "mean_j": "_about_j"})
    side = lambda s: moments.withColumnsRenamed(
        {label: f"{label}_{s}", "_mean": f"_mean_{s}", "_std": f"_std_{s}"}
    )
    rows = products.join(side("i"), [*by, f"{label}_i"]).join(side("j"), [*by, f"{label}_j"])
    n = F.col("n")
    # from sums about the series means to sums about the means asked for
    shift_i, shift_j = F.col("_about_i") - F.col("_mean_i"), F.col("_about_j") - F.col("_mean_j")
    about = F.col("sxy") + shift_j * F.col("sx") + shift_i * F.col("sy") + n * shift_i * shift_j
    cov = F.try_divide(about, n - (1 if means is None else 0))
    group = [*by, f"{label}_i", f"{label}_j", "lag"]
    return rows.select(
        *group, "n", cov.alias("cov"),
        F.try_divide(cov, F.col("_std_i") * F.col("_std_j")).alias("corr"),
    )


def cross_cov(
    df: DataFrame, k: int = 1, means: DataFrame | None = None, label: str = "variable"
) -> DataFrame:
    """Covariance of every series with every other k steps later, about series means."""
    return _cross(df, [k], label, means).drop("corr")


def cross_corr(df: DataFrame, max_lags: int = 10, label: str = "variable") -> DataFrame:
    """Cross-correlation for lags 0 … max_lags − 1."""
    return _cross(df, list(range(max_lags)), label, None).drop("cov")


def hist2d(
    pairs: DataFrame, xbins: int = 15, ybins: int = 15, keys: Sequence[str] | None = None
) -> DataFrame:
    """Density histogram of (u, v) on equal bins between the extremes of each group."""
    keys = pair_keys(pairs) if keys is None else list(keys)
    if not keys:
        return hist2d(pairs.withColumn("_all", F.lit(0)), xbins, ybins, ["_all"]).drop("_all")
    rows = pairs.filter(finite("u") & finite("v"))
    limits = rows.groupBy(*keys).agg(
        F.min("u").alias("_u0"), F.max("u").alias("_u1"),
        F.min("v").alias("_v0"), F.max("v").alias("_v1"), F.count("*").alias("_n"),
    )
    bin_of = lambda c, lo, hi, n: F.least(
        F.floor(F.coalesce(F.try_divide((F.col(c) - F.col(lo)) * n, F.col(hi) - F.col(lo)), F.lit(0.0))),
        F.lit(n - 1),
    )
    joined = rows.join(limits, keys)
    area = (F.col("_u1") - F.col("_u0")) / xbins * (F.col("_v1") - F.col("_v0")) / ybins
    return (
        joined.groupBy(
            *keys, bin_of("u", "_u0", "_u1", xbins).alias("bin_u"),
            bin_of("v", "_v0", "_v1", ybins).alias("bin_v"),
        )
        .agg(F.count("*").alias("n"), F.max(F.try_divide(F.lit(1.0), F.col("_n") * area)).alias("_d"))
        .withColumn("density", F.col("n") * F.col("_d"))
        .drop("_d")
    )


def ranked_pairs(
    df: DataFrame, k: int = 0, wet_only: bool = False, threshold: float = 0.24,
    rain: str = "R", by: str | None = None,
) -> DataFrame:
    """Relative ranks (u, v) of every ordered variable pair, v taken k steps later.

    Ranks are taken within the group given by ``by``: None pools stations, ``station`` or
    ``season`` separate them. With ``wet_only`` only times with rain above the threshold stay.
    """
    group = {None: [], "station": ["station"], "season": ["season"]}[by]
    rows = df.filter(finite("value"))
    if by == "season":
        rows = calendar_keys(rows).select(*df.columns, "season")
    if wet_only:
        site = [c for c in series_keys(df) if c != "variable"]
        wet = rows.filter((F.col("variable") == rain) & (F.col("value") >= threshold))
        rows = rows.join(wet.select(*site, "time"), [*site, "time"], "left_semi")
    ranked = rel_ranks(rows, "value", [*group, "variable"], "rank")
    extra = [c for c in ("season",) if c in ranked.columns]
    ranked = ranked.drop("value").withColumnRenamed("rank", "value")
    if k == 0:
        pairs = cross_section_pairs(
            ranked, [c for c in series_keys(df) if c != "variable"] + extra + ["time"],
            ["variable"], ordered=True,
        )
        return pairs.select(*group, F.col("variable_i").alias("var_u"),
                            F.col("variable_j").alias("var_v"), F.col("x").alias("u"), F.col("y").alias("v"))
    if extra:
        raise ValueError("a lag across seasons is not defined; use by=None or 'station'")
    lagged = _lagged(ranked, [k], "variable").filter("variable_i <> variable_j")
    return lagged.filter("x is not null and y is not null").select(
        *group, F.col("variable_i").alias("var_u"), F.col("variable_j").alias("var_v"),
        F.col("x").alias("u"), F.col("y").alias("v"),
    )


def pair_report(
    df: DataFrame, k: int = 0, wet_only: bool = False, by: str | None = None,
    threshold: float = 0.24, rain: str = "R", bins: int = 15,
) -> DataFrame:
    """ρ, both asymmetries and the 2-D histogram of every ordered variable pair."""
    pairs = ranked_pairs(df, k, wet_only, threshold, rain, by)
    group = [c for c in ("station", "season", "var_u", "var_v") if c in pairs.columns]
    u, v = F.col("u"), F.col("v")
    stats = pairs.groupBy(*group).agg(
        F.count("*").alias("n"), _spearman(u, v).alias("rho"),
        _asym1(u, v).alias("asymmetry1"), _asym2(u, v).alias("asymmetry2"),
    )
    cells = hist2d(pairs, bins, bins, group).groupBy(*group).agg(
        # at most bins² entries
        F.sort_array(F.collect_list(F.struct("bin_u", "bin_v", "density"))).alias("histogram")
    )
    return stats.join(cells, group)
