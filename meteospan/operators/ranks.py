"""Ranks, empirical distributions and marginal transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meteospan.functions.normal import with_norm_cdf, with_norm_ppf
from meteospan.operators.inversions import dominated_weights
from meteospan.operators.ordering import (
    calendar_block,
    carry,
    position_block,
    running_sums,
    value_block,
    value_counts,
    with_position,
)
from meteospan.operators.timeops import doy_targets, interpolate_time
from meteospan.schema import finite, series_keys
from meteospan.session import cut_lineage


def rel_ranks(
    df: DataFrame,
    column: str = "value",
    keys: Sequence[str] | None = None,
    out: str = "u",
    method: str = "average",
) -> DataFrame:
    """(rank − 0.5)/n within ``keys``; ties share the average or the lowest rank."""
    keys = series_keys(df) if keys is None else list(keys)
    counts = value_counts(df, keys, column)
    rank = F.col("below") + (F.col("ties") + 1) / 2 if method == "average" else F.col("below") + 1
    table = counts.select(*keys, column, ((rank - 0.5) / F.col("total")).alias(out))
    return df.join(table, [*keys, column], "left")


def plotting_positions(
    df: DataFrame,
    order: Sequence[str] = ("value", "time"),
    keys: Sequence[str] | None = None,
    out: str = "p",
) -> DataFrame:
    """(i + 0.5)/N by sorted order; ``order`` has to be unique within ``keys``."""
    keys = series_keys(df) if keys is None else list(keys)
    placed = with_position(
        df.filter(F.col(order[0]).isNotNull()), keys, list(order), value_block(order[0])
    )
    return placed.withColumn(out, (F.col("pos") + 0.5) / F.col("pos_total")).drop(
        "pos", "pos_total"
    )


def ecdf_fit(
    df: DataFrame,
    column: str = "value",
    keys: Sequence[str] | None = None,
    data_min: float | None = None,
    data_max: float | None = None,
) -> DataFrame:
    """Knots (keys, x, p): lowest-rank positions padded with (min, 0) and (max, 1)."""
    keys = series_keys(df) if keys is None else list(keys)
    counts = value_counts(df, keys, column)
    knots = counts.select(
        *keys, F.col(column).alias("x"), ((F.col("below") + 0.5) / F.col("total")).alias("p")
    )
    low = F.min("x") if data_min is None else F.lit(float(data_min))
    high = F.max("x") if data_max is None else F.lit(float(data_max))
    pads = knots.groupBy(*keys).agg(low.alias("low"), high.alias("high"))
    ends = pads.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("low").alias("x"), F.lit(0.0).alias("p")),
                F.struct(F.col("high").alias("x"), F.lit(1.0).alias("p")),
            )
        ),
    )
    return knots.unionByName(ends)


def _interpolate_on(
    df: DataFrame,
    knots: DataFrame,
    column: str,
    keys: Sequence[str],
    at: str,
    to: str,
    below: Column | None,
    above: Column | None,
    out: str,
) -> DataFrame:
    """As-of interpolation: knots and queries are merged along the axis ``at``."""
    keys = list(keys)
    nodes = knots.groupBy(*keys, at).agg(F.min(to).alias("_left"), F.max(to).alias("_right"))
    queries = df.filter(finite(column)).select(*keys, F.col(column).alias(at)).distinct()
    axis = nodes.withColumn("_knot", F.lit(True)).unionByName(
        queries.withColumn("_knot", F.lit(False)), allowMissingColumns=True
    )
    node = F.when(
        F.col("_knot"),
        F.struct(F.col(at).alias("at"), F.col("_left").alias("left"), F.col("_right").alias("right")),
    )
    axis = (
        axis.groupBy(*keys, at)
        .agg(
            F.max("_knot").alias("_knot"),
            F.max("_left").alias("_left"),
            F.max("_right").alias("_right"),
            F.max(~F.col("_knot")).alias("_query"),
        )
    )
    merged = carry(axis, keys, at, {"node": node}, value_block(at)).filter("_query")
    a, b, x = F.col("prev_node"), F.col("next_node"), F.col(at)
    slope = F.try_divide(b["left"] - a["right"], b["at"] - a["at"])
    # an infinite pad leaves its outer segment flat
    inner = a["right"] + F.coalesce(slope, F.lit(0.0)) * F.when(
        slope != 0, x - a["at"]
    ).otherwise(0.0)
    value = (
        F.when(a.isNull(), below if below is not None else b["left"])
        .when(b.isNull(), above if above is not None else a["right"])
        .when(a["at"] == x, a["left"] if at == "p" else a["right"])
        .otherwise(inner)
    )
    table = merged.select(*keys, F.col(at).alias(column), value.alias(out))
    return df.join(table, [*keys, column], "left")


def ecdf_cdf(
    df: DataFrame,
    knots: DataFrame,
    column: str = "value",
    keys: Sequence[str] | None = None,
    out: str = "u",
) -> DataFrame:
    """Linear interpolation between knots, 0 and 1 outside, null stays null."""
    keys = [k for k in series_keys(df) if k in knots.columns] if keys is None else keys
    return _interpolate_on(
        df, knots, column, keys, "x", "p", F.lit(0.0), F.lit(1.0), out
    )


def ecdf_ppf(
    df: DataFrame,
    knots: DataFrame,
    column: str = "u",
    keys: Sequence[str] | None = None,
    out: str = "value",
) -> DataFrame:
    """Inverse of ``ecdf_cdf``; where several x share one p the smallest is taken."""
    keys = [k for k in series_keys(df) if k in knots.columns] if keys is None else keys
    return _interpolate_on(df, knots, column, keys, "p", "x", None, None, out)


def quantile_map(
    df: DataFrame,
    src_knots: DataFrame,
    dst_knots: DataFrame,
    column: str = "value",
    keys: Sequence[str] | None = None,
    out: str = "mapped",
) -> DataFrame:
    """Bias correction: destination quantile of the source probability."""
    ranked = ecdf_cdf(df, src_knots, column, keys, "_p")
    return ecdf_ppf(ranked, dst_knots, "_p", keys, out).drop("_p")


def debias_ranks(
    df: DataFrame, knots: DataFrame, column: str = "u", keys: Sequence[str] | None = None
) -> DataFrame:
    """Replace ranks by their probability under a reference table of ranks."""
    return ecdf_cdf(df, knots, column, keys, "_debiased").drop(column).withColumnRenamed(
        "_debiased", column
    )


def normal_parameters(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    keys = [k for k in ("station", "variable") if k in df.columns] if keys is None else keys
    return (
        df.filter(finite("value"))
        .groupBy(*keys)
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    )


def normal_pit(
    df: DataFrame, params: DataFrame | None = None, keys: Sequence[str] | None = None
) -> DataFrame:
    """u = Φ((x − mean)/std) with the population standard deviation per series."""
    params = normal_parameters(df, keys) if params is None else params
    keys = [c for c in params.columns if c not in ("mean", "std")]
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    return with_norm_cdf(df.join(params, keys, "left"), "u", z).drop("mean", "std")


def normal_inverse(df: DataFrame, params: DataFrame, column: str = "u") -> DataFrame:
    """x = mean + std·Φ⁻¹(u)."""
    keys = [c for c in params.columns if c not in ("mean", "std")]
    return (
        with_norm_ppf(df.join(params, keys, "left"), "z", F.col(column))
        .withColumn("value", F.col("mean") + F.col("std") * F.col("z"))
        .drop("mean", "std", "z")
    )


def bound_normal(
    df: DataFrame, limit: float = 6.0, column: str = "u", keys: Sequence[str] | None = None
) -> DataFrame:
    """z = Φ⁻¹(u); |z| > limit is dropped and interpolated in time, the rest becomes 0."""
    scores = with_norm_ppf(df, "z", F.col(column))
    bounded = scores.withColumn("z", F.when(F.abs("z") <= limit, F.col("z")))
    return interpolate_time(bounded, "z", keys=keys).fillna(0.0, ["z"])


def wet_mask(df: DataFrame, threshold: float = 0.24) -> DataFrame:
    return df.withColumn("wet", F.col("value") >= threshold)


def dry_probability_by_doy(
    df: DataFrame, w: int = 15, threshold: float = 0.24, keys: Sequence[str] | None = None
) -> DataFrame:
    """Share of dry days in the window around every day of year."""
    keys = series_keys(df) if keys is None else list(keys)
    days = wet_mask(df.filter(finite("value")), threshold).withColumn(
        "source_doy", F.dayofyear("time")
    )
    # one row per day of year before the window copies it to its targets
    daily = days.groupBy(*keys, "source_doy").agg(
        F.count_if(~F.col("wet")).alias("dry"), F.count("*").alias("n")
    )
    return (
        daily.withColumn("doy", F.explode(doy_targets("source_doy", w)))
        .groupBy(*keys, "doy")
        .agg((F.sum("dry") / F.sum("n")).alias("dry_probability"))
    )


def seasonal_moments(df: DataFrame, w: int = 15, keys: Sequence[str] | None = None) -> DataFrame:
    """Mean and population std per (keys, doy) of the window around each day of year."""
    keys = series_keys(df) if keys is None else list(keys)
    rows = df.filter(finite("value")).withColumn("source_doy", F.dayofyear("time"))
    # centred second moments are combined, so no large squares cancel
    daily = rows.groupBy(*keys, "source_doy").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    spread = daily.withColumn("doy", F.explode(doy_targets("source_doy", w)))
    window_mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    centre = spread.groupBy(*keys, "doy").agg(window_mean.alias("mean"))
    gap = F.col("m") - F.col("mean")
    return (
        spread.join(centre, [*keys, "doy"])
        .groupBy(*keys, "doy", "mean")
        .agg(
            F.sqrt(F.sum(F.col("n") * (F.col("v") + gap * gap)) / F.sum("n")).alias("std")
        )
    )


def seasonal_normal_pit(
    df: DataFrame, w: int = 15, order: int = 6, keys: Sequence[str] | None = None
) -> DataFrame:
    """u = Φ((x − mean_doy)/std_doy) with harmonically smoothed seasonal moments."""
    from meteospan.operators.timeops import smooth_by_doy

    keys = series_keys(df) if keys is None else list(keys)
    moments = seasonal_moments(df, w, keys)
    smooth = smooth_by_doy(moments, keys, ["mean", "std"], order)
    rows = df.withColumn("doy", F.dayofyear("time")).join(smooth, [*keys, "doy"], "left")
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    return with_norm_cdf(rows, "u", z).drop("doy", "mean", "std")


def seasonal_empirical_pit(
    df: DataFrame, w: int = 10, keys: Sequence[str] | None = None
) -> DataFrame:
    """Relative average rank of each value among the values of its doy window."""
    keys = series_keys(df) if keys is None else list(keys)
    rows = df.withColumn("source_doy", F.dayofyear("time"))
    tallies = rows.filter(finite("value")).groupBy(*keys, "source_doy", "value").agg(
        F.count("*").alias("here")
    )
    spread = (
        tallies.withColumn("doy", F.explode(doy_targets("source_doy", w)))
        .withColumn("own", F.when(F.col("doy") == F.col("source_doy"), 1).otherwise(0))
        .groupBy(*keys, "doy", "value")
        .agg(F.sum("here").alias("here"), F.max("own").alias("own"))
    )
    counts = value_counts(spread, [*keys, "doy"], "value", weight=F.col("here"))
    table = counts.select(
        *keys,
        F.col("doy").alias("source_doy"),
        "value",
        ((F.col("below") + F.col("ties") / 2) / F.col("total")).alias("u"),
    )
    return rows.join(table, [*keys, "source_doy", "value"], "left").drop("source_doy")


def dense_ranks(cells: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Join the 0-based dense rank of ``column`` and the number of distinct values."""
    counts = value_counts(cells, keys, column).select(
        *keys, column, F.col("dense").alias(out), F.col("distinct").alias(f"{out}_n")
    )
    return cells.join(counts, [*keys, column])


def dominance(cells: DataFrame, keys: Sequence[str], ranks: Sequence[str], weight: str):
    """Split "strictly smaller in every coordinate" into prefix sums along the first rank.

    Two numbers a < b share a unique bit prefix after which a has 0 and b has 1. Every cell
    is filed under each of its prefixes in the second and later coordinates: as a *source*
    where all next bits are 0, as a *query* where they are 1. Sources before the query along
    the first rank, in the same file, are exactly the dominated cells. No pair of rows is
    ever formed; work is rows × log(distinct)^(K−1).

    Returns (cell rows filed as queries, table of running source weights, file columns).
    """
    filed, files = cells, []
    for i, rank in enumerate(ranks[1:]):
        top = F.floor(F.log2(F.greatest(F.col(f"{rank}_n") - 1, F.lit(1)).cast("double"))).cast("int")
        level, prefix = f"_level{i}", f"_prefix{i}"
        filed = (
            filed.withColumn(level, F.explode(F.sequence(F.lit(0), top)))
            .withColumn("_shifted", F.call_function("shiftright", F.col(rank), F.col(level)))
            .withColumn("_b", F.col("_shifted").bitwiseAND(F.lit(1).cast("long")) == 1)
            .withColumn(prefix, F.call_function("shiftright", F.col("_shifted"), F.lit(1)))
        )
        if i:
            filed = filed.filter(F.col("_b") == F.col("_query"))
        filed = filed.withColumn("_query", F.col("_b")).drop("_shifted", "_b")
        files += [level, prefix]
    spots = filed.groupBy(*keys, *files, ranks[0]).agg(
        F.sum(F.when(~F.col("_query"), F.col(weight)).otherwise(0)).alias("source"),
        F.sum(F.when(F.col("_query"), F.col(weight)).otherwise(0)).alias("query"),
    )
    running = running_sums(
        spots, [*keys, *files], [ranks[0]], {"dominated": F.col("source")}, position_block(ranks[0])
    )
    return filed.filter("_query"), running, files


def nonexceedance(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), out: str = "nonexceedance"
) -> DataFrame:
    """Share of rows of the group that are strictly below in all ``columns``."""
    return _dominance_share(df, list(columns), list(keys), 0.0, out)


def bipit(pairs: DataFrame, keys: Sequence[str] = (), u: str = "u", v: str = "v") -> DataFrame:
    """Empirical copula at every row: (#{u_i < u, v_i < v} + 0.5)/n."""
    return _dominance_share(pairs, [u, v], list(keys), 0.5, "bipit")


#: Types of which no two values become one double.
_EXACT = {"tinyint", "smallint", "int", "float", "double"}


def _plane_share(df, columns, keys, plus, out):
    """Two columns: weights below, counted in blocks of the plane and joined back once."""
    u, v = columns
    cells = df.groupBy(*keys, u, v).agg(F.count("*").alias("_w"))
    counts = dominated_weights(cells, keys, u, v, "_w")
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("x").alias("_x"), F.col("y").alias("_y"), ((F.col("below") + plus) / F.col("n")).alias(out))
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    same = known(u).eqNullSafe(F.col("_x")) & known(v).eqNullSafe(F.col("_y"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rest = [c for c in df.columns if c not in keys and c not in columns]
    return df.join(counts, same, "left").select(*keys, *columns, *rest, out)


def _dominance_share(df, columns, keys, plus, out):
    kinds = dict(df.dtypes)
    if len(set(columns)) == 2 and all(kinds.get(c) in _EXACT for c in columns):
        return _plane_share(df, columns, keys, plus, out)
    cells = df.groupBy(*keys, *columns).agg(F.count("*").alias("_w"))
    ranks = [f"_r{i}" for i in range(len(columns))]
    for column, rank in zip(columns, ranks):
        cells = dense_ranks(cells, keys, column, rank)
    cells = cut_lineage(cells)
    queries, running, files = dominance(cells, keys, ranks, "_w")
    spot = [*keys, *files, ranks[0]]
    counts = (
        queries.join(running.select(*spot, "dominated"), spot)
        .groupBy(*keys, *columns)
        .agg(F.sum("dominated").alias("_below"))
    )
    if keys:
        sized = df.join(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    else:
        sized = df.withColumn("_n", df.select(F.count("*")).scalar())
    share = (F.coalesce(F.col("_below"), F.lit(0)) + plus) / F.col("_n")
    return (
        sized.join(counts, [*keys, *columns], "left")
        .withColumn(out, share)
        .drop("_below", "_n")
    )
