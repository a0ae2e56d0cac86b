"""Every operator as a query over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

from meteospan.functions import copula as cop
from meteospan.functions.normal import with_norm_cdf, with_norm_ppf
from meteospan.operators import (
    conditions as cond, ensemble as ev, fit, heatwaves as hw, pairs as pr, ranks as rk,
    reshape as rs, scenario as sc, timeops as tm, vine as vn,
)
from meteospan.session import cut_lineage, shared_path
from meteospan.sources import adapters as src, ensemble_store as store, observations as obs_io

VARIABLES = ["discount", "price", "quantity", "tax"]
THETA = {
    "alimikailhaq": 0.6, "clayton": 0.08, "gaussian": 0.4, "gumbel": 1.4, "gumbelbarnett": 0.5,
    "joe": 1.6, "nelsen10": 0.5, "nelsen12": 1.3, "nelsen13": 1.5, "nelsen14": 1.4, "plackett": 3.0,
}


def r6(df: DataFrame, digits: int = 6, shift: float = 0.0) -> DataFrame:
    """Round doubles so that two engines agree on the last digits. ``shift`` moves values
    that fall exactly between two roundings to one side."""
    return df.select(
        *[
            F.round(F.col(c.name) + shift if shift else F.col(c.name), digits).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name)
            for c in df.schema.fields
        ]
    )


daily, ens, hourly = src.daily_obs, src.ensemble, src.hourly_obs


def gappy(s, d):
    day = F.dayofmonth("time")
    gone = day.between(5, 8) | (F.col("time") < "1995-01-20") | (F.col("time") > "2001-10-15")
    return daily(s, d).withColumn("value", F.when(~gone, F.col("value")))


def ranks(s, d, method="average"):
    return rk.rel_ranks(daily(s, d), method=method)


def rank_pairs(s, d):
    """(station, var_u, var_v, time, u, v) for every variable pair of a station."""
    long = ranks(s, d).select("station", "variable", "time", F.col("u").alias("value"))
    return pr.cross_section_pairs(long, ["station", "time"], ["variable"]).select(
        "station", F.col("variable_i").alias("var_u"), F.col("variable_j").alias("var_v"), "time",
        F.col("x").alias("u"), F.col("y").alias("v"),
    )


def line_ranks(s, d):
    """Ranks of quantity and price of every order line."""
    rows = src.line_pairs(s, d, "l_quantity", "l_extendedprice")
    ranked = rk.rel_ranks(rk.rel_ranks(rows, "x", ["station"], "u"), "y", ["station"], "v")
    return ranked.select("station", "order", "line", "u", "v")


def yearly(df, full=False):
    return tm.hyd_year_sums(df, full)


def wet_ranks(s, d):
    return ranks(s, d).withColumn("wet", F.col("value") > 0)


def member_rows(pairs, build, which):
    """Mean of an expression per pair of variables and member of the copula families."""
    rows = None
    stats = [
        F.avg(build(n, F.col("u"), F.col("v"), THETA[n], r)).alias(f"{n}_{r}") for n, r in which
    ]
    group = ["station", "var_u", "var_v"]
    wide = pairs.groupBy(*group).agg(*stats)
    return wide.unpivot(group, [f"{n}_{r}" for n, r in which], "member", "mean_value")


CLOSED = [m for m in cop.members() if m[0] not in ("gaussian", "independence")]


def seasonal_fits(s, d):
    pairs = rank_pairs(s, d)
    return pairs, fit.smooth_doy(fit.fit_seasonal_copula(pairs))


def line_ranks_long(s, d):
    return ranks(s, d).select("station", "variable", "time", "u")


def line_vine(s, d, kind="C", by=None, **options):
    # a row for each day and variable, read by the fit, the quantiles and the comparison; the lines are read once
    table = cut_lineage(line_ranks_long(s, d))
    return table, vn.fit_vine(table, VARIABLES, kind, by, **options)


#: Edges of two given vines: tree, ends, condition, family, rotation, θ and the swing of θ over the year.
GIVEN = {
    "C": [
        (0, "price", "discount", [], "plackett", 0, 2.0, 0.5), (0, "price", "quantity", [], "clayton", 180, 0.09, 0.0),
        (0, "price", "tax", [], "plackett", 90, 1.4, 0.0), (1, "discount", "quantity", ["price"], "clayton", 90, 0.05, 0.0),
        (1, "discount", "tax", ["price"], "plackett", 0, 0.6, 0.2), (2, "quantity", "tax", ["price", "discount"], "clayton", 270, 0.08, 0.0),
    ],
    "R": [
        (0, "discount", "price", [], "clayton", 0, 0.09, 0.0), (0, "price", "quantity", [], "plackett", 0, 3.0, 1.5),
        (0, "quantity", "tax", [], "plackett", 180, 0.5, 0.0), (1, "discount", "quantity", ["price"], "plackett", 270, 1.8, 0.3),
        (1, "price", "tax", ["quantity"], "clayton", 180, 0.07, 0.0), (2, "discount", "tax", ["price", "quantity"], "plackett", 0, 1.2, 0.0),
    ],
}


def given_vine(s, d, kind, by_station=False):
    """A vine with known parameters, the same for every station of the table, some of them with a θ by day of year."""
    rows = [(*e[:6], float(e[6]), float(e[7])) for e in GIVEN[kind]]
    edges = s.createDataFrame(rows, "tree int, node_u string, node_v string, cond array<string>, family string, rotation int, theta double, swing double")
    year = F.transform(F.sequence(F.lit(1), F.lit(366)), lambda day: F.col("theta") + F.col("swing") * F.sin(2 * math.pi * day / 366))
    edges = edges.withColumn("thetas", F.when(F.col("swing") != 0, year)).withColumn("tau", F.lit(0.25)).drop("swing")
    return edges.crossJoin(daily(s, d).select("station").distinct()) if by_station else edges


def given_quantiles(s, d, kind, by=None):
    return vn.vine_quantiles(line_ranks_long(s, d), given_vine(s, d, kind, bool(by)), VARIABLES, by)


def given_inverse(s, d, kind, by=None, **options):
    """The ranks themselves, taken as given uniforms, back through the vine."""
    return vn.vine_inverse(line_ranks_long(s, d).withColumnRenamed("u", "q"), given_vine(s, d, kind, bool(by)), VARIABLES, by, **options)


def first_tree(s, d):
    rows = vn.pseudo_observations(vn.vine_rows(line_ranks_long(s, d), VARIABLES), given_vine(s, d, "C").filter("tree = 0"))
    names = ["price|discount", "discount|price", "price|quantity", "quantity|price", "price|tax", "tax|price"]
    return rows.select("station", "time", *[F.element_at("us", n).alias(n.replace("|", "_given_")) for n in names])


def round_trip(s, d, kind, by=None, **options):
    """Largest gap between the ranks and what comes back from their quantiles under a fitted vine."""
    table, vine = line_vine(s, d, kind, by, **options)
    back = vn.vine_inverse(vn.vine_quantiles(table, vine, VARIABLES, by), vine, VARIABLES, by).withColumnRenamed("u", "back")
    both = back.join(table, ["station", "variable", "time"])
    gap = F.max(F.abs(F.col("back") - F.col("u"))).alias("max_gap")
    return r6(both.groupBy("station", "variable").agg(F.count("back").alias("n"), gap), 5)


def conditions(s, d):
    sums = yearly(daily(s, d).filter("variable = 'quantity'"))
    typical = sums.groupBy("station").agg(F.avg("total").alias("m"), F.stddev_pop("total").alias("sd"))
    kinds = F.array(
        F.struct(F.lit("bounds").alias("kind"), (F.col("m") * 0.98).alias("lower"), (F.col("m") * 1.02).alias("upper")),
        F.struct(F.lit("std").alias("kind"), F.lit(None).cast("double").alias("lower"), (F.col("sd") * 0.9).alias("upper")),
        F.struct(F.lit("mean").alias("kind"), (F.col("m") * 1.01).alias("lower"), (F.col("m") * 1.05).alias("upper")),
    )
    empty = F.lit(None).cast("double")
    return typical.select("station", F.inline(kinds)).select(
        F.concat_ws("-", "station", "kind").alias("name"), "station", "kind", "lower", "upper",
        F.when(F.col("kind") == "mean", F.lit(100.0)).otherwise(empty).alias("lower_period"),
        F.when(F.col("kind") == "mean", F.lit(400.0)).otherwise(empty).alias("upper_period"),
    )


def vine_candidates(s, d):
    return vn.pair_edges(ranks(s, d).select("station", "variable", "time", "u"), VARIABLES, by=["station"])


def hot_mask(s, d):
    limit = F.expr("CASE variable WHEN 'price' THEN 40000.0D WHEN 'quantity' THEN 27.0D WHEN 'discount' THEN 0.055D ELSE 0.042D END")
    return daily(s, d).withColumn("mask", F.col("value") > limit)


def build() -> dict:
    q = {}
    # sources and reshaping
    q["to_wide"] = lambda s, d: r6(rs.to_wide(daily(s, d), VARIABLES))
    q["to_long"] = lambda s, d: rs.to_long(
        src.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"),
        ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])
    q["attach_stations"] = lambda s, d: r6(rs.attach_stations(src.order_obs(s, d), src.stations(s, d)))
    q["filter_stations"] = lambda s, d: r6(rs.keep_stations(
        src.order_obs(s, d), rs.filter_stations(src.stations(s, d), -60.0, -20.0, 50.0, 20.0)))
    q["select_labels"] = lambda s, d: r6(rs.select(
        daily(s, d), ["A", "R"], ["price", "tax"], "1996-03-01", "1998-02-28"))
    q["short_station_names"] = lambda s, d: rs.short_station_names(
        src.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.concat("o_orderpriority", F.lit(", x"))).otherwise(F.col("o_orderpriority")).alias("station")))
    q["pad_first_day"] = lambda s, d: r6(rs.pad_first_day(hourly(s, d).filter("time >= '2024-01-01 06:00:00'")))
    q["overlay"] = lambda s, d: r6(rs.overlay(
        daily(s, d), ens(s, d).filter("realization = 0").drop("realization"), ["discount", "tax"]))
    q["merge_external"] = lambda s, d: r6(rs.merge_external(
        daily(s, d).filter("variable <> 'tax'"), src.order_obs(s, d)))
    q["convert"] = lambda s, d: r6(rs.convert(
        daily(s, d), [lambda t: t.withColumn("value", F.when(F.col("variable") == "quantity", F.col("value") * 2 + 1).otherwise(F.col("value")))], {"quantity": "amount"}))
    q["missing_realizations"] = lambda s, d: store.missing_realizations(
        s, src.table(s, d, "lineitem").filter("l_quantity > 49").select((F.col("l_suppkey") % 17 * 2).cast("int").alias("realization")), 40)
    q["derive_ensemble"] = lambda s, d: r6(store.derive_ensemble(
        ens(s, d), ens(s, d).filter("realization < 3").withColumn("value", F.col("value") + 1)))
    # input and output: written below the shared folder and read back
    q["write_load_ensemble"] = lambda s, d: r6(_stored_ensemble(s, d))
    q["save_load_model"] = lambda s, d: r6(_stored_model(s, d))
    q["read_observations"] = lambda s, d: r6(_stored_observations(s, d))
    q["write_station_csv"] = lambda s, d: _stored_csv(s, d)
    q["symmetry_flags"] = lambda s, d: r6(_symmetry(rank_pairs(s, d)))
    # time
    q["resample_mean"] = lambda s, d: r6(tm.resample_mean(gappy(s, d), "month"))
    q["resample_day_night"] = lambda s, d: r6(tm.resample_day_night(hourly(s, d)))
    q["interpolate_time"] = lambda s, d: r6(tm.interpolate_time(gappy(s, d)))
    q["interpolate_extrapolate"] = lambda s, d: r6(tm.interpolate_time(gappy(s, d), extrapolate=True))
    q["fill_edges"] = lambda s, d: r6(tm.fill_edges(gappy(s, d)))
    q["missing_report"] = lambda s, d: tm.missing_report(gappy(s, d))
    q["clean_ranks"] = lambda s, d: r6(tm.clean_ranks(ranks(s, d).withColumn("u", F.when(F.col("u").between(0.05, 0.9), F.col("u")).otherwise(0.0)).drop("value")))
    q["calendar_keys"] = lambda s, d: r6(tm.calendar_keys(daily(s, d), position=True))
    q["doy_window"] = lambda s, d: r6(tm.doy_window(daily(s, d), 15).groupBy("station", "variable", "doy").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))
    q["lag_pairs"] = lambda s, d: r6(tm.lag_pairs(daily(s, d), 3))
    q["rolling_sum"] = lambda s, d: r6(tm.rolling_sum(gappy(s, d), 5))
    q["rolling_pool"] = lambda s, d: r6(tm.rolling_pool(daily(s, d), 5).groupBy("station", "variable", F.dayofyear("time").alias("doy")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")))
    q["hyd_year_sums"] = lambda s, d: r6(yearly(daily(s, d)), 3)
    q["hyd_year_sums_full"] = lambda s, d: r6(tm.hyd_year_sums(src.order_obs(s, d).groupBy(F.lit("all").alias("station"), "variable", "time").agg(F.max("value").alias("value")), True))
    q["annual_extremes"] = lambda s, d: r6(tm.annual_extremes(yearly(daily(s, d))).withColumn("totals", F.concat_ws(";", F.transform("totals", lambda x: F.round(x, 3).cast("decimal(20,3)").cast("string")))), 5)
    q["period_band"] = lambda s, d: r6(_band(s, d))
    q["harmonic_amplitudes"] = lambda s, d: r6(tm.harmonic_amplitudes(daily(s, d), _band(s, d)), 3)
    q["harmonic_year_integrals"] = lambda s, d: r6(tm.harmonic_year_integrals(daily(s, d), _band(s, d)), 3)
    # ranks
    q["rel_ranks"] = lambda s, d: r6(ranks(s, d))
    q["rel_ranks_lines"] = lambda s, d: r6(line_ranks(s, d))
    q["plotting_positions"] = lambda s, d: r6(rk.plotting_positions(daily(s, d)))
    q["ecdf_fit"] = lambda s, d: r6(rk.ecdf_fit(daily(s, d)))
    q["ecdf_cdf"] = lambda s, d: r6(rk.ecdf_cdf(ens(s, d), rk.ecdf_fit(daily(s, d))))
    q["ecdf_ppf"] = lambda s, d: r6(rk.ecdf_ppf(ranks(s, d).drop("value"), rk.ecdf_fit(daily(s, d))))
    q["quantile_map"] = lambda s, d: r6(rk.quantile_map(daily(s, d).filter("station = 'A'"), rk.ecdf_fit(daily(s, d).filter("station = 'A'"), keys=["variable"]), rk.ecdf_fit(daily(s, d).filter("station = 'N'"), keys=["variable"]), keys=["variable"]))
    q["debias_ranks"] = lambda s, d: r6(rk.debias_ranks(ranks(s, d).withColumn("u", F.pow("u", 2.0)).drop("value"), rk.ecdf_fit(ranks(s, d), "u", data_min=0.0, data_max=1.0)))
    q["normal_cdf_ppf"] = lambda s, d: r6(with_norm_cdf(with_norm_ppf(ranks(s, d), "z", F.col("u")), "back", F.col("z") * 0.5))
    q["normal_pit"] = lambda s, d: r6(rk.normal_pit(daily(s, d)))
    q["normal_inverse"] = lambda s, d: r6(rk.normal_inverse(ranks(s, d).drop("value"), rk.normal_parameters(daily(s, d))))
    q["bound_normal"] = lambda s, d: r6(rk.bound_normal(ranks(s, d).drop("value"), 2.0))
    q["seasonal_moments"] = lambda s, d: r6(rk.seasonal_moments(daily(s, d), 15))
    q["seasonal_normal_pit"] = lambda s, d: r6(rk.seasonal_normal_pit(daily(s, d), 15, 6).drop("value"), 5)
    q["seasonal_empirical_pit"] = lambda s, d: r6(rk.seasonal_empirical_pit(daily(s, d), 10))
    q["dry_probability_by_doy"] = lambda s, d: r6(rk.dry_probability_by_doy(daily(s, d).filter("variable = 'discount'"), 15, 0.05))
    q["wet_mask"] = lambda s, d: r6(rk.wet_mask(daily(s, d), 0.05))
    q["bipit"] = lambda s, d: r6(rk.bipit(rank_pairs(s, d), ["station", "var_u", "var_v"]))
    q["bipit_lines"] = lambda s, d: r6(rk.bipit(src.line_pairs(s, d, "l_quantity", "l_extendedprice"), ["station"], "x", "y"))
    q["nonexceedance"] = lambda s, d: r6(rk.nonexceedance(rs.to_wide(daily(s, d), VARIABLES), ["discount", "quantity", "tax"], ["station"]))
    # dependence
    q["kendall_tau"] = lambda s, d: r6(pr.kendall_tau(rank_pairs(s, d)).withColumn("tau_min", pr.tau_min(F.col("n"))))
    q["kendall_tau_lines"] = lambda s, d: r6(pr.kendall_tau(src.line_pairs(s, d, "l_quantity", "l_extendedprice"), ["station"], "x", "y"))
    q["spearman"] = lambda s, d: r6(pr.spearman(rank_pairs(s, d)))
    q["asymmetry1"] = lambda s, d: r6(pr.asymmetry1(rank_pairs(s, d)))
    q["asymmetry2"] = lambda s, d: r6(pr.asymmetry2(rank_pairs(s, d)))
    q["asymmetry_sum"] = lambda s, d: r6(pr.asymmetry_sum(rank_pairs(s, d)))
    q["nan_corr"] = lambda s, d: r6(pr.nan_corr(gappy(s, d), min_rows=30))
    q["corr_matrix"] = lambda s, d: r6(pr.corr_matrix(daily(s, d), 30))
    q["intra_site_corr"] = lambda s, d: r6(pr.intra_site_corr(daily(s, d), ens(s, d).filter("realization = 1").drop("realization"), 30))
    q["inter_site_corr"] = lambda s, d: r6(pr.inter_site_corr(daily(s, d), ens(s, d).filter("realization = 1").drop("realization"), 30))
    q["ensemble_intra_corr_band"] = lambda s, d: r6(pr.ensemble_intra_corr_band(daily(s, d), ens(s, d), 30))
    q["ensemble_inter_corr_band"] = lambda s, d: r6(pr.ensemble_inter_corr_band(daily(s, d), ens(s, d), 30))
    q["corr_by_month"] = lambda s, d: r6(pr.corr_by_month(daily(s, d), "price"))
    q["corr_by_doy_window"] = lambda s, d: r6(pr.corr_by_doy_window(rank_pairs(s, d), 15))
    q["cross_cov"] = lambda s, d: r6(pr.cross_cov(gappy(s, d), 2), 4)
    q["cross_corr"] = lambda s, d: r6(pr.cross_corr(daily(s, d), 4))
    q["cross_corr_stations"] = lambda s, d: r6(pr.cross_corr(daily(s, d), 3, "station"))
    q["hist2d"] = lambda s, d: r6(pr.hist2d(rank_pairs(s, d), 10, 10))
    q["pair_report"] = lambda s, d: r6(_flat_report(pr.pair_report(daily(s, d), bins=5)))
    q["pair_report_lag_station"] = lambda s, d: r6(_flat_report(pr.pair_report(daily(s, d), k=1, by="station", bins=5)))
    q["pair_report_wet_season"] = lambda s, d: r6(_flat_report(pr.pair_report(daily(s, d), wet_only=True, by="season", threshold=0.04, rain="discount", bins=5)))
    # copulas
    q["copula_cdf"] = lambda s, d: r6(member_rows(rank_pairs(s, d), cop.copula_cdf, CLOSED))
    q["copula_density"] = lambda s, d: r6(member_rows(rank_pairs(s, d), cop.copula_density, CLOSED), 5)
    q["copula_h"] = lambda s, d: r6(member_rows(rank_pairs(s, d), cop.h_v_given_u, CLOSED))
    q["copula_h_given_v"] = lambda s, d: r6(member_rows(rank_pairs(s, d), cop.h_u_given_v, CLOSED))
    q["gaussian_copula"] = lambda s, d: r6(rank_pairs(s, d).groupBy("station", "var_u", "var_v").agg(
        F.avg(cop.copula_cdf("gaussian", F.col("u"), F.col("v"), 0.4)).alias("cdf"),
        F.avg(cop.copula_density("gaussian", F.col("u"), F.col("v"), 0.4)).alias("density"),
        F.avg(cop.h_v_given_u("gaussian", F.col("u"), F.col("v"), 0.4)).alias("h")), 5)
    q["h_inverse"] = lambda s, d: r6(_inverse_round_trip(rank_pairs(s, d)), 4)
    q["log_likelihood"] = lambda s, d: r6(fit.log_likelihood(rank_pairs(s, d), "plackett", 1.3), 4)
    q["fit_copula"] = lambda s, d: r6(fit.fit_copula(rank_pairs(s, d), [("plackett", 0), ("gumbelbarnett", 0)]), 5)
    q["fit_copula_lines"] = lambda s, d: r6(fit.fit_copula(line_ranks(s, d), [("plackett", 0)], ["station"]), 4)
    q["fit_copula_wet"] = lambda s, d: r6(fit.fit_copula(rank_pairs(s, d).withColumn("wet", F.col("u") > 0.3), wet_col="wet"), 5)
    q["select_copula"] = lambda s, d: r6(fit.select_copula(rank_pairs(s, d)), 5)
    q["select_copula_seasonal"] = lambda s, d: r6(fit.select_copula(rank_pairs(s, d), seasonal=True).withColumn("thetas", F.size("thetas")), 5)
    q["asymmetry_filter"] = lambda s, d: r6(fit.asymmetry_filter(rank_pairs(s, d)))
    q["independence_test"] = lambda s, d: r6(fit.independence_test(pr.kendall_tau(rank_pairs(s, d))))
    q["lagged_pair_fits"] = lambda s, d: r6(fit.lagged_pair_fits(line_ranks_long(s, d), 1), 5)
    q["fit_seasonal_copula"] = lambda s, d: r6(fit.fit_seasonal_copula(rank_pairs(s, d)), 5)
    q["smooth_doy"] = lambda s, d: r6(seasonal_fits(s, d)[1], 5)
    q["seasonal_quantiles"] = lambda s, d: r6(_with(seasonal_fits(s, d), fit.seasonal_quantiles).groupBy("station", "var_u", "var_v", "family", "rotation").agg(
        F.count("q_v").alias("n"), F.avg("q_v").alias("mean_q"), F.stddev_pop("q_v").alias("std_q")), 5)
    q["seasonal_loglik"] = lambda s, d: r6(_with(seasonal_fits(s, d), fit.seasonal_loglik), 3)
    q["seasonal_inverse"] = lambda s, d: r6(_seasonal_round_trip(s, d), 4)
    q["asymmetry_weighted_density"] = lambda s, d: r6(fit.asymmetry_weighted_density(
        rank_pairs(s, d).withColumn("density", cop.copula_density("plackett", F.col("u"), F.col("v"), 3.0))))
    q["copula_qq"] = lambda s, d: r6(fit.copula_qq(rank_pairs(s, d), fit.fit_copula(rank_pairs(s, d), [("plackett", 0)]), used=[("plackett", 0)]))
    # vines
    q["pair_edges"] = lambda s, d: r6(vine_candidates(s, d).select("station", "node_u", "node_v", "n", "tau", "weight"))
    q["cvine_root"] = lambda s, d: vn.cvine_root(vine_candidates(s, d), ["station"])
    q["rvine_tree"] = lambda s, d: r6(vn.rvine_tree(vine_candidates(s, d), ["station"]).select("station", "node_u", "node_v", "weight"))
    q["next_tree_edges"] = lambda s, d: vn.next_tree_edges(vn.rvine_tree(vine_candidates(s, d), ["station"]), ["station"]).select("station", "node_u", "node_v", F.array_join("cond", ",").alias("cond"))
    q["fit_cvine"] = lambda s, d: r6(_flat_vine(line_vine(s, d, "C")[1]), 4)
    q["fit_rvine_by_station"] = lambda s, d: r6(_flat_vine(line_vine(s, d, "R", "station")[1]), 4)
    q["fit_cvine_seasonal"] = lambda s, d: r6(_flat_vine(line_vine(s, d, "C", seasonal=True)[1]).withColumn("thetas", F.size("thetas")), 4)
    q["pair_edges_lagged"] = lambda s, d: r6(vn.pair_edges(line_ranks_long(s, d), VARIABLES, by=["station"], lag=1).select("station", "node_u", "node_v", "n", "tau", "weight"))
    q["cvine_root_lagged"] = lambda s, d: vn.cvine_root(vn.pair_edges(line_ranks_long(s, d), VARIABLES, by=["station"], lag=1), ["station"])
    q["vine_order"] = lambda s, d: vn.vine_order(given_vine(s, d, "C", True), ["station"])
    q["vine_order_rvine"] = lambda s, d: vn.vine_order(given_vine(s, d, "R", True), ["station"])
    q["vine_report"] = lambda s, d: vn.vine_report(given_vine(s, d, "R", True)).select("station", "tree", "line")
    q["pseudo_observations"] = lambda s, d: r6(first_tree(s, d))
    q["cvine_quantiles"] = lambda s, d: r6(given_quantiles(s, d, "C"))
    q["rvine_quantiles"] = lambda s, d: r6(given_quantiles(s, d, "R", "station"))
    q["cvine_inverse"] = lambda s, d: r6(given_inverse(s, d, "C"))
    q["cvine_inverse_stopped"] = lambda s, d: r6(given_inverse(s, d, "C", stop_at=2))
    q["rvine_inverse"] = lambda s, d: r6(given_inverse(s, d, "R", "station"))
    q["cvine_round_trip"] = lambda s, d: round_trip(s, d, "C")
    q["cvine_round_trip_seasonal"] = lambda s, d: round_trip(s, d, "C", seasonal=True)
    q["rvine_round_trip_by_station"] = lambda s, d: round_trip(s, d, "R", "station")
    q["vine_debias"] = lambda s, d: r6(vn.vine_debias(line_ranks_long(s, d), given_vine(s, d, "C", True), VARIABLES, "station"), 5)
    q["independence_check"] = lambda s, d: r6(vn.independence_check(given_quantiles(s, d, "C")), 5)
    # scenarios
    q["apply_scenario"] = lambda s, d: r6(sc.apply_scenario(daily(s, d), "price", 100.0, 50.0, 1000.0))
    q["site_increments"] = lambda s, d: r6(sc.site_increments(src.order_obs(s, d), src.stations(s, d).select("station", F.col("latitude").alias("increment"))))
    q["rank_space_shift"] = lambda s, d: r6(sc.rank_space_shift(ranks(s, d).filter("variable = 'quantity'").drop("value"), rk.ecdf_fit(daily(s, d)), 1.5, 2.0))
    q["intensify_masked_days"] = lambda s, d: r6(sc.intensify_masked_days(
        with_norm_ppf(ranks(s, d).filter("variable = 'price'"), "z", F.col("u")).drop("u"), hot_mask(s, d).filter("variable = 'price' AND mask"), 0.5))
    # ensembles
    q["compare_means"] = lambda s, d: ev.compare_means(daily(s, d), ens(s, d), 5)
    q["compare_means_all"] = lambda s, d: ev.compare_means(daily(s, d), ens(s, d), 5, "all")
    q["compare_means_both"] = lambda s, d: ev.compare_means(daily(s, d), ens(s, d), 8, "both")
    q["ensemble_stats"] = lambda s, d: r6(ev.ensemble_stats(ens(s, d), "std"), 5)
    q["ensemble_skewness"] = lambda s, d: r6(ev.ensemble_stats(ens(s, d), "skewness", by_realization=False), 5)
    q["meteogram_bands"] = lambda s, d: r6(ev.meteogram_bands(ens(s, d)))
    q["value_histogram"] = lambda s, d: r6(ev.value_histogram(ens(s, d), 40))
    q["qq_bands"] = lambda s, d: r6(ev.qq_bands(daily(s, d), ens(s, d)))
    q["exceedance_depth"] = lambda s, d: r6(ev.exceedance_depth(daily(s, d), ens(s, d), 0.02, "discount"))
    q["spell_lengths"] = lambda s, d: ev.spell_lengths(daily(s, d), 0.05, "discount")
    q["spell_bands"] = lambda s, d: r6(ev.spell_bands(daily(s, d), ens(s, d), 0.05, "discount"))
    q["monthly_means"] = lambda s, d: r6(ev.monthly_means(daily(s, d), ens(s, d)), 6, 3e-8)
    q["hyd_year_cdf_bands"] = lambda s, d: r6(ev.hyd_year_cdf_bands(daily(s, d), ens(s, d), full_years=False), 4, 3e-6)
    q["hyd_year_cdf"] = lambda s, d: r6(ev.hyd_year_cdf(daily(s, d), False), 3)
    q["annual_error"] = lambda s, d: r6(ev.annual_error(yearly(daily(s, d).filter("variable = 'discount'")), yearly(ens(s, d).filter("variable = 'discount'"))))
    q["check_means"] = lambda s, d: r6(ev.check_means(ens(s, d), daily(s, d)))
    q["check_correlations"] = lambda s, d: r6(ev.check_correlations(ens(s, d), daily(s, d)))
    q["check_structure"] = lambda s, d: ev.check_structure(daily(s, d)).groupBy("station", "variable").agg(F.count("*").alias("n"))
    q["per_realization"] = lambda s, d: r6(ev.per_realization(lambda t: pr.nan_corr(t, min_rows=30), ens(s, d), "month"))
    # heat waves
    q["heatwaves_hottest_n"] = lambda s, d: hw.heatwaves_hottest_n(daily(s, d))
    q["doy_threshold_window"] = lambda s, d: r6(hw.doy_threshold(daily(s, d), 0.9, 5))
    q["doy_threshold_realizations"] = lambda s, d: r6(hw.doy_threshold(ens(s, d), 0.9, over="realization"))
    q["heatwaves_zitis"] = lambda s, d: hw.heatwaves_zitis(daily(s, d), q=0.6, min_length=2)
    q["heatwaves_kuglitsch"] = lambda s, d: hw.heatwaves_kuglitsch(daily(s, d), q=0.6)
    q["islands"] = lambda s, d: hw.islands(hot_mask(s, d), "mask", 2)
    q["wave_mask"] = lambda s, d: r6(hw.wave_mask(hot_mask(s, d), "mask", 2))
    q["ensemble_member_heatwaves"] = lambda s, d: hw.ensemble_member_heatwaves(ens(s, d), ens(s, d), drop_variables=("tax", "discount"), q=0.6)
    q["heatwaves_by_year"] = lambda s, d: hw.heatwaves_by_year(hw.islands(hot_mask(s, d), "mask", 3), daily(s, d).select("station", "variable", F.year("time").alias("year")))
    # constraints
    q["yearly_bounds"] = lambda s, d: r6(cond.yearly_bounds(yearly(ens(s, d).filter("variable = 'quantity'")), 7000.0, 7500.0), 2)
    q["yearly_std"] = lambda s, d: r6(cond.yearly_std(yearly(daily(s, d).filter("variable = 'quantity'")), 100.0), 3)
    q["yearly_mean"] = lambda s, d: r6(cond.yearly_mean(yearly(daily(s, d).filter("variable = 'quantity'")), 8000.0, 8100.0))
    q["score_conditions"] = lambda s, d: r6(cond.score_conditions(ens(s, d), conditions(s, d), "quantity", full_years=False), 3)
    q["union_conditions"] = lambda s, d: r6(cond.union_conditions(conditions(s, d).filter("kind = 'std'"), conditions(s, d).filter("kind = 'mean'")), 4)
    q["accept_realizations"] = lambda s, d: cond.accept_realizations(ens(s, d), conditions(s, d).filter("kind = 'std'"), 15000.0, "quantity", full_years=False).groupBy("realization").agg(F.count("*").alias("n"))
    q["band_union"] = lambda s, d: r6(cond.band_union(conditions(s, d), _length(s, d)))
    q["default_bounds_from_obs"] = lambda s, d: r6(cond.default_bounds_from_obs(yearly(daily(s, d))), 4)
    return q


def _stored_ensemble(s, d):
    """Two ensembles written realization by realization, one of them twice; one read back in part."""
    root = shared_path(s, "ensembles")
    store.write_ensemble(ens(s, d), root, "base")
    store.write_ensemble(ens(s, d).withColumn("value", F.col("value") + 1), root, "warm")
    store.write_ensemble(ens(s, d).filter("realization = 2"), root, "base")
    return store.load_ensemble(s, root, "base", [0, 2, 5]).select("ensemble", "realization", "station", "variable", "time", "value")


def _stored_model(s, d):
    root, key = shared_path(s, "models"), store.model_key(variables=VARIABLES, weights="tau")
    edges = given_vine(s, d, "R", True).drop("thetas")
    store.save_model({"vine_edges": edges, "vine_order": vn.vine_order(edges, ["station"])}, root, key)
    store.save_model({"vine_edges": edges.limit(0), "vine_order": vn.vine_order(edges, ["station"]).limit(0)}, root, store.model_key(variables=VARIABLES[:2]))
    found = store.load_model(s, root, key)
    return _flat_vine(found["vine_edges"]).join(found["vine_order"], "station").filter("node_v = variable")


def _stored_observations(s, d):
    """A wide table, not a number where nothing was measured, read as the long one."""
    path = shared_path(s, "observations")
    rs.to_wide(gappy(s, d), VARIABLES).fillna(float("nan"), VARIABLES).write.parquet(path)
    return obs_io.read_observations(s, path, variables=VARIABLES)


def _stored_csv(s, d):
    path = shared_path(s, "csv")
    obs_io.write_station_csv(daily(s, d), path, VARIABLES, digits=6)
    found = s.read.option("header", True).option("inferSchema", True).csv(path)
    return found.select("station", F.col("time").cast("timestamp").alias("time"), *[F.round(F.col(v).cast("double"), 6).alias(v) for v in VARIABLES])


def _symmetry(pairs):
    """Largest break of both symmetries over the pairs, for each member, beside the flags."""
    u, v = F.col("u"), F.col("v")
    wide = []
    for n, r in CLOSED:
        c = lambda a, b: cop.copula_cdf(n, a, b, THETA[n], r)
        wide.append(F.max(F.abs(c(u, v) - (u + v - 1.0 + c(1.0 - u, 1.0 - v)))).alias(f"a_{n}_{r}"))
        wide.append(F.max(F.abs(c(u, v) - c(v, u))).alias(f"b_{n}_{r}"))
    one = pairs.agg(*wide)
    rows = F.array(*[F.struct(F.lit(n).alias("family"), F.lit(r).alias("rotation"), (F.col(f"a_{n}_{r}") < 1e-9).alias("seen1"), (F.col(f"b_{n}_{r}") < 1e-9).alias("seen2")) for n, r in CLOSED])
    flags = cop.symmetry_flags(pairs.sparkSession).drop("theta_start", "lo", "hi")
    return one.select(F.inline(rows)).join(flags, ["family", "rotation"])


def _length(s, d) -> int:
    return src.table(s, d, "lineitem").select(F.countDistinct("l_shipdate")).first()[0]


def _band(s, d):
    return tm.period_band(s, _length(s, d), 300.0, 800.0)


def _flat_report(report):
    return report.select(*[c for c in report.columns if c != "histogram"], F.inline("histogram"))


def _flat_vine(vine):
    return vine.withColumn("cond", F.array_join("cond", ","))


def _with(parts, operator):
    return operator(*parts)


def _with_vine(parts, operator):
    return operator(*parts, VARIABLES)


def _inverse_round_trip(pairs):
    rows = None
    for name, rotation in [("clayton", 0), ("plackett", 90), ("gumbel", 180), ("joe", 0), ("gaussian", 0), ("nelsen13", 270)]:
        u, v, k = F.col("u"), F.col("v"), THETA[name]
        there = pairs.withColumn("q", cop.h_v_given_u(name, u, v, k, rotation))
        back = there.withColumn("back", cop.h_inverse(name, u, F.col("q"), k, rotation))
        gap = F.max(F.abs(F.col("back") - v)).alias("max_gap")
        part = back.groupBy("station", "var_u", "var_v").agg(F.count("back").alias("n"), gap).withColumn("member", F.lit(f"{name}_{rotation}"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _seasonal_round_trip(s, d):
    """Largest change of the quantile on the way to v and back, for each pair and member."""
    pairs, fits = seasonal_fits(s, d)
    there = fit.seasonal_quantiles(pairs, fits).withColumnRenamed("q_v", "before").withColumn("q_v", F.col("before")).drop("u", "v", "theta", "doy")
    back = fit.seasonal_inverse(there, fits).drop("q_u", "q_v", "theta", "doy")
    again = fit.seasonal_quantiles(back, fits)
    gap = F.max(F.abs(F.col("q_v") - F.col("before"))).alias("max_gap")
    return again.groupBy("station", "var_u", "var_v", "family", "rotation").agg(F.count("v").alias("n"), gap)
