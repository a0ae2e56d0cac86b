"""Faults that were found once and must not come back."""

from datetime import datetime

import pandas as pd
import pytest

from meteospan.functions.copula import copula_cdf, members, symmetry_flags
from meteospan.operators import conditions, ensemble, heatwaves, pairs, reshape, timeops
from meteospan.sources import ensemble_store

SERIES = "station string, variable string, time timestamp, value double"


def series(spark, days, values, variable="R", **more):
    frame = pd.DataFrame({"station": "a", "variable": variable, "time": pd.to_datetime(days), "value": values, **more})
    return spark.createDataFrame(frame, SERIES + "".join(f", {k} int" for k in more))


def test_a_missing_day_ends_a_run(spark):
    df = series(spark, ["2000-06-01", "2000-06-02", "2000-08-20", "2000-08-21", "2000-08-22"], [9.0] * 5)
    hot = df.selectExpr("station", "variable", "time", "value > 5 AS mask")
    assert [r.days for r in heatwaves.islands(hot, "mask", 2).orderBy("begin").collect()] == [2, 3]
    assert heatwaves.islands(hot, "mask", 3).count() == 1
    assert heatwaves.wave_mask(hot, "mask", 3).filter("mask").count() == 3
    assert sorted(r.length for r in ensemble.spell_lengths(df, 5.0).collect()) == [2, 3]


def test_a_bridge_spans_one_day_only(spark):
    df = series(spark, ["2000-06-01", "2000-06-02", "2000-06-03", "2000-06-10", "2000-06-12", "2000-06-13"], [9, 1, 9, 9, 1, 9.0])
    out = heatwaves.bridge(df.selectExpr("station", "variable", "time", "value > 5 AS mask"), "mask").orderBy("time").collect()
    assert [r.mask for r in out] == [True, True, True, True, False, True]


def test_unscored_realizations_are_not_accepted(spark):
    full = series(spark, pd.date_range("1999-10-01", "2001-09-30"), 1.0, realization=1)
    part = series(spark, pd.date_range("2000-01-01", periods=200), 1.0, realization=2)
    rows = [("sum", "a", "bounds", 300.0, 400.0, None, None)]
    bounds = spark.createDataFrame(rows, "name string, station string, kind string, lower double, upper double, lower_period double, upper_period double")
    both = full.union(part)
    assert {r.realization for r in conditions.accept_realizations(both, bounds).select("realization").distinct().collect()} == {1}
    assert [r.realization for r in conditions.unscored_realizations(both, bounds).collect()] == [2]


def test_all_realizations_count_by_default(spark):
    obs = series(spark, ["2000-01-01"], [1.0])
    ens = series(spark, ["2000-01-01"] * 150, [0.0] * 100 + [3.0] * 50, realization=list(range(150)))
    assert ensemble.compare_means(obs, ens).first().sim == 1.0
    assert ensemble.compare_means(obs, ens, 100).first().sim == 0.0


def test_writing_a_realization_twice_keeps_one(spark, tmp_path):
    one = series(spark, pd.date_range("2000-01-01", periods=10), 1.0, realization=0)
    two = series(spark, pd.date_range("2000-01-01", periods=10), 2.0, realization=1)
    for df in (one, two, one):
        ensemble_store.write_ensemble(df, str(tmp_path / "e"), "x")
    assert ensemble_store.load_ensemble(spark, str(tmp_path / "e"), "x").count() == 20


def test_no_keys(spark):
    df = spark.createDataFrame([(datetime(2000, 1, d), v) for d, v in ((1, None), (2, 1.0), (3, 2.0), (4, 3.0))], "time timestamp, value double")
    out = timeops.interpolate_time(df, extrapolate=True, keys=[]).orderBy("time").collect()
    assert [r.value for r in out] == [0.0, 1.0, 2.0, 3.0]
    uv = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "u double, v double")
    assert pairs.kendall_tau(uv, []).first().tau == 1.0


def test_missing_report_names_the_series(spark):
    df = series(spark, ["2000-01-01", "2000-01-02"], [1.0, None]).union(series(spark, ["2000-01-01"], [None], "T"))
    assert timeops.missing_series(df).count() == 1
    with pytest.raises(Exception, match="a, (T|R)"):
        timeops.missing_report(df, fail=True).collect()


def test_overlay_has_the_union_of_times(spark):
    daily = series(spark, ["2000-01-01"], [1.0]).union(series(spark, ["2000-01-01"], [5.0], "T"))
    hourly = series(spark, ["2000-01-01", "2000-01-02"], [2.0, 3.0])
    got = {(r.variable, r.time.day): r.value for r in reshape.overlay(daily, hourly, ["R"]).collect()}
    assert got == {("R", 1): 2.0, ("R", 2): 3.0, ("T", 1): 5.0, ("T", 2): None}


def test_symmetry_flag_is_that_of_the_function(spark):
    flags = {(r.family, r.rotation): (r.symmetry2, r.theta_start) for r in symmetry_flags(spark).collect()}
    points = spark.createDataFrame([(u, v) for u in (0.1, 0.35, 0.7) for v in (0.2, 0.5, 0.9)], "u double, v double")
    for name, degrees in members():
        flag, theta = flags[name, degrees]
        gap = copula_cdf(name, points.u, points.v, theta, degrees) - copula_cdf(name, points.v, points.u, theta, degrees)
        widest = points.select(gap.alias("g")).selectExpr("max(abs(g)) AS g").first().g
        assert (widest < 1e-9) == flag, (name, degrees, widest)
