"""Seasonal copulas against a maximiser of each window, and the way there and back."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meteospan.functions import copula as C
from meteospan.operators import fit
from meteospan.operators.timeops import doy_targets


@pytest.fixture(scope="module")
def pairs(spark):
    """Dependence that changes over the year, one group with dry rows."""
    rng = np.random.default_rng(1)
    time = pd.date_range("2000-01-01", periods=3 * 366)
    rho = 0.5 + 0.35 * np.cos(2 * np.pi * time.dayofyear / 366)
    rows = []
    for station in ("a", "b"):
        u, q = rng.random(len(time)), rng.random(len(time))
        v = C.h_inverse_array("gaussian", u, q, rho)
        rows.append(pd.DataFrame({"station": station, "var_u": "R", "var_v": "T", "time": time, "u": u, "v": v, "wet": u > (0.0 if station == "a" else 0.4)}))
    frame = pd.concat(rows)
    frame.loc[(frame.station == "b") & (frame.time.dt.dayofyear.between(100, 160)), "wet"] = False
    return frame, spark.createDataFrame(frame).cache()


def best_theta(f, rotation, u, v, extra=None):
    """Maximum of the log-likelihood by a fine grid and golden sections."""
    a, b = C.turned(C.clamp(u), C.clamp(v), rotation)

    def ll(theta):
        with np.errstate(all="ignore"):
            d = f.density(a, b, theta)
        d = np.where((d > 0) & np.isfinite(d), d, fit.FIT_FLOOR)
        return float(np.log(d).sum()) + (extra(theta) if extra else 0.0)

    grid = fit._first_grid(f.name, 400)
    i = int(np.argmax([ll(x) for x in grid]))
    lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, d) if ll(c) > ll(d) else (c, hi)
    return (lo + hi) / 2


def test_window_table_is_that_of_the_days(spark):
    for w in (3, 15, 40):
        rows = spark.range(1, 367).select(F.col("id").cast("int").alias("x")).select("x", doy_targets("x", w).alias("d")).collect()
        table = fit.window_table(w)
        assert all({i + 1 for i in np.flatnonzero(table[:, r.x - 1])} == set(r.d) for r in rows)


def test_theta_of_every_window_is_the_maximum(pairs):
    frame, df = pairs
    members = [("gaussian", 0), ("plackett", 0), ("gumbel", 180), ("nelsen13", 0)]
    found = fit.fit_seasonal_copula(df, members, w=15).toPandas()
    assert len(found) == 2 * 4 * 366 and not found.rejected.any()
    holds = fit.window_table(15)
    one = frame[frame.station == "a"]
    doy = one.time.dt.dayofyear.to_numpy()
    for (name, rotation) in members:
        part = found[(found.station == "a") & (found.family == name) & (found.rotation == rotation)].set_index("doy").theta
        for day in (1, 9, 100, 200, 300, 355, 366):
            at = holds[day - 1][doy - 1]
            u, v = one.u.to_numpy()[at], one.v.to_numpy()[at]
            want = best_theta(C.FAMILIES[name], rotation, u, v)
            # the difference has to be small beside what the window can tell about θ
            a, b = C.turned(u, v, rotation)
            ll = lambda t: np.log(C.FAMILIES[name].density(a, b, t)).sum()
            assert ll(want) - ll(part[day]) < 0.02, (name, day, want, part[day])


def test_dry_rows_count_by_their_corner(pairs):
    frame, df = pairs
    found = fit.fit_seasonal_copula(df, [("gaussian", 0)], w=15, wet_col="wet").filter("station = 'b'").toPandas().set_index("doy").theta
    one, holds = frame[frame.station == "b"], fit.window_table(15)
    doy, wet = one.time.dt.dayofyear.to_numpy(), one.wet.to_numpy()
    f, nulls = C.FAMILIES["gaussian"], 0
    for day in range(1, 367, 15):
        at = holds[day - 1][doy - 1]
        if wet[at].mean() < 0.05:
            assert np.isnan(found[day])
            nulls += 1
            continue
        u, v = one.u.to_numpy()[at & wet], one.v.to_numpy()[at & wet]
        u_max, v_max = one.u.to_numpy()[at & ~wet].max(), one.v.to_numpy()[at & ~wet].max()
        corner = (fit.ONEISH, v_max) if u_max > v_max else (u_max, fit.ONEISH)
        n_dry = int((at & ~wet).sum())
        extra = lambda t: n_dry * math.log(max(float(f.cdf(np.array(corner[0]), np.array(corner[1]), t)), 1e-300))
        assert abs(found[day] - best_theta(f, 0, u, v, extra)) < 0.01
    assert nulls >= 2
    smooth = fit.smooth_doy(fit.fit_seasonal_copula(df, [("gaussian", 0)], wet_col="wet")).filter("theta IS NULL").count()
    assert smooth == 0


def test_member_with_most_days_at_a_bound_is_rejected(spark):
    time = pd.date_range("2001-01-01", periods=365)
    u = np.random.default_rng(2).random(365)
    df = spark.createDataFrame(pd.DataFrame({"station": "s", "time": time, "u": u, "v": 1 - u}))
    found = fit.fit_seasonal_copula(df, [("gumbel", 0), ("gumbel", 90)], keys=["station"])
    assert {(r.rotation, r.rejected) for r in found.select("rotation", "rejected").distinct().collect()} >= {(0, True)}
    assert fit.smooth_doy(found, keys=["station"]).filter("rotation = 0").count() == 0


def test_blocks_of_a_day_add_up(pairs, monkeypatch):
    _, df = pairs
    member = [("plackett", 0), ("clayton", 90)]
    whole = fit.fit_seasonal_copula(df, member, wet_col="wet").toPandas()
    monkeypatch.setattr(fit, "PACK", 2)
    parts = fit.fit_seasonal_copula(df, member, wet_col="wet").toPandas()
    by = ["station", "family", "rotation", "doy"]
    a, b = (x.sort_values(by).theta.to_numpy() for x in (whole, parts))
    np.testing.assert_allclose(a, b, rtol=1e-7)


def test_seasonal_way_there_and_back(pairs):
    frame, df = pairs
    fits = fit.smooth_doy(fit.fit_seasonal_copula(df, [("gaussian", 0), ("plackett", 0), ("gumbel", 180)]))
    there = fit.seasonal_quantiles(df, fits)
    assert there.count() == 3 * len(frame)
    back = fit.seasonal_inverse(there.withColumnRenamed("v", "before").drop("u", "theta", "doy"), fits)
    gap = back.select(F.max(F.abs(F.col("v") - F.col("before"))), F.count("v")).first()
    assert gap[0] < 1e-6 and gap[1] == 3 * len(frame)
    # the right family makes uniforms of v
    q = np.sort(there.filter("family = 'gaussian' AND station = 'a'").toPandas().q_v)
    assert np.abs(q - (np.arange(len(q)) + 0.5) / len(q)).max() < 0.05


def test_smooth_fills_around_the_year_and_keeps_low_harmonics(spark):
    doy = np.arange(1, 367)
    theta = 3.0 + np.cos(2 * np.pi * (doy - 1) / 366 * 2) + 0.5 * np.sin(2 * np.pi * (doy - 1) / 366 * 30)
    df = spark.createDataFrame(pd.DataFrame({"station": "s", "family": "plackett", "rotation": 0, "doy": doy, "theta": theta}))
    smooth = fit.smooth_doy(df, 4, ["station"]).toPandas().sort_values("doy").theta
    np.testing.assert_allclose(smooth, 3.0 + np.cos(2 * np.pi * (doy - 1) / 366 * 2), atol=1e-9)
    holes = df.withColumn("theta", F.when(~F.col("doy").isin(1, 2, 366), F.lit(2.5)))
    assert fit.smooth_doy(holes, 4, ["station"]).filter("abs(theta - 2.5) > 1e-9").count() == 0


@pytest.mark.parametrize("given", ["u", "v"])
def test_inverse_of_every_member(given):
    rng = np.random.default_rng(3)
    u, q = rng.random(4000), rng.random(4000)
    for name, rotation in C.members():
        theta = C.FAMILIES[name].start
        x = C.h_inverse_array(name, u, q, theta, rotation, given)
        back = C.h_array(name, *((u, x) if given == "u" else (x, u)), theta, rotation, given)
        assert np.abs(back - q).max() < 1e-9, name
