import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meteospan.functions import copula as C
from meteospan.functions.normal import norm_ppf_array, with_norm_cdf, with_norm_ppf
from meteospan.operators import fit


def test_thirty_six_members():
    assert len(C.members()) == 36


def test_normal_functions(spark):
    p = np.concatenate([np.linspace(0.0005, 0.9995, 301), [1e-9, 1 - 1e-9]])
    df = spark.createDataFrame(pd.DataFrame({"p": p}))
    out = with_norm_cdf(with_norm_ppf(df, "z", F.col("p")), "back", F.col("z")).toPandas()
    want = [NormalDist().inv_cdf(x) for x in out.p]
    np.testing.assert_allclose(out.z, want, atol=1e-9)
    np.testing.assert_allclose(out.back, out.p, atol=1e-12)
    np.testing.assert_allclose(norm_ppf_array(out.p), want, atol=1e-9)
    assert math.isclose(NormalDist().cdf(0.7), 0.5 * math.erfc(-0.7 / math.sqrt(2)))


@pytest.mark.parametrize("name,rotation", [m for m in C.members() if m[0] != "independence"])
def test_array_formulas_are_consistent(name, rotation):
    """cdf, h and density agree with one another (numpy arrays, the form used in fitting)."""
    f, e = C.FAMILIES[name], 1e-4
    theta = np.float64(f.start)
    u, v = (x.ravel() for x in np.meshgrid(np.linspace(0.1, 0.9, 9), np.linspace(0.1, 0.9, 9)))
    cdf = C.rotate(lambda a, b: f.cdf(a, b, theta), rotation)
    density = f.density(*C.turned(u, v, rotation), theta)
    mixed = (cdf(u + e, v + e) - cdf(u + e, v - e) - cdf(u - e, v + e) + cdf(u - e, v - e)) / (4 * e * e)
    np.testing.assert_allclose(density, mixed, rtol=2e-3, atol=2e-3)
    assert np.all(density > 0)


def test_columns_equal_arrays_and_inverse(spark):
    u, v = (x.ravel() for x in np.meshgrid(np.linspace(0.05, 0.95, 7), np.linspace(0.05, 0.95, 7)))
    df = spark.createDataFrame(pd.DataFrame({"u": u, "v": v})).cache()
    for name, rotation in [("clayton", 90), ("gaussian", 0), ("gumbel", 180), ("joe", 0), ("nelsen12", 270), ("plackett", 0)]:
        f, a, b = C.FAMILIES[name], F.col("u"), F.col("v")
        out = (
            df.withColumn("q", C.h_v_given_u(name, a, b, f.start, rotation))
            .withColumn("p", C.h_u_given_v(name, a, b, f.start, rotation))
            .withColumn("c", C.copula_cdf(name, a, b, f.start, rotation))
            .withColumn("v2", C.h_inverse(name, a, F.col("q"), f.start, rotation))
            .withColumn("u2", C.h_inverse(name, b, F.col("p"), f.start, rotation, given="v"))
            .toPandas()
        )
        cdf = C.rotate(lambda x, y: f.cdf(x, y, np.float64(f.start)), rotation)
        np.testing.assert_allclose(out.c, cdf(out.u.to_numpy(), out.v.to_numpy()), atol=1e-9)
        np.testing.assert_allclose(out.v2, out.v, atol=1e-4)
        np.testing.assert_allclose(out.u2, out.u, atol=1e-4)


def test_fit_recovers_theta(spark):
    rng = np.random.default_rng(5)
    u, q = rng.random(6000), rng.random(6000)
    df = spark.createDataFrame(pd.DataFrame({"u": u, "q": q}))
    pairs = None
    for name, rotation, theta in [("plackett", 0, 4.0), ("gumbel", 90, 1.8), ("gaussian", 0, -0.5)]:
        part = df.withColumn("v", C.h_inverse(name, F.col("u"), F.col("q"), theta, rotation)).select(
            F.lit(name).alias("station"), "u", "v"
        )
        pairs = part if pairs is None else pairs.unionByName(part)
    best = fit.select_copula(pairs, ["station"], ["plackett", "gumbel", "gaussian"]).toPandas().set_index("station")
    found = best.loc["plackett"]
    # turned by 90 degrees it is the same family with 1/θ
    theta = found.theta if found.rotation in (0, 180) else 1.0 / found.theta
    assert found.family == "plackett" and abs(theta - 4.0) < 0.4
    assert best.loc["gumbel", "family"] == "gumbel" and best.loc["gumbel", "rotation"] == 90
    assert abs(best.loc["gumbel", "theta"] - 1.8) < 0.1
    assert abs(best.loc["gaussian", "theta"] + 0.5) < 0.05


def test_blocks_do_not_change_the_fit(spark, monkeypatch):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"u": rng.random(500), "v": rng.random(500)})
    frame["wet"] = frame.u > 0.2
    pairs = spark.createDataFrame(frame)
    whole = fit.fit_copula(pairs, ["clayton", "joe"], [], "wet").toPandas().sort_values(["family", "rotation"])
    monkeypatch.setattr(fit, "PACK", 40)
    parts = fit.fit_copula(pairs, ["clayton", "joe"], [], "wet").toPandas().sort_values(["family", "rotation"])
    np.testing.assert_allclose(whole.theta, parts.theta, rtol=1e-6)
    np.testing.assert_allclose(whole.loglik, parts.loglik, rtol=1e-6, atol=1e-6)


def test_member_that_does_not_converge_on_wet_rows_is_fitted_to_all(spark):
    """Group a: the wet rows drive Gumbel to its bound, all rows do not. Group b: both converge. Group c: no wet row."""
    rng = np.random.default_rng(8)
    u, q = rng.random(900), rng.random(900)
    v = C.h_inverse_array("gumbel", u, q, 2.0)
    dry = u < 0.3
    rows = []
    for group in "abc":
        y = np.where(dry | (group != "a"), v, (1.3 - u).clip(1e-3, 1 - 1e-3) * 0.99 if group == "a" else v)
        rows.append(pd.DataFrame({"station": group, "u": u, "v": y, "wet": ~dry if group != "c" else False}))
    frame = pd.concat(rows)
    got = fit.fit_copula(spark.createDataFrame(frame), ["gumbel", "joe"], ["station"], "wet").toPandas().set_index(["station", "family", "rotation"])
    plain = fit.fit_copula(spark.createDataFrame(frame), ["gumbel", "joe"], ["station"]).toPandas().set_index(["station", "family", "rotation"])
    assert not got.loc["c"].masked.any()
    np.testing.assert_allclose(got.loc["c"].theta, plain.loc["c"].theta.reindex(got.loc["c"].index), rtol=1e-6)
    assert got.loc[("b", "gumbel", 0)].masked and abs(got.loc[("b", "gumbel", 0)].theta - 2.0) < 0.25
    failed = got.loc[("a", "gumbel", 0)]
    assert not failed.masked and failed.theta == pytest.approx(plain.loc[("a", "gumbel", 0)].theta, rel=1e-6)
    # the masked maximum of group b against a fine grid, corner of the dry rows included
    part = frame[frame.station == "b"]
    wet = part.wet.to_numpy()
    f, x, y = C.FAMILIES["gumbel"], part.u.to_numpy(), part.v.to_numpy()
    u_max, v_max = x[~wet].max(), y[~wet].max()
    corner = (fit.ONEISH, v_max) if u_max > v_max else (u_max, fit.ONEISH)
    ll = lambda t: np.log(f.density(x[wet], y[wet], t)).sum() + (~wet).sum() * math.log(f.cdf(np.float64(corner[0]), np.float64(corner[1]), t))
    grid = np.linspace(1.2, 4, 3000)
    best = grid[np.argmax([ll(t) for t in grid])]
    assert got.loc[("b", "gumbel", 0)].theta == pytest.approx(best, abs=0.01)


@pytest.mark.parametrize("name, rotation", [m for m in C.members() if m[0] != "independence"])
def test_fit_recovers_theta_of_every_member(spark, name, rotation):
    """Own rows of each member, made once for all of them: the fit is likelier than the θ the rows were made with, and no further
    from it than chance allows."""
    found, true, u, v = recovered(spark)[name, rotation]
    a, b = C.turned(C.clamp(u), C.clamp(v), rotation)
    ll = lambda theta: np.log(C.FAMILIES[name].density(a, b, theta)).sum()
    assert -1e-3 < ll(found) - ll(true) < 8.0


_FITTED: dict = {}


def recovered(spark):
    if not _FITTED:
        rng = np.random.default_rng(9)
        parts, want = [], {}
        for name, rotation in C.members():
            if name == "independence":
                continue
            f = C.FAMILIES[name]
            theta = {"joe": 2.5, "gaussian": 0.6, "plackett": 5.0, "nelsen13": 3.0, "gumbel": 2.0, "nelsen14": 2.0, "nelsen12": 2.0}.get(name, 0.5 * (f.lo + f.hi))
            u, q = rng.random((2, 4000))
            v = C.h_inverse_array(name, u, q, theta, rotation)
            parts.append(pd.DataFrame({"station": f"{name}_{rotation}", "u": u, "v": v}))
            want[name, rotation] = (theta, u, v)
        df = spark.createDataFrame(pd.concat(parts)).cache()
        found = fit.fit_copula(df, None, ["station"]).filter(F.concat_ws("_", "family", "rotation") == F.col("station"))
        for r in found.collect():
            _FITTED[r.family, r.rotation] = (r.theta, *want[r.family, r.rotation])
    return _FITTED
