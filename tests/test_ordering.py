import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meteospan.operators import ensemble, ordering, pairs, ranks, timeops


def test_quantiles_equal_numpy(series):
    frame, df = series
    levels = [0.0, 0.1, 0.35, 0.5, 0.99, 1.0]
    got = ordering.exact_quantiles(df, ["station", "variable"], "value", levels).toPandas()
    for (s, v), part in frame.dropna().groupby(["station", "variable"]):
        mine = got[(got.station == s) & (got.variable == v)].sort_values("level_id")
        np.testing.assert_allclose(mine["quantile"], np.quantile(part.value, levels), atol=1e-12)


def test_regular_quantiles_equal_numpy(series):
    frame, df = series
    got = ordering.regular_quantiles(
        df, ["variable"], "value", F.lit(0.0), F.lit(1.0 / 49), F.lit(50)
    ).toPandas()
    for v, part in frame.dropna().groupby("variable"):
        mine = got[got.variable == v].sort_values("level_id")
        assert len(mine) == 50
        np.testing.assert_allclose(mine["quantile"], np.quantile(part.value, np.linspace(0, 1, 50)), atol=1e-9)


def test_ranks_and_interpolation(series):
    frame, df = series
    got = ranks.rel_ranks(df).toPandas().sort_values(["station", "variable", "time"])
    want = frame.groupby(["station", "variable"]).value.transform(
        lambda x: (x.rank() - 0.5) / x.count()
    )
    np.testing.assert_allclose(got.u.to_numpy(float), want.to_numpy(float), atol=1e-12)
    filled = timeops.interpolate_time(df).toPandas().sort_values(["station", "variable", "time"])
    want = frame.groupby(["station", "variable"]).value.transform(
        lambda x: x.interpolate(limit_area="inside")
    )
    np.testing.assert_allclose(filled.value.to_numpy(float), want.to_numpy(float), atol=1e-9)


def test_halo_window_equals_plain_rolling(spark, series):
    frame, df = series
    df = timeops.fill_edges(timeops.interpolate_time(df))
    rows = ordering.with_position(df, ["station", "variable"])
    small = ordering.with_halo(
        rows, ["station", "variable"], 3, 2,
        {"s": lambda w: F.sum("value").over(w.rowsBetween(-3, 2))}, size=4,
    ).toPandas().sort_values(["station", "variable", "time"])
    values = df.toPandas().sort_values(["station", "variable", "time"])
    want = values.groupby(["station", "variable"]).value.transform(
        lambda x: pd.concat([x.shift(k) for k in range(-2, 4)], axis=1).sum(axis=1)
    )
    np.testing.assert_allclose(small.s, want, atol=1e-9)


def test_tau_and_dominance_with_ties(spark):
    rng = np.random.default_rng(1)
    x, y, z = (rng.integers(0, 12, 300).astype(float) for _ in range(3))
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "u": x, "v": y, "w": z}))
    n = len(x)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
    tie = lambda a: sum(c * (c - 1) / 2 for c in np.unique(a, return_counts=True)[1])
    n0 = n * (n - 1) / 2
    want = s / np.sqrt((n0 - tie(x)) * (n0 - tie(y)))
    assert abs(pairs.kendall_tau(df, []).first().tau - want) < 1e-12
    got = ranks.nonexceedance(df, ["u", "v", "w"]).toPandas().sort_values("id")
    brute = [((x < x[i]) & (y < y[i]) & (z < z[i])).mean() for i in range(n)]
    np.testing.assert_allclose(got.nonexceedance, brute, atol=1e-12)
    got = ranks.bipit(df).toPandas().sort_values("id")
    brute = [(((x < x[i]) & (y < y[i])).sum() + 0.5) / n for i in range(n)]
    np.testing.assert_allclose(got.bipit, brute, atol=1e-12)


def test_spells_and_hyd_years(spark):
    times = pd.date_range("2000-09-28", "2001-10-02", freq="D")
    frame = pd.DataFrame({"station": "a", "variable": "R", "time": times, "value": 1.0})
    frame.loc[10:12, "value"] = 0.0
    df = spark.createDataFrame(frame)
    full = timeops.hyd_year_sums(df, True).toPandas()
    assert full.hyd_year.tolist() == [2001] and full.total.tolist() == [362.0]
    spells = ensemble.spell_lengths(df, 0.5).toPandas().sort_values("begin")
    assert spells.length.tolist() == [10, 3, len(times) - 13]


def test_empty_and_single_rows(spark):
    empty = spark.createDataFrame([], "station string, variable string, time timestamp, value double")
    assert ranks.rel_ranks(empty).count() == 0
    assert timeops.interpolate_time(empty).count() == 0
    one = spark.sql("SELECT 'a' station, 'x' variable, timestamp'2000-12-31' time, 2.5D value")
    assert ranks.rel_ranks(one).first().u == 0.5
    assert ordering.exact_quantiles(one, ["station"], "value", [0.3]).first()["quantile"] == 2.5


def test_plans_have_no_python_and_no_series_window(series):
    _, df = series
    plan = timeops.interpolate_time(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
