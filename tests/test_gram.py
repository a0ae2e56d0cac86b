"""Moments of pairs from blocked matrices against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meteospan.operators import gram, pairs


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    time = list(pd.date_range("2000-01-15", periods=130).to_pydatetime())
    rows = []
    for group in ("g", "h"):
        base = rng.normal(1e6, 1.0, len(time))
        for i in range(7):
            x = base + rng.normal(0, 1 + i, len(time))
            for t, v in zip(time, x):
                if rng.random() < 0.9:  # some rows are missing, some are null or not a number
                    rows.append((group, f"s{i}", t, None if rng.random() < 0.05 else float("nan") if rng.random() < 0.05 else float(v)))
    rows += [(group, "constant", t, 3.3) for group in ("g", "h") for t in time] + [("g", "never", t, None) for t in time[:5]] + [("h", None, time[0], 1.0)]
    frame = pd.DataFrame(rows, columns=["variable", "station", "time", "value"])
    return frame, spark.createDataFrame(rows, "variable string, station string, time timestamp, value double")


def wide(frame, group):
    part = frame[(frame.variable == group) & frame.station.notna()]
    return part.assign(value=part.value.astype(float)).pivot(index="time", columns="station", values="value")


@pytest.mark.parametrize("labels", [64, 3])
def test_correlations(table, monkeypatch, labels):
    monkeypatch.setattr(gram, "LABELS", labels)
    monkeypatch.setattr(gram, "HELD", 1000)
    frame, df = table
    got = {(r.variable, r.station_i, r.station_j): r for r in pairs.nan_corr(df, ("station",), ["variable"]).collect()}
    n = 0
    for group in ("g", "h"):
        w = wide(frame, group)
        here = frame[(frame.variable == group)].pivot_table(index="time", columns="station", values="variable", aggfunc="size", dropna=True)
        for i, a in enumerate(w.columns):
            for b in w.columns[i + 1 :]:
                r = got[group, a, b]
                both = w[[a, b]].dropna()
                rows = (here[a].notna() & here[b].notna()).sum()
                assert r.n == len(both) and r.overlap == pytest.approx(len(both) / rows)
                if "constant" in (a, b) or len(both) < 2:
                    assert r["corr"] is None
                else:
                    assert r["corr"] == pytest.approx(both[a].corr(both[b]), abs=1e-9)
                n += 1
    assert n + len([k for k in got if None in k]) == len(got)


@pytest.mark.parametrize("stretch", [4096, 10])
def test_lagged_moments(table, monkeypatch, stretch):
    monkeypatch.setattr(gram, "STRETCH", stretch)
    monkeypatch.setattr(gram, "LABELS", 4)
    frame, df = table
    got = {(r.variable, r.station_i, r.station_j, r.lag): r for r in pairs.cross_corr(df.filter("station <> 'never'"), 4, "station").collect()}
    for group in ("g", "h"):
        w = wide(frame, group).drop(columns="never", errors="ignore")
        for a in w.columns:
            for b in w.columns:
                for lag in range(4):
                    x, y = w[a].to_numpy()[: len(w) - lag], w[b].to_numpy()[lag:]
                    good = np.isfinite(x) & np.isfinite(y)
                    r = got[group, a, b, lag]
                    assert r.n == good.sum()
                    if "constant" not in (a, b):
                        cov = ((x - w[a].mean()) * (y - w[b].mean()))[good].sum() / (good.sum() - 1)
                        assert r["corr"] == pytest.approx(cov / w[a].std(ddof=0) / w[b].std(ddof=0), abs=1e-8)


def test_given_means(table):
    frame, df = table
    means = df.select("station").distinct().withColumn("mean", F.lit(5.0))
    (r,) = pairs.cross_cov(df, 1, means, "station").filter("variable = 'g' AND station_i = 's1' AND station_j = 's2'").collect()
    w = wide(frame, "g")
    x, y = w.s1.to_numpy()[:-1], w.s2.to_numpy()[1:]
    good = np.isfinite(x) & np.isfinite(y)
    assert r["cov"] == pytest.approx(((x - 5) * (y - 5))[good].mean(), rel=1e-9)
