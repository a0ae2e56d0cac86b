"""Fits do not depend on the blocks of a group, and a group is not gathered in one task."""

import numpy as np
import pandas as pd

from meteospan.operators import fit


def test_blocks_of_a_group_stay_apart(spark, monkeypatch):
    rng = np.random.default_rng(5)
    u = rng.random(600)
    v = np.clip(0.6 * u + 0.4 * rng.random(600), 0.01, 0.99)
    frame = pd.DataFrame({"key": ["a"] * 500 + ["b"] * 100, "u": u, "v": v})
    df = spark.createDataFrame(frame)
    members = [("plackett", 0), ("clayton", 0)]
    want = {(r.key, r.family): r for r in fit.fit_copula(df, members, ["key"]).collect()}
    monkeypatch.setattr(fit, "PACK", 40)
    found = fit.fit_copula(df, members, ["key"]).collect()
    assert len(found) == len(want) == 4
    for r in found:
        other = want[r.key, r.family]
        assert r.n == other.n and abs(r.theta - other.theta) < 1e-9 and abs(r.loglik - other.loglik) < 1e-6
    packed = fit._packed(df, ["key"], None)
    assert packed.filter("key = 'a'").count() == 13 and packed.filter("key = 'b'").count() == 3
    around = fit._brackets(fit._grid_sums(packed, ["key"], members, 16, fit.FIT_FLOOR, False), ["key"])
    rows = fit._attach_brackets(packed, around, ["key"])
    join = next(line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    assert rows.count() == 16 and "_block" in join
