"""Discordant pairs and ties against all pairs."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from meteospan.operators import inversions, pairs, ranks


def brute(x, y, w):
    dx, dy, ww = np.sign(x[:, None] - x), np.sign(y[:, None] - y), w[:, None] * w
    d = (ww * (dx * dy < 0)).sum() / 2
    ties = lambda z: sum(t * (t - 1) / 2 for t in pd.Series(w).groupby(z).sum())
    both = (w * (w - 1) / 2).sum()
    return w.sum(), ties(x), ties(y), both, d


def test_inversions_of_arrays():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 200):
        x, y, w = rng.integers(0, 20, n).astype(float), rng.integers(0, 15, n).astype(float), rng.integers(1, 5, n).astype(float)
        assert inversions.inversions(x, y, w) == brute(x, y, w)[4]


@pytest.mark.parametrize("cells, blocks", [(1 << 16, 512), (20, 512), (7, 6)])
def test_counts_in_blocks(spark, monkeypatch, cells, blocks):
    monkeypatch.setattr(inversions, "CELLS", cells)
    monkeypatch.setattr(inversions, "BLOCKS", blocks)
    rng = np.random.default_rng(2)
    rows = []
    for key in "abc":
        x = rng.normal(size=300).round(1 if key == "b" else 6)
        y = (0.5 * x + rng.normal(size=300)).round(1)
        x[rng.random(300) < 0.4] = 0.25  # a value with a large share of all rows
        frame = pd.DataFrame({"key": key, "x": x, "y": y}).groupby(["key", "x", "y"]).size().rename("w").reset_index()
        rows.append(frame)
    frame = pd.concat(rows)
    found = inversions.tie_and_pair_counts(spark.createDataFrame(frame), ["key"], "x", "y", "w").collect()
    for r in found:
        part = frame[frame.key == r.key]
        assert (r.n, r.n1, r.n2, r.n3, r.d) == brute(part.x.to_numpy(), part.y.to_numpy(), part.w.to_numpy(float))
    assert len(found) == 3


def test_kendall_without_keys_and_with_constants(spark):
    df = spark.createDataFrame([(float(i), float(-i)) for i in range(50)] + [(None, 1.0), (1.0, float("nan"))], "u double, v double")
    (r,) = pairs.kendall_tau(df, []).collect()
    assert (r.n, r.tau) == (50, -1.0)
    (r,) = pairs.kendall_tau(df.selectExpr("u", "1.0D AS v"), []).collect()
    assert r.tau is None
    assert pairs.kendall_tau(df.limit(0), []).count() in (0, 1)


def test_blocks_do_not_follow_the_groups(spark, monkeypatch):
    """Cells are placed where they are; a shuffle by group would put all of them into one task."""
    monkeypatch.setattr(inversions, "CELLS", 100)
    seen = []
    monkeypatch.setattr(inversions, "cut_lineage", lambda df: seen.append(df) or df)
    cells = spark.range(2000).selectExpr("'a' AS key", "id * 1.0D AS x", "(id * 7919 % 2000) * 1.0D AS y", "1L AS w").repartition(8)
    inversions.tie_and_pair_counts(cells, ["key"], "x", "y", "w")
    (placed,) = seen
    assert placed.groupBy(F.spark_partition_id()).count().filter("count > 100").count() == 8


@pytest.mark.parametrize("cells, blocks", [(1 << 16, 512), (20, 512), (7, 6)])
def test_dominated_in_blocks(spark, monkeypatch, cells, blocks):
    monkeypatch.setattr(inversions, "CELLS", cells)
    monkeypatch.setattr(inversions, "BLOCKS", blocks)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=400).round(1), rng.normal(size=400).round(2)
    x[:80], y[60:160] = 0.25, -0.5  # values with a large share of all rows
    frame = pd.DataFrame({"key": ["a", None] * 200, "x": x, "y": y, "id": range(400)})
    rows = [(r.key, None if i % 37 == 0 else float(r.x), float("nan") if i % 41 == 0 else float(r.y), r.id) for i, r in enumerate(frame.itertuples())]
    df = spark.createDataFrame(rows, "key string, x double, y double, id long")
    found = {r.id: r.bipit for r in ranks.bipit(df, ["key"], "x", "y").collect()}
    assert len(found) == 400
    for key, _, _, i in rows:
        x, y = rows[i][1:3]
        below = sum(k == key and a is not None and x is not None and a < x and b < y for k, a, b, _ in rows)
        assert found[i] == (below + 0.5) / 200
    assert ranks.bipit(df.limit(0), ["key"], "x", "y").count() == 0
    free = {r.id: r.bipit for r in ranks.bipit(df.filter("x IS NOT NULL AND NOT isnan(y)").drop("key"), [], "x", "y").collect()}
    known = {r[3]: r[1:3] for r in rows if r[3] in free}
    for i, (x, y) in known.items():
        assert free[i] == (sum(a < x and b < y for a, b in known.values()) + 0.5) / len(free)


def test_bipit_has_no_row_for_each_bit(spark):
    """Each cell was filed once for every bit of its rank."""
    df = spark.range(5000).selectExpr("id * 1.0D AS u", "(id * 7919 % 5000) * 1.0D AS v")
    plan = ranks.bipit(df, [])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
