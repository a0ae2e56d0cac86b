import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meteospan.functions import copula as C
from meteospan.operators import ranks, vine

# Covariance of the Gaussian test variables.
COVARIANCE = np.array(
    [[1.300, 0.568, 0.597, 0.507, 0.3], [0.568, 0.910, 0.288, 0.686, 0.2], [0.597, 0.288, 0.963, 0.282, 0.1], [0.507, 0.686, 0.282, 0.892, 0.25], [0.3, 0.2, 0.1, 0.25, 0.9]]
)
NAMES = list("abcde")


@pytest.fixture(scope="module")
def rank_table(spark):
    """Five variables at two stations, 1,000 times each."""
    parts = []
    for i, station in enumerate("st"):
        x = np.random.default_rng(i).multivariate_normal(np.zeros(5), COVARIANCE, 1000)
        frame = pd.DataFrame(x, columns=NAMES).assign(time=pd.date_range("2000-01-01", periods=1000), station=station)
        parts.append(frame.melt(["station", "time"], var_name="variable"))
    return ranks.rel_ranks(spark.createDataFrame(pd.concat(parts))).drop("value").cache()


@pytest.mark.parametrize("kind, by", [("C", None), ("R", "station")])
def test_quantiles_are_independent_and_invert(rank_table, kind, by):
    edges = vine.fit_vine(rank_table, NAMES, kind, by, families=["gaussian"]).cache()
    assert edges.count() == 10 * (2 if by else 1)
    q = vine.vine_quantiles(rank_table, edges, NAMES, by).cache()
    check = vine.independence_check(q, by).toPandas()
    assert check.ks.max() < 0.05 and check.max_abs_corr.max() < 0.1
    back = vine.vine_inverse(q, edges, NAMES, by).withColumnRenamed("u", "u2")
    gap = back.join(rank_table, ["station", "time", "variable"]).select(F.max(F.abs(F.col("u2") - F.col("u"))), F.count("*")).first()
    assert gap[0] < 1e-6 and gap[1] == 10_000


def test_stop_and_missing_values(rank_table):
    edges = vine.fit_vine(rank_table, NAMES, "C", families=["gaussian"])
    order = [r.variable for r in vine.vine_order(edges).orderBy("pos").collect()]
    q = vine.vine_quantiles(rank_table, edges, NAMES).filter(~((F.col("variable") == order[1]) & (F.col("time") < "2000-02-01")))
    back = vine.vine_inverse(q, edges, NAMES, stop_at=3)
    known = {(r.variable, r.early): r["count"] for r in back.filter("u IS NOT NULL").groupBy("variable", (F.col("time") < "2000-02-01").alias("early")).count().collect()}
    assert known == {(order[0], True): 62, (order[0], False): 1938, (order[1], False): 1938, (order[2], False): 1938}


@pytest.fixture(scope="module")
def seasonal_table(spark):
    """Three variables whose dependence turns over the year."""
    rng = np.random.default_rng(4)
    time = pd.date_range("2000-01-01", periods=5 * 365)
    swing = np.cos(2 * np.pi * time.dayofyear / 366)
    a, p, q = rng.random((3, len(time)))
    b = C.h_inverse_array("gaussian", a, p, 0.6 * swing)
    c = C.h_inverse_array("gaussian", a, q, 0.5 - 0.4 * swing)
    frame = pd.DataFrame({"a": a, "b": b, "c": c}).assign(time=time, station="s").melt(["station", "time"], var_name="variable", value_name="u")
    return spark.createDataFrame(frame).cache()


@pytest.mark.parametrize("kind", ["C", "R"])
def test_seasonal_vine(seasonal_table, kind):
    edges = vine.fit_vine(seasonal_table, list("abc"), kind, families=["gaussian"], seasonal=True, weights="tau", **({"central": "a"} if kind == "C" else {})).cache()
    first = {frozenset((r.node_u, r.node_v)): r for r in edges.filter("tree = 0").collect()}
    for pair, want in ((frozenset("ab"), lambda s: 0.6 * s), (frozenset("ac"), lambda s: 0.5 - 0.4 * s)):
        if pair in first:
            assert first[pair].seasonal and first[pair].theta is None and len(first[pair].thetas) == 366
            swing = np.cos(2 * np.pi * np.arange(1, 367) / 366)
            assert np.abs(np.array(first[pair].thetas) - want(swing)).mean() < 0.1
    q = vine.vine_quantiles(seasonal_table, edges, list("abc")).cache()
    back = vine.vine_inverse(q, edges, list("abc")).withColumnRenamed("u", "back")
    gap = back.join(seasonal_table, ["station", "time", "variable"]).select(F.max(F.abs(F.col("back") - F.col("u"))), F.count("*")).first()
    assert gap[0] < 1e-6 and gap[1] == 3 * 5 * 365
    # the dependence of a season is gone
    wide = q.filter(F.month("time").isin(12, 1, 2)).groupBy("time").pivot("variable", list("abc")).agg(F.first("q")).toPandas()
    raw = seasonal_table.filter(F.month("time").isin(12, 1, 2)).groupBy("time").pivot("variable", list("abc")).agg(F.first("u")).toPandas()
    assert abs(raw.a.corr(raw.b)) > 0.4 and abs(wide.a.corr(wide.b)) < 0.12


def test_lagged_first_tree(spark):
    rng = np.random.default_rng(5)
    time = pd.date_range("2000-01-01", periods=800)
    a, p = rng.random((2, len(time)))
    b = np.roll(C.h_inverse_array("gaussian", a, p, 0.8), 2)  # b follows a two days later
    frame = pd.DataFrame({"a": a, "b": b, "c": rng.random(len(time))}).assign(time=time, station="s").melt(["station", "time"], var_name="variable", value_name="u")
    df = spark.createDataFrame(frame)
    tau = {(r.node_u, r.node_v): r for r in vine.pair_edges(df, list("abc"), lag=2).collect()}
    assert tau["a", "b"].tau > 0.5 and tau["a", "b"].n == 798 and abs(tau["a", "c"].tau) < 0.1
    now = {(r.node_u, r.node_v): r.tau for r in vine.pair_edges(df, list("abc")).collect()}
    assert abs(now["a", "b"]) < 0.1
    edges = {(r.tree, frozenset((r.node_u, r.node_v))): r for r in vine.fit_vine(df, list("abc"), "R", lag=2, families=["gaussian"]).collect()}
    assert edges[0, frozenset("ab")].theta == pytest.approx(0.8, abs=0.05) and edges[0, frozenset("ab")].n == 798
