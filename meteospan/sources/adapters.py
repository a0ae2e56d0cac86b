"""Long tables derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Variable name -> column of lineitem, all stored with two decimals.
LINEITEM_VARIABLES = {
    "discount": "l_discount",
    "price": "l_extendedprice",
    "quantity": "l_quantity",
    "tax": "l_tax",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exact_mean(column: str):
    """Mean of a two-decimal column through whole hundredths, so that it does not depend on
    the order of summation and equal means stay ties."""
    cents = F.round(F.col(column) * 100).cast("long")
    return F.sum(cents).cast("double") / (100 * F.count(cents)).cast("double")


def _daily(lines: DataFrame, keys: list) -> DataFrame:
    wide = lines.groupBy(
        *keys, F.col("l_returnflag").alias("station"), F.col("l_shipdate").alias("time")
    ).agg(*[_exact_mean(c).alias(v) for v, c in LINEITEM_VARIABLES.items()])
    return wide.unpivot(
        [c for c in wide.columns if c not in LINEITEM_VARIABLES],
        list(LINEITEM_VARIABLES),
        "variable",
        "value",
    )


def daily_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station = return flag, time = ship date, four variables."""
    return _daily(table(spark, sf_dir, "lineitem"), [])


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``daily_obs`` with realization = supplier mod 8."""
    lines = table(spark, sf_dir, "lineitem")
    return _daily(lines, [(F.col("l_suppkey") % 8).cast("int").alias("realization")])


def hourly_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station = event type, one variable, hourly means."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("station"),
            F.lit("value").alias("variable"),
            F.date_trunc("hour", "ts").alias("time"),
        )
        .agg(_exact_mean("value").alias("value"))
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station per nation with coordinates from fixed linear formulas."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("station"),
        F.col("r_name").alias("region"),
        (F.col("n_nationkey") * 7.5 - 90.0).alias("longitude"),
        (F.col("n_nationkey") * 3.0 - 36.0).alias("latitude"),
    )


def line_pairs(spark: SparkSession, sf_dir: str, u: str, v: str) -> DataFrame:
    """Two columns of lineitem side by side for every line, keyed by return flag."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("station"),
        F.col("l_orderkey").alias("order"),
        F.col("l_linenumber").alias("line"),
        F.col(u).alias("x"),
        F.col(v).alias("y"),
    )


def order_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station = nation of the customer, one variable, daily means of order totals."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    return placed.groupBy(
        F.col("n_name").alias("station"), F.lit("total").alias("variable"),
        F.col("o_orderdate").alias("time"),
    ).agg(_exact_mean("o_totalprice").alias("value"))
