"""Ensembles and fitted models as partitioned Parquet."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

ENSEMBLE_SCHEMA = "station string, variable string, time timestamp, value double, ensemble string, realization int"


def write_ensemble(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """One folder per realization below the ensemble name; a realization written again is replaced,
    the others stay."""
    (
        df.withColumn("ensemble", F.lit(name))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ensemble", "realization")
        .parquet(root)
    )


def load_ensemble(
    spark: SparkSession, root: str, name: str, realizations: int | Sequence[int] | None = None
) -> DataFrame:
    """Exactly the requested realizations; both filters prune folders."""
    df = spark.read.schema(ENSEMBLE_SCHEMA).parquet(root).filter(F.col("ensemble") == name)
    if isinstance(realizations, int):
        return df.filter(F.col("realization") < realizations)
    if realizations is not None:
        return df.filter(F.col("realization").isin([int(r) for r in realizations]))
    return df


def missing_realizations(spark: SparkSession, existing: DataFrame, n: int) -> DataFrame:
    """Numbers in 0 … n−1 that are not present yet."""
    wanted = spark.range(n).select(F.col("id").cast("int").alias("realization"))
    return wanted.join(existing.select("realization").distinct(), "realization", "left_anti")


def derive_ensemble(base: DataFrame, realizations: DataFrame) -> DataFrame:
    """Values of a derived scenario beside the base values of the same realization."""
    keys = ["realization", "station", "variable", "time"]
    return realizations.select(*keys, F.col("value").alias("derived")).join(
        base.select(*keys, F.col("value").alias("base")), keys
    )


def model_key(**parts) -> str:
    """Stable key from variables, stations, weights, primary variable, resolution, …"""
    text = json.dumps(parts, sort_keys=True, default=sorted)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def save_model(tables: dict[str, DataFrame], path: str, key: str) -> None:
    for name, df in tables.items():
        (
            df.withColumn("model_key", F.lit(key))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("model_key")
            .parquet(f"{path}/{name}")
        )


def load_model(
    spark: SparkSession, path: str, key: str, names: Sequence[str] = ("vine_edges", "vine_order"),
    refit: bool = False,
) -> dict[str, DataFrame] | None:
    """Tables stored under ``key``, or None if there are none or a refit is asked for."""
    if refit:
        return None
    out = {}
    for name in names:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/model_key={key}")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return None
        out[name] = spark.read.parquet(f"{path}/{name}").filter(F.col("model_key") == key).drop("model_key")
    return out
