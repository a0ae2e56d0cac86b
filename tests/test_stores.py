import pytest
from pyspark.sql import functions as F

from meteospan.operators import reshape
from meteospan.sources import ensemble_store as store, observations


def test_ensemble_round_trip_and_pruning(spark, series, tmp_path):
    _, df = series
    root = str(tmp_path / "ens")
    ens = df.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("realization")))
    store.write_ensemble(ens, root, "base")
    back = store.load_ensemble(spark, root, "base", [0, 2])
    assert back.count() == 2 * df.count()
    assert "PartitionFilters: [" in back._jdf.queryExecution().toString()
    missing = store.missing_realizations(spark, store.load_ensemble(spark, root, "base"), 5)
    assert sorted(r[0] for r in missing.collect()) == [3, 4]


def test_model_key_and_tables(spark, tmp_path):
    key = store.model_key(variables=["a", "b"], weights="tau")
    assert key == store.model_key(weights="tau", variables=["a", "b"])
    edges = spark.sql("SELECT 0 AS tree, 'a' AS node_u, 'b' AS node_v")
    store.save_model({"vine_edges": edges}, str(tmp_path), key)
    assert store.load_model(spark, str(tmp_path), key, ["vine_edges"])["vine_edges"].count() == 1
    assert store.load_model(spark, str(tmp_path), "other", ["vine_edges"]) is None
    assert store.load_model(spark, str(tmp_path), key, ["vine_edges"], refit=True) is None


def test_read_wide_and_write_csv(spark, series, tmp_path):
    _, df = series
    wide = reshape.to_wide(df, ["R", "theta"])
    wide.write.parquet(str(tmp_path / "wide"))
    back = observations.read_observations(spark, str(tmp_path / "wide"), variables=["R", "theta"])
    assert back.exceptAll(df.select(*back.columns)).count() == 0
    observations.write_station_csv(df, str(tmp_path / "csv"), ["R", "theta"], hourly_variables=["theta"])
    daily = spark.read.option("header", True).csv(str(tmp_path / "csv" / "stations_daily"))
    assert daily.count() == 1800 and set(daily.columns) == {"time", "R", "station"}


def test_missing_coordinates_fail(spark, series):
    _, df = series
    stations = spark.sql("SELECT 'a' station, 1.0D longitude, 2.0D latitude")
    with pytest.raises(Exception, match="no finite coordinates"):
        reshape.attach_stations(df, stations).agg(F.sum("longitude")).collect()
