import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "resample_mean", "interpolate_extrapolate", "doy_window", "rolling_sum", "rel_ranks", "ecdf_cdf", "normal_pit",
    "kendall_tau", "nan_corr", "cross_corr", "pair_report", "copula_h", "fit_copula", "apply_scenario", "qq_bands",
    "spell_bands", "heatwaves_zitis", "islands", "score_conditions", "rvine_tree",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    # both sides round to six digits; a value half-way between two may go either way
    assert compare(got, con.execute(entry.oracle_sql()[name]).df(), 1.01e-6) == "ok"
