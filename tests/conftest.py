import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from meteospan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "8g")


@pytest.fixture(scope="session")
def series(spark):
    """Two stations, two variables, ties and gaps."""
    rng = np.random.default_rng(3)
    rows = []
    for station in ("a", "b"):
        for variable in ("R", "theta"):
            for i, t in enumerate(pd.date_range("1999-11-20", periods=900, freq="D")):
                x = round(float(rng.normal(10, 4)), 1)
                x = max(0.0, x - 10) if variable == "R" else x
                rows.append((station, variable, t, None if i in (0, 1, 40, 41, 899) else x))
    frame = pd.DataFrame(rows, columns=["station", "variable", "time", "value"])
    df = spark.createDataFrame(frame, "station string, variable string, time timestamp, value double")
    from meteospan.schema import nan_to_null

    return frame, nan_to_null(df).cache()
