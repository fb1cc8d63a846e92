import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from granary.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Three markets, one commodity, ten days, prices 100 + 2i + c."""
    rows = [
        (f"M{c}", "WHEAT", date(2025, 1, 1) + timedelta(days=i), 100.0 + 2 * i + c, 10.0 + i, 18.5, 73.8, "S", "D")
        for c in range(3) for i in range(10)]
    return spark.createDataFrame(
        rows, "mandi_id string, commodity string, date date, modal_price double, arrivals_tonnes double, "
              "latitude double, longitude double, state string, district string")


@pytest.fixture(scope="session")
def weather_grid(spark):
    rows = [(date(2025, 1, 1) + timedelta(days=i), 18.501, 73.799, 25.0, 2.0, 60.0, 5.0) for i in range(10)]
    return spark.createDataFrame(rows, "date date, latitude double, longitude double, temperature_mean double, "
                                       "precipitation_mm double, humidity double, wind_speed double")


@pytest.fixture(scope="session")
def macro(spark):
    months = [(date(2024, 12, 1), 119.0, 109.0), (date(2025, 1, 1), 120.0, 110.0), (date(2025, 2, 1), 121.0, 111.0),
              (date(2025, 3, 1), 122.0, 112.0)]
    cpi = spark.createDataFrame([(d, "All India", "Food and Beverages", c) for d, c, _ in months],
                                "date date, state string, division string, cpi_index double")
    wpi = spark.createDataFrame([(d, "ALL", w) for d, _, w in months], "date date, level string, wpi_index double")
    return cpi, wpi


def rows_of(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]
