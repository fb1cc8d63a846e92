from datetime import date

import pytest
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.functions import constants as K


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, expected", [
    ("15/01/2025", date(2025, 1, 15)), ("2025-01-15", date(2025, 1, 15)), ("5/1/2025", date(2025, 1, 5)),
    ("bad-date", None), ("", None)])
def test_dates_take_the_first_pattern_that_reads(spark, text, expected):
    assert one(spark, C.parse_date("t", K.PRICE_DATE_FORMATS), t=text) == expected


@pytest.mark.parametrize("label, expected", [
    ("Apr-23", date(2023, 4, 1)), ("Apr-95", date(1995, 4, 1)), ("Notes", None)])
def test_month_labels(spark, label, expected):
    assert one(spark, C.month_label_date("t"), t=label) == expected


def test_year_and_month_name(spark):
    assert one(spark, C.year_month_date("y", "m"), y=2025, m="December") == date(2025, 12, 1)


def test_numbers(spark):
    assert one(spark, C.scrubbed_number("t"), t="1, 234.5%") == 1234.5
    assert one(spark, C.number("t"), t="x") is None
    assert one(spark, C.number("t"), t="NaN") is None
    assert one(spark, C.leading_digits("t"), t=" 36 months") == 36
    assert one(spark, C.leading_digits("t"), t="none") is None


def test_identifiers(spark):
    assert one(spark, C.clean_identifier("t"), t="  Osmanabad -- District.") == "OSMANABAD_DISTRICT"
    key = C.market_key(F.lit("Andhra Pradesh"), F.lit("Anantapur"), F.lit(1048), F.lit("Rayadurg"))
    assert one(spark, key) == "ANDHRA_PRADESH_ANANTAPUR_1048_RAYADURG"
    assert one(spark, C.canonical_key("t"), t="UTTAR%20PRADESH_LUCKNOW") == "UTTAR_PRADESH_LUCKNOW"


def test_ranges_keep_null_apart(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (5.0,), (999.0,)], "v double")
    got = df.select(C.nullify_outside("v", 0, 10).alias("n"), C.default_outside("v", 0, 10, 0.0).alias("d"),
                    C.clip("v", 0.0, 10.0).alias("c")).collect()
    assert [r["n"] for r in got] == [None, None, 5.0, None]
    assert [r["d"] for r in got] == [0.0, 0.0, 5.0, 0.0]
    assert [r["c"] for r in got] == [None, 0.0, 5.0, 10.0]


def test_weekend_and_seasons(spark):
    saturday = F.lit(date(2025, 1, 4))
    assert one(spark, C.calendar_parts(saturday)["day_of_week"]) == 5
    assert one(spark, C.calendar_parts(saturday)["is_weekend"]) == 1
    assert one(spark, C.season(F.lit(6))) == "Kharif"
    assert one(spark, C.season(F.lit(6), K.SEASON_OF_MONTH_LATE)) == "Zaid"


def test_categories(spark):
    assert one(spark, C.commodity_category("t"), t=" wheat ") == "Cereal"
    assert one(spark, C.commodity_category("t"), t="UNKNOWN") == "Other"


def test_small_helpers(spark):
    assert one(spark, C.title("t"), t=" uttar pradesh") == "Uttar Pradesh"
    assert one(spark, C.first_word("t"), t="UTTAR_PRADESH") == "UTTAR"
    assert len(one(spark, C.short_id())) == 8
    chunks = one(spark, C.date_chunks(F.lit(date(2025, 1, 1)), F.lit(date(2025, 1, 10)), 4))
    assert [(c["start"].day, c["end"].day) for c in chunks] == [(1, 4), (5, 8), (9, 10)]


def test_distance(spark):
    km = C.haversine_km(F.lit(28.7130), F.lit(77.1780), F.lit(19.0440), F.lit(72.9980))
    assert one(spark, km) == pytest.approx(1152, abs=5)
    assert one(spark, C.hub_distance_km(F.lit(28.7130), F.lit(77.1780))) == pytest.approx(0, abs=1e-6)
    assert one(spark, C.hub_distance_km(F.lit(None).cast("double"), F.lit(77.0))) is None


@pytest.mark.parametrize("y, f, q, loss", [(10.0, 0.0, 0.9, 9.0), (0.0, 10.0, 0.9, 1.0), (5.0, 0.0, 0.5, 2.5),
                                           (5.0, 10.0, 0.5, 2.5), (3.0, 3.0, 0.5, 0.0)])
def test_pinball(spark, y, f, q, loss):
    assert one(spark, C.pinball(F.lit(y), F.lit(f), q)) == pytest.approx(loss)


def test_gradient(spark):
    assert one(spark, C.pinball_gradient(F.lit(10.0), F.lit(5.0), 0.9)) == pytest.approx(0.9)
    assert one(spark, C.pinball_gradient(F.lit(5.0), F.lit(10.0), 0.9)) == pytest.approx(-0.1)


def test_zscore_guard(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0), (1.0, 2.0, None), (1.0, 2.0, 0.5), (None, 2.0, 0.5)],
                               "v double, m double, s double")
    assert [r[0] for r in df.select(C.zscore_or_zero("v", "m", "s")).collect()] == [0.0, 0.0, -2.0, None]
