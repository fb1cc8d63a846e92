"""Column helpers. Bad values turn into NULL, never into errors, with ANSI mode left on."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import constants as K


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- text ---------------------------------------------------------------------------------------

def clean_text(value: Column | str) -> Column:
    return F.trim(F.upper(col(value)))


def clean_identifier(value: Column | str) -> Column:
    """Upper case, every run of other characters becomes one underscore, none at the ends."""
    words = F.regexp_replace(F.upper(F.trim(col(value))), "[^A-Z0-9]+", "_")
    return F.trim(words, F.lit("_"))


def market_key(state, district, code, name) -> Column:
    """The one market id used everywhere: STATE_DISTRICT_CODE_NAME. NULL if any part is NULL."""
    parts = [clean_identifier(state), clean_identifier(district), col(code).cast("string"),
             clean_identifier(name)]
    return F.concat(parts[0], F.lit("_"), parts[1], F.lit("_"), parts[2], F.lit("_"), parts[3])


def canonical_key(value: Column | str) -> Column:
    """Fold the spellings of one key (%20, blank, hyphen, underscore) into one."""
    return clean_identifier(F.replace(col(value), F.lit("%20"), F.lit("_")))


def spaced(value: Column | str) -> Column:
    return F.replace(clean_text(value), F.lit("-"), F.lit(" "))


def title(value: Column | str) -> Column:
    return F.initcap(F.trim(col(value)))


def first_word(value: Column | str, separator: str = "_") -> Column:
    return F.split_part(col(value), F.lit(separator), F.lit(1))


def short_id() -> Column:
    """A new eight-letter id per row; every evaluation draws another, so write it before using it twice."""
    return F.substring(F.uuid(), 1, 8)


def contains_text(value: Column | str, term: str) -> Column:
    """Case-folded substring test; NULL counts as no match."""
    return F.coalesce(F.contains(F.upper(col(value)), F.lit(term.strip().upper())), F.lit(False))


# --- numbers and dates --------------------------------------------------------------------------

def number(value: Column | str, kind: str = "double") -> Column:
    """Cast, with NaN and unreadable text as NULL."""
    parsed = col(value).try_cast(kind)
    return F.when(~F.isnan(parsed), parsed) if kind == "double" else parsed


def scrubbed_number(value: Column | str, kind: str = "double") -> Column:
    """Drop commas, blanks and percent signs, then cast."""
    return number(F.regexp_replace(col(value).cast("string"), "[, %]", ""), kind)


def leading_digits(value: Column | str) -> Column:
    return F.regexp_extract(col(value).cast("string"), r"(\d+)", 1).try_cast("int")


_FIELDS = {"yyyy": r"(\d{4})", "MMM": "([A-Za-z]{3})", "MM": r"(\d{2})", "M": r"(\d{1,2})", "dd": r"(\d{2})",
           "d": r"(\d{1,2})"}


def _read_date(text: Column, pattern: str) -> Column:
    """Text of the pattern's shape as a date. Checking the shape first spares a failed parse per row and
    pattern, and all-digit shapes become ISO text, which the plain cast reads fastest."""
    parts = re.findall("y+|M+|d+|[^yMd]+", pattern)
    shape = "^" + "".join(_FIELDS.get(p) or re.escape(p) for p in parts) + "$"
    fields = [p[0] for p in parts if p in _FIELDS]
    if "MMM" in parts:
        parsed = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
    else:
        iso = "-".join(f"${fields.index(f) + 1}" for f in "yMd")
        parsed = F.regexp_replace(text, shape, iso).try_cast("date")
    return F.when(text.rlike(shape), parsed)


def parse_date(value: Column | str, formats: Sequence[str]) -> Column:
    """The first pattern that reads the text wins."""
    text = F.trim(col(value).cast("string"))
    return F.coalesce(*[_read_date(text, f) for f in formats])


def month_label_date(label: Column | str) -> Column:
    """'Apr-23' -> 2023-04-01, 'Apr-95' -> 1995-04-01: years 69 to 99 belong to the last century."""
    parsed = F.try_to_timestamp(F.concat(F.lit("01-"), col(label)), F.lit("dd-MMM-yy")).cast("date")
    return F.when(F.year(parsed) > 2068, F.add_months(parsed, -1200)).otherwise(parsed)


def year_month_date(year: Column | str, month_name: Column | str) -> Column:
    """2025, 'December' -> 2025-12-01."""
    text = F.concat_ws("-", col(year).cast("string"), F.trim(col(month_name)), F.lit("01"))
    return F.try_to_timestamp(text, F.lit("yyyy-MMMM-dd")).cast("date")


def month_start(date: Column | str) -> Column:
    return F.trunc(col(date), "MM")


def next_month_start(date: Column | str) -> Column:
    return F.add_months(month_start(date), 1)


def date_chunks(start: Column | str, end: Column | str, days: int = 90) -> Column:
    """The range cut into stretches of so many days: array of (start, end), both inclusive."""
    begins = F.sequence(col(start), col(end), F.make_dt_interval(F.lit(days)))
    return F.transform(begins, lambda d: F.struct(
        d.alias("start"), F.least(F.date_add(d, days - 1), col(end)).alias("end")))


def calendar_parts(date: Column | str) -> dict[str, Column]:
    """Monday is day 0; Saturday and Sunday are the weekend."""
    weekday = F.weekday(col(date))
    return {
        "day_of_week": weekday,
        "day_of_month": F.dayofmonth(col(date)),
        "month": F.month(col(date)),
        "is_weekend": flag(weekday >= 5),
    }


# --- ranges, flags, guards ----------------------------------------------------------------------

def nullify_outside(value: Column | str, low: float, high: float) -> Column:
    return F.when(col(value).between(low, high), col(value))


def default_outside(value: Column | str, low: float, high: float, default: float) -> Column:
    """Out-of-range and NULL both become the default."""
    return F.when(col(value).between(low, high), col(value)).otherwise(F.lit(default))


def clip(value: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (greatest and least alone would skip it)."""
    bounded = col(value)
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(col(value).isNotNull(), bounded)


def safe_ratio(top: Column | str, bottom: Column | str, floor: float) -> Column:
    return col(top) / clip(bottom, low=floor)


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.when(bottom > 0, top / F.when(bottom > 0, bottom)).otherwise(F.lit(0.0))


def flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def zscore_or_zero(value: Column | str, mean: Column | str, std: Column | str) -> Column:
    """Zero for groups without spread; a NULL value in a group with spread stays NULL."""
    return F.when(col(std).isNull() | (col(std) == 0), F.lit(0.0)).otherwise(
        (col(value) - col(mean)) / F.greatest(col(std), F.lit(1e-6)))


def inside_box(latitude: Column | str = "latitude", longitude: Column | str = "longitude") -> Column:
    return col(latitude).between(*K.LATITUDE_RANGE) & col(longitude).between(*K.LONGITUDE_RANGE)


# --- lookups ------------------------------------------------------------------------------------

def lookup(key: Column | str, table: Mapping, default=None) -> Column:
    pairs: Iterable = (F.lit(x) for pair in table.items() for x in pair)
    found = F.try_element_at(F.create_map(*pairs), col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def commodity_category(commodity: Column | str) -> Column:
    return lookup(clean_text(commodity), K.COMMODITY_CATEGORIES, "Other")


def season(month: Column | str, calendar: Mapping[int, str] = K.SEASON_OF_MONTH) -> Column:
    return lookup(col(month).cast("int"), calendar)


# --- geometry and losses ------------------------------------------------------------------------

def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a_lat, a_lon, b_lat, b_lon = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin((b_lat - a_lat) / 2)
    half_lon = F.sin((b_lon - a_lon) / 2)
    chord = half_lat * half_lat + F.cos(a_lat) * F.cos(b_lat) * half_lon * half_lon
    chord = F.least(chord, F.lit(1.0))
    return F.lit(2 * K.EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))


def hub_distance_km(latitude, longitude, hubs=K.HUBS) -> Column:
    """Distance to the closest of a fixed list; NULL without coordinates."""
    distances = [haversine_km(latitude, longitude, F.lit(lat), F.lit(lon)) for _, lat, lon in hubs]
    known = col(latitude).isNotNull() & col(longitude).isNotNull()
    return F.when(known, F.least(*distances))


def pinball(actual: Column | str, forecast: Column | str, quantile: float) -> Column:
    miss = col(actual) - col(forecast)
    return F.greatest(F.lit(quantile) * miss, F.lit(quantile - 1.0) * miss)


def pinball_gradient(actual: Column | str, forecast: Column | str, quantile: float) -> Column:
    """The step that lowers the loss: up by q under the truth, down by 1-q at or over it."""
    return F.when(col(actual) > col(forecast), F.lit(quantile)).otherwise(F.lit(quantile - 1.0))


# --- arrays -------------------------------------------------------------------------------------

def known_values(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))


def array_sum(values: Column) -> Column:
    """Sum of the known entries; NULL if there are none."""
    known = known_values(values)
    total = F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(known) > 0, total)


def array_mean(values: Column) -> Column:
    known = known_values(values)
    total = F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(known) > 0, total / F.when(F.size(known) > 0, F.size(known)))
