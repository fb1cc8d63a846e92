"""Market-shaped inputs derived from the star-schema tables. bindings/sql.py holds the same views in SQL.

Measures are whole numbers where possible, so that sums and means do not depend on row order.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import dealt

COMMODITIES = {"ECONOMY": "WHEAT", "STANDARD": "RICE", "MEDIUM": "TOMATO", "PROMO": "ONION", "LARGE": "COTTON",
               "SMALL": "CASHEW"}
DIVISIONS = {"1-URGENT": "Food and Beverages", "2-HIGH": "Fuel and Light", "3-MEDIUM": "Miscellaneous",
             "4-NOT SPECIFIED": "Housing", "5-LOW": "Clothing"}
STATUSES = ("Fully Paid", "Charged Off", "Current", "Default", "Late (31-120 days)", "Late (16-30 days)",
            "Does not meet the credit policy. Status:Charged Off", "In Grace Period")
MONTH_LABELS = tuple(date(y, m, 1).strftime("%b-%y") for y in range(1995, 2002) for m in range(1, 13))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def choose(index: Column, *values) -> Column:
    """values[index], the last one for anything beyond."""
    out = F.when(index == 0, values[0])
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(index == i, v)
    return out.otherwise(values[-1])


def whole(value) -> Column:
    return F.floor(value).cast("double")


def day(name: str) -> Column:
    return F.col(name).cast("date")


def text(value: Column) -> Column:
    return value.cast("string")


def latitude(key: str) -> Column:
    return F.lit(6.0) + (F.col(key) * 37 % 3200).cast("double") / 100.0


def longitude(key: str) -> Column:
    return F.lit(68.0) + (F.col(key) * 53 % 3000).cast("double") / 100.0


def locations(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        F.concat("n_name", F.lit("_"), text(F.col("s_suppkey"))).alias("mandi_id"),
        F.col("s_suppkey").alias("market_code"), F.col("s_name").alias("mandi_name"),
        F.concat(F.lit("D"), text(F.col("s_suppkey") % 7)).alias("district"), F.col("n_name").alias("state"),
        latitude("s_suppkey").alias("latitude"), longitude("s_suppkey").alias("longitude"))


def panel(spark, d) -> DataFrame:
    """One row per series and day; aggregated before the location columns are joined. There are nearly as many as sales, so those are
    dealt out by their number, which the files' footers hold."""
    parts = table(spark, d, "part").select("p_partkey", pick(F.col("p_type"), COMMODITIES).alias("commodity"))
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                                               day("l_shipdate").alias("date"))
    sold = dealt(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), lines.count(), "l_suppkey", "date")
    daily = sold.groupBy("l_suppkey", "commodity", "date").agg(
        F.max(whole("l_extendedprice")).alias("modal_price"), F.sum("l_quantity").alias("arrivals_tonnes"))
    return daily.join(locations(spark, d), F.col("l_suppkey") == F.col("market_code")).select(
        "mandi_id", "state", "district", "commodity", "date", "modal_price", "arrivals_tonnes", "latitude", "longitude")


def raw_prices(spark, d) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand", pick(F.col("p_type"), COMMODITIES).alias("c"))
    sold = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        locations(spark, d), F.col("l_suppkey") == F.col("market_code"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    price = text(F.floor("l_extendedprice"))
    stamp = F.col("l_shipdate")
    null = F.lit(None).cast("string")
    return sold.select(
        F.when(k % 29 != 5, F.concat(F.lit("  "), F.lower("state"), F.lit(" "))).alias("state_name"),
        text(F.col("market_code") % 25).alias("state_code"), F.lower("district").alias("district_name"),
        text(F.col("market_code") % 7).alias("district_code"), F.col("mandi_name").alias("market_center"),
        text(F.col("market_code")).alias("market_code"), F.lit("crop ").alias("commodity_type"),
        F.concat(F.lit(" "), F.lower("c")).alias("commodity"), F.col("p_brand").alias("variety"),
        F.when(n == 7, null).otherwise(F.lit("local")).alias("origin"), price.alias("min_price"),
        F.when(k % 5 == 0, F.lit("x")).otherwise(price).alias("max_price"),
        choose(k % 23, F.lit(""), F.lit("-5"), F.lit("1,234.50"), F.lit("2000000"), price).alias("modal_price"),
        choose(n % 5, F.date_format(stamp, "dd/MM/yyyy"), F.date_format(stamp, "yyyy-MM-dd"),
               F.date_format(stamp, "d/M/yyyy"), F.when(k % 2 == 0, F.lit("n/a")).otherwise(F.date_format(stamp, "d/M/yyyy")),
               F.date_format(stamp, "yyyy-MM-dd")).alias("report_date"),
        text(F.col("l_quantity").cast("int")).alias("arrivals_tonnes"), F.lit("t").alias("arrivals_unit"),
        F.lit("INR").alias("price_unit"), text(F.col("latitude")).alias("latitude"),
        text(F.col("longitude")).alias("longitude"))


def raw_weather(spark, d) -> DataFrame:
    """A reading per sale, with impossible values and coordinates outside the box mixed in."""
    rows = table(spark, d, "lineitem").select(
        "l_suppkey", day("l_shipdate").alias("date"), (F.col("l_linenumber") % 3).cast("double").alias("j"))
    k = F.col("l_suppkey") * 7 + F.dayofyear("date")

    def num(value) -> Column:
        return value.cast("double")

    return rows.select(
        "date",
        num(F.when(k % 17 == 0, 99).otherwise(20 + k % 20)).alias("temperature_mean"),
        num(F.when(k % 19 == 0, 60).otherwise(26 + k % 20)).alias("temperature_max"),
        num(14 + k % 20).alias("temperature_min"),
        num(F.when(k % 13 == 0, -1).when(k % 11 == 0, F.lit(None)).otherwise(k % 9)).alias("precipitation_mm"),
        num(F.when(k % 23 == 0, 120).otherwise(40 + k % 50)).alias("humidity"),
        num(F.when(k % 29 == 0, 200).otherwise(k % 30)).alias("wind_speed"),
        (F.when(F.col("l_suppkey") % 31 == 30, F.lit(2.5)).otherwise(latitude("l_suppkey"))
         + F.col("j") * 0.00001).alias("latitude"),
        longitude("l_suppkey").alias("longitude"))


def raw_signal(spark, d) -> DataFrame:
    """Monthly reading per market, all text; some out of range, some undated."""
    monthly = table(spark, d, "lineitem").groupBy(
        "l_suppkey", F.trunc(day("l_shipdate"), "MM").alias("m")).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    value = (F.col("q") % 130).cast("double") / 100.0 - 0.2
    bad = (F.col("l_suppkey") + F.month("m") + F.year("m")) % 37 == 0
    return monthly.join(locations(spark, d), F.col("l_suppkey") == F.col("market_code")).select(
        "mandi_id", text(F.col("market_code")).alias("market_code"), F.lower("mandi_name").alias("mandi_name"),
        "district", F.lower("state").alias("state"), text(F.col("latitude")).alias("latitude"),
        text(F.col("longitude")).alias("longitude"),
        F.when(bad, F.lit("bad-date")).otherwise(F.date_format("m", "yyyy-MM-dd")).alias("date"),
        text(value).alias("ndvi"))


def raw_warehouses(spark, d) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    until = F.date_add(F.lit(date(2020, 1, 1)), (k % 1000).cast("int"))
    return c.select(
        F.when(k % 41 != 0, F.concat(F.lit(" "), F.col("c_name"))).alias("wh_name"),
        F.concat(F.lit("R"), text(k % 700)).alias("Warehouse Registration No"),
        F.concat(F.lit(" d"), text(k % 7), F.lit(" ")).alias("District Name"),
        choose(k % 5, F.lit("n/a"), F.concat(F.lit("1,"), F.lpad(text(k % 1000), 3, "0")), F.lit(" 250 "),
               text(F.floor(F.abs(F.col("c_acctbal"))))).alias("Capacity(MT)"),
        choose(k % 5, F.date_format(until, "dd/MM/yyyy"), F.date_format(until, "dd-MM-yyyy"),
               F.date_format(until, "yyyy-MM-dd"), F.date_format(until, "d/M/yyyy"),
               F.date_format(until, "dd-MMM-yyyy")).alias("Valid Upto"),
        F.lower("n_name").alias("State"))


def raw_crop_loans(spark, d) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, d, "orders").select(
        F.concat(F.lit("L"), text(k % 12000)).alias("loan_id"),
        F.concat(F.lit(" nation_"), text(F.col("o_custkey") % 25)).alias("state"),
        F.lower("o_orderpriority").alias("commodity_category"), F.lit("rabi").alias("season"),
        F.when(k % 50 == 7, F.lit("soon")).otherwise(F.date_format(at, "yyyy-MM-dd")).alias("disburse_date"),
        F.when(k % 60 == 9, F.lit("lots")).otherwise(text(F.floor("o_totalprice"))).alias("loan_amount_inr"),
        F.concat(text(7 + k % 9), F.lit(".5")).alias("interest_rate_pct"), text(12 * (1 + k % 5)).alias("term_months"),
        F.lower(F.substring("o_orderpriority", 1, 1)).alias("credit_grade"),
        text((50 + k % 40).cast("double") / 100.0).alias("ltv_ratio"),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("is_default"))


def raw_consumer_loans(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        text(F.floor("o_totalprice")).alias("loan_amnt"),
        F.concat(F.lit(" "), text(36 + 24 * (k % 2)), F.lit(" months")).alias("term"),
        F.when(k % 70 == 3, F.lit("n/a")).otherwise(F.concat(text(5 + k % 20), F.lit(".5%"))).alias("int_rate"),
        F.lower(F.substring("o_orderpriority", 1, 1)).alias("grade"), F.lit("b2").alias("sub_grade"),
        F.lit("10+ years").alias("emp_length"), text(20000 + k % 100 * 500).alias("annual_inc"),
        choose(k % 8, *map(F.lit, STATUSES)).alias("loan_status"), text(k % 40).alias("dti"),
        text(k % 3).alias("delinq_2yrs"), text(k % 20).alias("open_acc"), text(k % 2).alias("pub_rec"),
        F.concat(text(k % 100), F.lit("%")).alias("revol_util"), text(5 + k % 30).alias("total_acc"),
        F.lit(" car").alias("purpose"), F.lower("o_orderstatus").alias("addr_state"))


def raw_cpi(spark, d) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    item = F.concat(F.lit(" item "), text(k % 10))
    return table(spark, d, "orders").select(
        F.year(at).alias("year"), F.date_format(at, "MMMM").alias("month"),
        F.when(k % 3 == 0, F.lit(" all india ")).otherwise(F.concat(F.lit("nation_"), text(F.col("o_custkey") % 25))).alias("state"),
        F.lower("o_orderstatus").alias("sector"), pick(F.col("o_orderpriority"), DIVISIONS).alias("division"),
        F.lit("g").alias("group"), item.alias("item"), text(k % 10).alias("code"),
        F.when(k % 31 == 0, F.lit("NA")).otherwise(text(F.floor(F.col("o_totalprice") / 1000))).alias("index"),
        text(k % 12).alias("inflation"))


def raw_wpi(spark, d) -> DataFrame:
    """Months as columns, one of them text, plus a column that is no month."""
    rows = table(spark, d, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "All").otherwise("Group").alias("Level"),
        F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("Commodity Name"),
        F.substring("o_orderpriority", 1, 1).alias("Commodity Code"), F.lit("1").alias("Commodity Weight"),
        F.date_format("o_orderdate", "MMM-yy").alias("label"), F.floor(F.col("o_totalprice") / 1000).alias("v"))
    ids = ["Level", "Commodity Name", "Commodity Code", "Commodity Weight"]
    wide = rows.groupBy(*ids).pivot("label", list(MONTH_LABELS)).agg(F.sum("v").cast("string"))
    return wide.withColumn("Notes", F.lit("see source"))


def zones(spark, d) -> DataFrame:
    return table(spark, d, "nation").where("n_nationkey % 6 <> 5").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower("n_name").alias("state"), F.col("r_name").alias("zone_name"))


def requests(spark, d) -> DataFrame:
    """Loan requests: by market, by district, by state, by coordinates, and some that cannot be served."""
    places = locations(spark, d)
    total = table(spark, d, "supplier").agg(F.count("*").alias("n")).scalar()
    e = F.col("event_id")
    events = table(spark, d, "events").withColumn("_n", total).withColumn("_s", F.col("user_id") % F.col("_n"))
    rows = events.join(places, F.col("_s") == F.col("market_code"))
    by = e % 4
    unknown = e % 44 == 2
    located = (by == 3) & (e % 40 != 39)
    return rows.select(
        text(e).alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client"),
        F.when(e % 7 == 6, F.lit(None)).otherwise(F.concat(F.lit(" "), F.lower(choose(
            e % 7, *map(F.lit, COMMODITIES.values()), F.lit("x"))))).alias("commodity"),
        F.when(unknown, F.lit("atlantis")).when(by != 3, F.lower("state")).alias("state"),
        F.when(by <= 1, F.col("district")).alias("district"), F.when(by == 0, F.col("mandi_name")).alias("market"),
        F.when(located | unknown, F.col("latitude") + (e % 50).cast("double") / 100.0).alias("latitude"),
        F.when(located | unknown, F.col("longitude") - (e % 30).cast("double") / 100.0).alias("longitude"),
        (100 + e % 900).cast("double").alias("quantity_kg"),
        whole(F.col("value") * 1000).alias("requested_loan_amount"),
        choose(e % 5, F.lit("a"), F.lit(" B "), F.lit("C"), F.lit("X"), F.lit(None).cast("string")).alias("warehouse_grade"))


def user_days(spark, d) -> DataFrame:
    """Per user and day: whole-number readings that stand in for a weather service's answer."""
    e = table(spark, d, "events").select("user_id", day("ts").alias("date"), whole("value").alias("v"))
    k = F.col("user_id") + F.dayofyear("date")
    daily = e.groupBy("user_id", "date").agg(F.max("v").alias("top"), F.min("v").alias("low"), F.count("*").alias("n"))
    return daily.select(
        "user_id", "date", F.when(k % 11 == 0, F.lit(-999.0)).otherwise(F.col("top")).alias("t"),
        F.when(k % 7 == 0, F.lit(-999.0)).otherwise(F.col("n").cast("double")).alias("rain"),
        F.when(k % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("low")).alias("hum"),
        (F.col("top") - F.col("low")).alias("wind"), "top", "low")


def history_payloads(spark, d) -> DataFrame:
    """Date-keyed maps as JSON; a map is as long as the calendar."""
    key = F.date_format("date", "yyyyMMdd")

    def mapped(value: str) -> Column:
        return F.map_from_entries(F.collect_list(F.struct(key, F.col(value))))

    return user_days(spark, d).groupBy("user_id").agg(F.to_json(
        F.struct(F.struct(F.struct(
            mapped("t").alias("T2M"), mapped("rain").alias("PRECTOTCORR"), mapped("hum").alias("RH2M"),
            mapped("wind").alias("WS2M")).alias("parameter")).alias("properties")),
        {"ignoreNullFields": "false"}).alias("payload")).select(text(F.col("user_id")).alias("request_id"), "payload")


def forecast_payloads(spark, d) -> DataFrame:
    """Arrays of all days per user as JSON, in date order."""
    days = user_days(spark, d)
    entry = F.struct("date", "top", "low", "rain", "hum")
    packed = days.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("a"))
    return packed.select(text(F.col("user_id")).alias("request_id"), F.to_json(F.struct(F.struct(
        F.transform("a", lambda x: F.date_format(x["date"], "yyyy-MM-dd")).alias("time"),
        F.transform("a", lambda x: x["top"]).alias("temperature_2m_max"),
        F.transform("a", lambda x: x["low"]).alias("temperature_2m_min"),
        F.transform("a", lambda x: F.when(x["rain"] > -900, x["rain"])).alias("precipitation_sum"),
        F.transform("a", lambda x: x["hum"]).alias("relative_humidity_2m_max")).alias("daily")),
        {"ignoreNullFields": "false"}).alias("payload"))
