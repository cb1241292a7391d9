import datetime as dt

from pyspark.sql import functions as F

from covermetrics.functions.masking import mask_credit, mask_email, mask_phone
from covermetrics.operators import geo, timeseries
from covermetrics.operators.cube import Domain, Measure, Parent, Perspective, SemanticModel
from covermetrics.sources import external as ext
from covermetrics.sources.tables import merge_partitions
from covermetrics.session import scratch_path


def test_fips_codes_keep_their_leading_zero(spark):
    geography = spark.createDataFrame([("State", "Arkansas", "AR", "geoId/05"), ("County", "X", "X", "geoId/05001")], "level string, geo_name string, iso_code string, geo_id string")
    lookup = ext.state_lookup(geography)
    raw = spark.createDataFrame([(1, "geoId/05001", dt.datetime(2023, 1, 1)), (2, "geoId/50001", dt.datetime(2023, 1, 1)), (3, "geoId/05001", dt.datetime(2020, 1, 1))],
                                "nws_alert_id int, county_geo_id string, onset_timestamp timestamp_ntz")
    assert {r.alert_id: r.state for r in ext.weather_alerts(raw, lookup).collect()} == {1: "AR", 2: None}


def test_index_categories(spark):
    base = "CPI:_{},_Not_seasonally_adjusted,_Monthly"
    names = ["Motor_vehicle_insurance", "Motor_vehicle_parts", "Medical_care", "Shelter", "All_items", "Tenants_insurance", "Bread"]
    raw = spark.createDataFrame([(base.format(n), n, dt.date(2023, 1, 1), 1.0, "country/USA") for n in names], "variable string, variable_name string, date date, value double, geo_id string")
    got = {r.series_name: r.insurance_category for r in ext.insurance_price_indices(raw).collect()}
    assert got == {"Motor_vehicle_insurance": "Auto Insurance", "Motor_vehicle_parts": "Vehicle Repair", "Medical_care": "Medical Care", "Shelter": "Shelter",
                   "All_items": "All Items", "Tenants_insurance": "Renters Insurance"}


def test_masks_hide_values(spark):
    def seen(role):
        row = spark.range(1).select(mask_email(F.lit("anna@mail.org"), role).alias("e"), mask_phone(F.lit("(555) 123-4567"), role).alias("p"), mask_credit(F.lit(700), role).alias("c"))
        return tuple(row.collect()[0])
    assert seen("CLAIMS") == ("an****@mail.org", "(***) ***-4567", None)
    assert seen("UNDERWRITER") == ("an****@mail.org", "(***) ***-4567", 700)
    assert seen("EXECUTIVE") == ("anna@mail.org", "(555) 123-4567", 700)


def test_forecast_of_an_exact_line_and_short_series(spark):
    rows = [("up", dt.date(2022 + m // 12, m % 12 + 1, 1), 100.0 + 10 * m) for m in range(36)] + [("short", dt.date(2024, 1, 1), 5.0), ("short", dt.date(2024, 2, 1), 6.0)]
    series = spark.createDataFrame(rows, "series string, month date, value double")
    got = {(r.series, r.month): r for r in timeseries.forecast(series, 2).collect()}
    r = got[("up", dt.date(2025, 1, 1))]
    assert (r.forecast, r.lower_bound, r.upper_bound) == (460.0, 460.0, 460.0)
    assert got[("short", dt.date(2024, 3, 1))].forecast is None


def test_anomaly_is_flagged(spark):
    rows = [("s", dt.date(2020 + m // 12, m % 12 + 1, 1), 100.0 + (m * 7 % 5) + (500 if m == 46 else 0)) for m in range(48)]
    out = timeseries.detect_anomalies(spark.createDataFrame(rows, "series string, month date, value double"))
    worst = out.orderBy(F.desc(F.abs("distance"))).first()
    assert worst.month == dt.date(2023, 11, 1) and worst.is_anomaly and worst.percentile == 1.0
    assert out.filter("month < '2023-10-01' and abs(distance) > 3").count() == 0


def test_child_measures_do_not_multiply_the_base(spark):
    frames = {"p": spark.createDataFrame([(1, "a", 100), (2, "b", 50)], "pid int, t string, premium int"),
              "c": spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "pid int, paid int")}
    model = SemanticModel({"P": Domain("p", {"T": Perspective("t", "t")}, {"Premium": Measure("sum", "premium"), "Paid": Measure("sum", "paid", 0, "c", "pid")}),
                           "C": Domain("c", {"T": Perspective("t", "t", (Parent("p", "pid", "pid"),))}, {"N": Measure("count"), "Top": Measure("max", "paid")})})
    assert sorted(map(tuple, model.query(frames.get, "P", ["T"], ["Premium", "Paid"]).collect())) == [("a", 100.0, 11.0), ("b", 50.0, 7.0)]
    assert sorted(map(tuple, model.query(frames.get, "C", ["T"], ["N", "Top"]).collect())) == [("a", 2.0, 6.0), ("b", 1.0, 7.0)]


def test_open_ended_disaster_window(spark):
    customers = spark.createDataFrame([(1, 7)], "customer_id int, state_id int")
    d = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1), None, dt.date(2024, 1, 3))], "disaster_id int, customer_id int, begin_date date, end_date date, designated_date date")
    w = geo.disaster_windows(d, customers).collect()[0]
    assert (w.begin_date, w.end_date) == (dt.date(2024, 1, 1), dt.date(2024, 2, 2))


def test_merge_rewrites_only_touched_partitions(spark):
    root = scratch_path(spark, "t-merge")
    rows = spark.range(20).select("id", (F.col("id") * 10).alias("v"), (F.col("id") % 4).cast("int").alias("slot"))
    rows.write.partitionBy("slot").parquet(root)

    def files():
        return {r.slot: r.f for r in spark.read.parquet(root).select("slot", F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    incoming = spark.createDataFrame([(1, 7, 1), (21, 8, 1)], "id long, v long, slot int")
    merge_partitions(root, incoming, ["id"], ["v"], ["v"], "slot")
    after, got = files(), {r.id: r.v for r in spark.read.parquet(root).collect()}
    assert got == {**{i: i * 10 for i in range(20)}, 1: 7, 21: 8}
    assert [s for s in before if before[s] != after[s]] == [1]
