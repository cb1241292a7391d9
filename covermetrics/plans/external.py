"""External feeds derived from the base tables in their public raw layouts, then harmonised."""

from pyspark.sql import functions as F

from covermetrics.plans.registry import plan, sql_mean, sql_round
from covermetrics.sources import external as ext


def geography(b):
    """States and a country row in the raw geography layout."""
    states = b.states.select(F.lit("State").alias("level"), F.col("state").alias("geo_name"),
                             F.concat(F.lit("S"), F.lpad(F.col("state_id").cast("string"), 2, "0")).alias("iso_code"),
                             F.concat(F.lit("geoId/"), F.lpad(F.col("state_id").cast("string"), 2, "0")).alias("geo_id"))
    return states


def _state_geo():
    return F.concat(F.lit("geoId/"), F.lpad(F.col("state_id").cast("string"), 2, "0"))


def raw_alerts(b):
    placed = b.alerts.join(b.customers.select("customer_id", "state_id"), "customer_id")
    return placed.select(
        F.col("alert_id").alias("nws_alert_id"), F.concat(_state_geo(), F.lpad((F.col("customer_id") % 100).cast("string"), 3, "0")).alias("county_geo_id"),
        F.col("severity").alias("event_severity"), "event_type", F.col("reported_at").alias("onset_timestamp"),
        F.col("reported_at").alias("sent_timestamp"))


def raw_areas(b):
    placed = b.disasters.join(b.customers.select("customer_id", "state_id"), "customer_id")
    return placed.select(F.col("disaster_id").alias("disaster_declaration_record_id"), (F.col("disaster_id") % 50).alias("disaster_id"),
                         _state_geo().alias("state_geo_id"), F.concat(_state_geo(), F.lit("001")).alias("county_geo_id"), "designated_date")


def raw_declarations(b):
    return b.disasters.groupBy((F.col("disaster_id") % 50).alias("disaster_id")).agg(
        F.min("begin_date").alias("disaster_begin_date"), F.max("end_date").alias("disaster_end_date"),
        F.count(F.lit(1)).cast("double").alias("state_obligated_public_assistance_amount"))


def raw_floods(b):
    placed = b.flood_losses.join(b.customers.select("customer_id", "state_id"), "customer_id")
    return placed.select(F.col("flood_claim_id").alias("national_flood_insurance_program_claim_id"), _state_geo().alias("state_geo_id"),
                         F.concat(F.lit("zip/"), F.lpad((F.col("customer_id") % 1000).cast("string"), 5, "0")).alias("zip_geo_id"),
                         F.col("loss_date").alias("date_of_loss"), F.col("building_damage").alias("building_damage_amount"))


# Each product line stands for one raw price variable.
VARIABLES = {
    "STANDARD": ("CPI:_Motor_vehicle_insurance,_Not_seasonally_adjusted,_Monthly", "Motor vehicle insurance index, monthly"),
    "ECONOMY": ("CPI:_Medical_care,_Not_seasonally_adjusted,_Monthly", "Medical care percent change, quarterly"),
    "MEDIUM": ("CPI:_Shelter,_Not_seasonally_adjusted,_Monthly", "Shelter average price, annual"),
    "PROMO": ("CPI:_All_items,_Not_seasonally_adjusted,_Monthly", "All items"),
    "SMALL": ("CPI:_All_items_less_food,_Not_seasonally_adjusted,_Monthly", "All items less food, monthly"),
    "LARGE": ("CPI:_Tenants_insurance,_Not_seasonally_adjusted,_Monthly", "Tenants insurance index"),
}
SERIES = {"STANDARD": "FEDFUNDS", "ECONOMY": "MORTGAGE30US", "MEDIUM": "UNRATE", "PROMO": "GDP", "SMALL": "SP500", "LARGE": "NOT_KEPT"}


def line_series(b):
    """Monthly mean claim of each product line."""
    per_part = b.claims.groupBy("part_id", F.trunc("claim_date", "month").alias("date")).agg(F.sum("amount").alias("a"), F.count(F.lit(1)).alias("n"))
    return per_part.join(b.products.select("part_id", "line"), "part_id").groupBy("line", "date").agg(
        F.round((F.sum("a").cast("double") / F.sum("n")).cast("decimal(38,6)"), 2).cast("double").alias("value"))


def _lookup(mapping):
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[F.col("line")]


def raw_prices(b):
    return line_series(b).select(F.lit("country/USA").alias("geo_id"), _lookup({k: v[0] for k, v in VARIABLES.items()}).alias("variable"),
                                 _lookup({k: v[1] for k, v in VARIABLES.items()}).alias("variable_name"), "date", "value")


def raw_economic(b):
    return line_series(b).select(_lookup(SERIES).alias("series_id"), F.initcap("line").alias("series_name"), F.lit("Mean").alias("units"),
                                 F.lit("Monthly").alias("frequency"), "date", "value")


LINE_SERIES = f"""line_series AS (SELECT line, CAST(DATE_TRUNC('month', claim_date) AS DATE) AS date, {sql_mean('amount', 2)} AS value
FROM claims JOIN products USING (part_id) GROUP BY 1, 2)"""


def _case(mapping):
    return "CASE line " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@plan("ext_weather_alerts", "S12 E1 E2 J18 P1 F4 T6", roles="alerts customers states", sql="""
SELECT 'S' || LPAD(CAST(state_id AS VARCHAR), 2, '0') AS state, LPAD(CAST(state_id AS VARCHAR), 2, '0') || LPAD(CAST(customer_id % 100 AS VARCHAR), 3, '0') AS county_fips,
       severity AS event_severity, COUNT(*) AS alerts, MIN(reported_at) AS first_begin FROM alerts JOIN customers USING (customer_id) GROUP BY 1, 2, 3""")
def _(b):
    clean = ext.weather_alerts(raw_alerts(b), ext.state_lookup(geography(b)))
    return clean.groupBy("state", "county_fips", "event_severity").agg(F.count(F.lit(1)).alias("alerts"), F.min("event_begin").alias("first_begin"))


@plan("ext_disaster_history", "E3 J1 J2", roles="disasters customers", sql="""
WITH d AS (SELECT disaster_id % 50 AS disaster_id, MIN(begin_date) AS begin_date, COUNT(*) AS pa FROM disasters GROUP BY 1)
SELECT 'S' || LPAD(CAST(state_id AS VARCHAR), 2, '0') AS state, a.disaster_id % 50 AS disaster_id, designated_date, d.begin_date AS disaster_begin_date, CAST(pa AS DOUBLE) AS pa_amount
FROM disasters a JOIN customers USING (customer_id) JOIN d ON d.disaster_id = a.disaster_id % 50""")
def _(b):
    return ext.disaster_history(raw_areas(b), raw_declarations(b), ext.state_lookup(geography(b))).select(
        "state", "disaster_id", "designated_date", "disaster_begin_date", "pa_amount")


@plan("ext_disaster_areas", "E3", roles="disasters customers", sql="""
SELECT disaster_id AS record_id, 'S' || LPAD(CAST(state_id AS VARCHAR), 2, '0') AS state, LPAD(CAST(state_id AS VARCHAR), 2, '0') || '001' AS county_fips, designated_date
FROM disasters JOIN customers USING (customer_id)""")
def _(b):
    return ext.disaster_areas(raw_areas(b), ext.state_lookup(geography(b))).select("record_id", "state", "county_fips", "designated_date")


@plan("ext_flood_claims", "E4 P2", roles="flood_losses customers", sql=f"""
SELECT 'S' || LPAD(CAST(state_id AS VARCHAR), 2, '0') AS state, LPAD(CAST(customer_id % 1000 AS VARCHAR), 5, '0') AS zip_code, COUNT(*) AS claims,
       {sql_round('SUM(building_damage)', 2)} AS damage FROM flood_losses JOIN customers USING (customer_id) GROUP BY 1, 2""")
def _(b):
    clean = ext.flood_records(raw_floods(b), ext.state_lookup(geography(b)), "national_flood_insurance_program_claim_id", "claim_id")
    return clean.groupBy("state", "zip_code").agg(F.count("claim_id").alias("claims"), F.sum("building_damage_amount").cast("double").alias("damage"))


@plan("ext_flood_policies", "E4 P2", roles="policies customers", sql=f"""
SELECT 'S' || LPAD(CAST(state_id AS VARCHAR), 2, '0') AS state, LPAD(CAST(customer_id % 1000 AS VARCHAR), 5, '0') AS zip_code, COUNT(*) AS policies,
       {sql_round('SUM(premium)', 2)} AS premium, {sql_round('SUM(coverage)', 2)} AS coverage, MAX(expiration_date) AS last_termination FROM policies JOIN customers USING (customer_id) GROUP BY 1, 2""")
def _(b):
    placed = b.policies.join(b.customers.select("customer_id", "state_id"), "customer_id")
    raw = placed.select(F.col("policy_id").alias("national_flood_insurance_program_policy_id"), _state_geo().alias("state_geo_id"),
                        F.concat(F.lit("zip/"), F.lpad((F.col("customer_id") % 1000).cast("string"), 5, "0")).alias("zip_geo_id"),
                        F.col("premium").alias("total_insurance_premium_of_the_policy"), F.col("coverage").alias("total_building_insurance_coverage"),
                        F.col("expiration_date").alias("policy_termination_date"))
    clean = ext.flood_policies(raw, ext.state_lookup(geography(b)))
    return clean.groupBy("state", "zip_code").agg(
        F.count("nfip_policy_id").alias("policies"), F.sum("premium").cast("double").alias("premium"),
        F.sum("total_building_insurance_coverage").cast("double").alias("coverage"), F.max("policy_termination_date").alias("last_termination"))


@plan("ext_price_index", "E5 P11", roles="claims products", sql=f"""
WITH {LINE_SERIES}, r AS (SELECT {_case({k: v[0] for k, v in VARIABLES.items()})} AS series_id, {_case({k: v[1] for k, v in VARIABLES.items()})} AS n, date, value FROM line_series)
SELECT series_id, n AS series_name, date AS observation_date, value, CASE WHEN n ILIKE '%index%' THEN 'Index' WHEN n ILIKE '%percent%' THEN 'Percent' WHEN n ILIKE '%average price%' THEN 'USD' ELSE 'Index' END AS unit,
CASE WHEN n ILIKE '%monthly%' THEN 'Monthly' WHEN n ILIKE '%quarterly%' THEN 'Quarterly' WHEN n ILIKE '%annual%' THEN 'Annual' ELSE 'Monthly' END AS frequency FROM r WHERE date >= DATE '1996-01-01'""")
def _(b):
    return ext.price_index(raw_prices(b), "1996-01-01").drop("geo_id")


@plan("ext_insurance_indices", "E6 P9 P10 P13", roles="claims products", sql=f"""
WITH {LINE_SERIES}, r AS (SELECT {_case({k: v[0] for k, v in VARIABLES.items()})} AS v, date, value FROM line_series)
SELECT date AS observation_date, v AS series_id, value AS index_value, CASE WHEN v LIKE '%Motor_vehicle_insurance%' THEN 'Auto Insurance' WHEN v LIKE '%Medical_care%' THEN 'Medical Care'
WHEN v LIKE '%Shelter%' THEN 'Shelter' WHEN v LIKE '%All_items%' AND v NOT LIKE '%less%' THEN 'All Items' WHEN v LIKE '%Tenants%' THEN 'Renters Insurance' ELSE 'Other' END AS insurance_category
FROM r WHERE v LIKE '%Not_seasonally_adjusted%' AND v NOT LIKE '%All_items_less%'""")
def _(b):
    return ext.insurance_price_indices(raw_prices(b)).drop("geo_id", "series_name")


@plan("ext_economic_series", "E7 P7", roles="claims products", sql=f"""
WITH {LINE_SERIES} SELECT {_case(SERIES)} AS series_id, date AS observation_date, value FROM line_series WHERE line <> 'LARGE'""")
def _(b):
    return ext.economic_series(raw_economic(b)).select("series_id", "observation_date", "value")


@plan("ext_series_catalog", "E7", roles="claims products", sql=f"""
WITH {LINE_SERIES} SELECT {_case(SERIES)} AS series_id, MIN(date) AS earliest_date, MAX(date) AS latest_date, COUNT(*) AS observation_count FROM line_series GROUP BY 1""")
def _(b):
    return ext.series_catalog(raw_economic(b)).drop("series_name", "units", "frequency")


@plan("ext_latest_and_year_ago", "E7 J20", roles="claims products", sql=f"""
WITH {LINE_SERIES}, s AS (SELECT {_case(SERIES)} AS series_id, date, value FROM line_series WHERE line <> 'LARGE'),
l AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date DESC) = 1),
y AS (SELECT l.*, (SELECT ARG_MAX(s.value, s.date) FROM s WHERE s.series_id = l.series_id AND s.date <= CAST(l.date - INTERVAL 12 MONTH AS DATE)) AS past FROM l)
SELECT series_id, date AS observation_date, value AS latest, past AS year_ago, {sql_round('value - past', 2)} AS change_points FROM y""")
def _(b):
    return ext.latest_and_year_ago(ext.economic_series(raw_economic(b)))


@plan("ext_zip_demographics", "E8", roles="customers", sql=f"""
SELECT LPAD(CAST(customer_id % 1000 AS VARCHAR), 5, '0') AS zip_code, segment AS variable, COUNT(*) AS surveys, {sql_mean('credit_score', 2)} AS mean_value FROM customers GROUP BY 1, 2""")
def _(b):
    raw = b.customers.select(F.concat(F.lit("zip/"), F.lpad((F.col("customer_id") % 1000).cast("string"), 5, "0")).alias("geo_id"),
                             F.col("segment").alias("variable"), F.col("credit_score").alias("value"))
    from covermetrics.functions.numbers import mean
    return ext.zip_demographics(raw).groupBy("zip_code", "variable").agg(F.count(F.lit(1)).alias("surveys"), mean("value", 2).alias("mean_value"))


@plan("ext_hospital_rates", "E9 P3", roles="claims", sql=f"""
SELECT adjuster_id AS hospital_ccn, cause AS payer, COUNT(*) AS rates, {sql_mean('amount', 2)} AS mean_rate FROM claims GROUP BY 1, 2""")
def _(b):
    raw = b.claims.select(F.col("adjuster_id").alias("ccn"), F.col("cause").alias("payer_name_canonical"), F.col("amount").alias("rate_amount"))
    from covermetrics.functions.numbers import mean
    return ext.hospital_rates(raw).groupBy("hospital_ccn", "payer").agg(F.count(F.lit(1)).alias("rates"), mean("rate_amount", 2).alias("mean_rate"))
