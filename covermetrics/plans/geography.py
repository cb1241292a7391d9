"""Geographic and external-data queries."""

from pyspark.sql import functions as F

from covermetrics.operators import geo
from covermetrics.plans.registry import plan, sql_mean, sql_percent, sql_ratio, sql_round
from covermetrics.sources import external as ext

ALERTS_SINCE = "2023-01-31"
DISASTERS_SINCE = "1996-01-01"
# The feeds here cover one month of a small book: levels scaled down from 1000 / 5000 alerts.
MANY, VERY_MANY, MANY_DISASTERS = 60, 90, 4

BY_STATE = f"""own AS (SELECT state_id, COUNT(*) AS policies, CAST(SUM(n) AS BIGINT) AS claims, SUM(premium) AS premium, SUM(i) AS incurred
FROM policies LEFT JOIN (SELECT policy_id, COUNT(*) AS n, SUM(amount) AS i FROM claims GROUP BY 1) USING (policy_id) JOIN customers USING (customer_id) GROUP BY 1),
weather AS (SELECT state_id, COUNT(*) AS severe_alerts FROM alerts JOIN customers USING (customer_id)
  WHERE severity IN ('Severe', 'Extreme') AND reported_at >= TIMESTAMP '{ALERTS_SINCE}' GROUP BY 1),
dis AS (SELECT state_id, COUNT(*) AS disasters, MAX(designated_date) AS last_disaster FROM disasters JOIN customers USING (customer_id) WHERE designated_date >= DATE '{DISASTERS_SINCE}' GROUP BY 1),
flood AS (SELECT state_id, COUNT(*) AS flood_claims, SUM(building_damage) AS damage FROM flood_losses JOIN customers USING (customer_id) WHERE loss_date >= DATE '{DISASTERS_SINCE}' GROUP BY 1)"""
STATE_ROLES = "policies claims customers alerts disasters flood_losses states"


def segments(b):
    return geo.pricing_segments(b.customers, b.policies, b.claims, b.alerts, b.disasters, b.states, ALERTS_SINCE, DISASTERS_SINCE)


@plan("geo_risk_scorecard", "E10 J6 J2 P4", roles=STATE_ROLES, sql=f"""
WITH {BY_STATE}, r AS (SELECT state, policies, COALESCE(claims, 0) AS claims, {sql_round('premium', 0)} AS total_premium, {sql_round('incurred', 0)} AS total_incurred,
 {sql_percent('incurred', 'premium')} AS loss_ratio, COALESCE(severe_alerts, 0) AS severe_weather, COALESCE(disasters, 0) AS disasters, last_disaster,
 COALESCE(flood_claims, 0) AS flood_claims, COALESCE({sql_ratio('damage', 'flood_claims', 0)}, 0.0) AS avg_flood_payout
FROM own JOIN states USING (state_id) LEFT JOIN weather USING (state_id) LEFT JOIN dis USING (state_id) LEFT JOIN flood USING (state_id))
SELECT *, CASE WHEN loss_ratio > 70 AND severe_weather > {MANY} THEN 'CRITICAL' WHEN loss_ratio > 50 OR severe_weather > {VERY_MANY} THEN 'HIGH'
               WHEN severe_weather > {MANY} OR disasters > {MANY_DISASTERS} THEN 'ELEVATED' ELSE 'NORMAL' END AS risk_level FROM r""")
def _(b):
    return geo.geo_risk_scorecard(b.customers, b.policies, b.claims, b.alerts, b.disasters, b.flood_losses, b.states,
                                  ALERTS_SINCE, DISASTERS_SINCE, MANY, VERY_MANY, MANY_DISASTERS)


@plan("weather_correlated_claims", "E11", roles=STATE_ROLES, sql=f"""
WITH {BY_STATE} SELECT state, COALESCE(claims, 0) AS claims, {sql_round('incurred', 0)} AS total_claimed, COALESCE(severe_alerts, 0) AS severe_weather_alerts,
CASE WHEN COALESCE(severe_alerts, 0) > {VERY_MANY} AND COALESCE(claims, 0) > 100 THEN 'HIGH RISK' WHEN COALESCE(severe_alerts, 0) > {MANY} THEN 'ELEVATED' ELSE 'NORMAL' END AS risk_level
FROM own JOIN states USING (state_id) LEFT JOIN weather USING (state_id) ORDER BY severe_weather_alerts DESC, state LIMIT 15""")
def _(b):
    return geo.weather_correlated_claims(b.customers, b.policies, b.claims, b.alerts, b.states, ALERTS_SINCE, many=MANY, very_many=VERY_MANY)


@plan("flood_benchmark", "E12 L2", roles=STATE_ROLES, sql=f"""
WITH {BY_STATE}, y AS (SELECT state_id, COUNT(*) AS your_policies, {sql_mean('premium', 0)} AS your_avg_premium FROM policies JOIN customers USING (customer_id)
WHERE policy_type IN ('1-URGENT', '2-HIGH') GROUP BY 1),
j AS (SELECT state, your_policies, your_avg_premium, flood_claims, {sql_ratio('damage', 'flood_claims', 0)} AS avg_flood_payout FROM y JOIN flood USING (state_id) JOIN states USING (state_id))
SELECT *, CASE WHEN avg_flood_payout > your_avg_premium THEN 'UNDERPRICED' ELSE 'OK' END AS flood_risk_flag FROM j ORDER BY avg_flood_payout DESC NULLS LAST, state LIMIT 15""")
def _(b):
    return geo.flood_benchmark(b.customers, b.policies, b.flood_losses, b.states, ["1-URGENT", "2-HIGH"], DISASTERS_SINCE)


SEGMENTS = f"""seg AS (SELECT state_id, policy_type, COUNT(*) AS policies, {sql_mean('premium', 0)} AS avg_premium, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS claims, {sql_percent('SUM(i)', 'SUM(premium)')} AS loss_ratio
FROM policies LEFT JOIN (SELECT policy_id, COUNT(*) AS n, SUM(amount) AS i FROM claims GROUP BY 1) USING (policy_id) JOIN customers USING (customer_id) GROUP BY 1, 2),
segments AS (SELECT state, policy_type, policies, avg_premium, claims, loss_ratio, COALESCE(disasters, 0) AS disasters, COALESCE(severe_alerts, 0) AS severe_alerts,
CASE WHEN loss_ratio > 90 THEN 'UNDERPRICED' WHEN loss_ratio > 75 THEN 'MARGINAL' WHEN loss_ratio > 50 THEN 'ADEQUATE' WHEN loss_ratio IS NOT NULL THEN 'PROFITABLE' END AS pricing_status
FROM seg JOIN states USING (state_id) LEFT JOIN weather USING (state_id) LEFT JOIN dis USING (state_id))"""


@plan("pricing_segments", "E13 T11", roles=STATE_ROLES, sql=f"WITH {BY_STATE}, {SEGMENTS} SELECT * FROM segments")
def _(b):
    return segments(b)


@plan("pricing_segments_filtered", "P18 E13", roles=STATE_ROLES, sql=f"""
WITH {BY_STATE}, {SEGMENTS} SELECT * FROM segments WHERE policy_type = '2-HIGH' AND pricing_status IN ('UNDERPRICED', 'MARGINAL') AND loss_ratio >= 80""")
def _(b):
    return geo.filter_segments(segments(b), policy_type="2-HIGH", statuses=["UNDERPRICED", "MARGINAL"], min_loss_ratio=80)


WINDOWS = "windows AS (SELECT disaster_id, state_id, begin_date, GREATEST(COALESCE(end_date, designated_date + 30), begin_date) AS end_date FROM disasters JOIN customers USING (customer_id))"
PLACED = "placed AS (SELECT state_id, claim_date, cause, amount FROM claims JOIN policies USING (policy_id) JOIN customers USING (customer_id))"


@plan("claims_in_disaster_window", "E14 J12", roles="claims policies customers disasters", sql=f"""
WITH {WINDOWS}, {PLACED} SELECT w.disaster_id, w.state_id, begin_date, end_date, COUNT(p.amount) AS claims, {sql_round('SUM(amount)', 2)} AS incurred
FROM windows w LEFT JOIN placed p ON p.state_id = w.state_id AND claim_date BETWEEN begin_date AND end_date GROUP BY 1, 2, 3, 4""")
def _(b):
    return geo.claims_per_disaster(geo.place_claims(b.claims, b.policies, b.customers), geo.disaster_windows(b.disasters, b.customers))


@plan("hail_claims_vs_alerts", "E17 J12", roles="claims policies customers disasters", sql=f"""
WITH {WINDOWS}, {PLACED}, h AS (SELECT p.state_id, EXISTS (SELECT 1 FROM windows w WHERE w.state_id = p.state_id AND claim_date BETWEEN begin_date - 7 AND end_date + 30) AS near
FROM placed p WHERE cause = 'Hail')
SELECT state_id, COUNT(*) AS claims, COUNT(*) FILTER (WHERE near) AS near_events, {sql_percent('COUNT(*) FILTER (WHERE near)', 'COUNT(*)', 2)} AS near_pct FROM h GROUP BY 1""")
def _(b):
    placed = geo.place_claims(b.claims.filter(F.col("cause") == "Hail"), b.policies, b.customers)
    return geo.share_near_events(placed, geo.disaster_windows(b.disasters, b.customers), 7, 30)


@plan("recent_severe_alerts", "E15 P12 L1", roles="alerts", sql="""
SELECT alert_id, event_type, severity, reported_at FROM alerts WHERE severity IN ('Severe', 'Extreme') AND reported_at >= TIMESTAMP '2024-01-24'
ORDER BY reported_at DESC, alert_id LIMIT 25""")
def _(b):
    recent = F.col("reported_at") >= F.lit("2024-01-24").cast("timestamp_ntz")
    return b.alerts.filter(F.col("severity").isin(*geo.SEVERE) & recent).select("alert_id", "event_type", "severity", "reported_at") \
        .orderBy(F.desc("reported_at"), "alert_id").limit(25)


@plan("severe_alerts_by_state", "E15", roles="alerts customers states", sql="""
SELECT state, COUNT(*) AS severe_alerts FROM alerts JOIN customers USING (customer_id) JOIN states USING (state_id)
WHERE severity IN ('Severe', 'Extreme') AND reported_at >= TIMESTAMP '2024-01-01' GROUP BY 1""")
def _(b):
    return geo.severe_alerts_by_state(b.alerts, b.customers, "2024-01-01").join(b.states, "state_id").select("state", "severe_alerts")


@plan("claims_vs_index_corr", "E16", roles="claims policies", sql=f"""
WITH c AS (SELECT CAST(DATE_TRUNC('month', claim_date) AS DATE) AS month, CAST(SUM(amount) AS DOUBLE) AS cost FROM claims GROUP BY 1),
i AS (SELECT CAST(DATE_TRUNC('month', effective_date) AS DATE) AS month, {sql_mean('premium', 4)} AS index_value FROM policies GROUP BY 1)
SELECT COUNT(*) AS months, {sql_round('CORR(cost, index_value)', 4)} AS correlation, {sql_round('AVG(cost)', 2)} AS mean_cost, {sql_round('AVG(index_value)', 2)} AS mean_index FROM c JOIN i USING (month)""")
def _(b):
    index = b.policies.groupBy(F.trunc("effective_date", "month").alias("month")).agg(geo.ratio(F.sum("premium"), F.count("premium"), 4).alias("index_value"))
    return geo.claims_vs_index(b.claims, index)


@plan("hazard_by_state", "E18 F27", roles="alerts customers policies", sql=f"""
WITH c AS (SELECT state_id, COUNT(*) FILTER (WHERE event_type = 'error') AS storms, COUNT(*) FILTER (WHERE event_type = 'purchase') AS floods,
  COUNT(*) FILTER (WHERE severity = 'Extreme') AS extreme FROM alerts JOIN customers USING (customer_id) GROUP BY 1),
h AS (SELECT state_id, {sql_round('CAST(0 AS DOUBLE) + storms * 0.5 + floods * 0.3 + extreme * 2', 2)} AS hazard FROM c),
l AS (SELECT *, CASE WHEN hazard < 60 THEN 'Low' WHEN hazard < 100 THEN 'Moderate' ELSE 'High' END AS hazard_level FROM h),
p AS (SELECT state_id, COUNT(*) AS policies, {sql_mean('premium', 2)} AS avg_premium FROM policies JOIN customers USING (customer_id) GROUP BY 1)
SELECT p.state_id, policies, avg_premium, hazard, COALESCE(hazard_level, 'Unknown') AS hazard_level, p.state_id % 3 = 0 AS coastal FROM p LEFT JOIN l USING (state_id)""")
def _(b):
    counts = geo.by_state(b.alerts, b.customers, {
        "storms": ("sum", F.count_if(F.col("event_type") == "error")), "floods": ("sum", F.count_if(F.col("event_type") == "purchase")),
        "extreme": ("sum", F.count_if(F.col("severity") == "Extreme"))})
    hazard = geo.hazard_index(counts, {"storms": 0.5, "floods": 0.3, "extreme": 2.0}, [(60, "Low"), (100, "Moderate")], "High")
    own = geo.by_state(b.policies, b.customers, {"policies": ("sum", F.count(F.lit(1))), "premium": ("sum", F.sum("premium"))})
    return own.join(hazard.select("state_id", "hazard", "hazard_level"), "state_id", "left").select(
        "state_id", "policies", geo.ratio("premium", "policies", 2).alias("avg_premium"), "hazard",
        F.coalesce("hazard_level", F.lit("Unknown")).alias("hazard_level"), (F.col("state_id") % 3 == 0).alias("coastal"))


@plan("hazard_by_zip", "E18", roles="alerts flood_losses customers policies", sql=f"""
WITH z AS (SELECT customer_id, state_id, LPAD(CAST(customer_id % 1000 AS VARCHAR), 5, '0') AS zip_code FROM customers),
a AS (SELECT state_id, zip_code, COUNT(*) FILTER (WHERE event_type = 'error') AS storms, COUNT(*) FILTER (WHERE event_type = 'purchase') AS floods, COUNT(*) FILTER (WHERE severity = 'Extreme') AS extreme FROM alerts JOIN z USING (customer_id) GROUP BY 1, 2),
l AS (SELECT state_id, zip_code, SUM(building_damage) AS lost FROM flood_losses JOIN z USING (customer_id) GROUP BY 1, 2),
p AS (SELECT state_id, zip_code, COUNT(*) AS policies, SUM(premium) AS premium FROM policies JOIN z USING (customer_id) GROUP BY 1, 2),
c AS (SELECT state_id, zip_code, COUNT(*) AS customers FROM z GROUP BY 1, 2),
j AS (SELECT c.*, COALESCE(policies, 0) AS policies, premium, COALESCE(storms, 0) AS storms, COALESCE(floods, 0) AS floods, COALESCE(extreme, 0) AS extreme, lost
      FROM c LEFT JOIN a USING (state_id, zip_code) LEFT JOIN l USING (state_id, zip_code) LEFT JOIN p USING (state_id, zip_code)),
h AS (SELECT *, {sql_round('CAST(0 AS DOUBLE) + CAST(storms AS DOUBLE) / customers * 0.5 + CAST(floods AS DOUBLE) / customers * 0.3 + CAST(extreme AS DOUBLE) / customers * 2', 2)} AS hazard FROM j)
SELECT state_id, zip_code, customers, policies, {sql_ratio('premium', 'policies', 2)} AS avg_premium, storms, floods, extreme, hazard,
CASE WHEN hazard < 1 THEN 'Low' WHEN hazard < 4 THEN 'Moderate' ELSE 'High' END AS hazard_level, {sql_round('COALESCE(CAST(lost AS DOUBLE), CAST(0 AS DOUBLE)) / CAST(7 AS DOUBLE)', 2)} AS expected_annual_loss FROM h""")
def _(b):
    customers = b.customers.withColumn("zip_code", F.lpad((F.col("customer_id") % 1000).cast("string"), 5, "0"))
    perils = {"storms": F.col("event_type") == "error", "floods": F.col("event_type") == "purchase", "extreme": F.col("severity") == "Extreme"}
    return geo.hazard_by_zip(b.alerts, b.flood_losses, customers, b.policies, perils, {"storms": 0.5, "floods": 0.3, "extreme": 2.0},
                             [(1, "Low"), (4, "Moderate")], "High", 7.0)


@plan("property_risk", "E19", roles="policies claims", sql=f"""
WITH x AS (SELECT policy_id, premium, 1930 + policy_id % 90 AS year_built, policy_id % 30 AS roof_age, CASE policy_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'V' ELSE 'X' END AS zone FROM policies),
b AS (SELECT policy_id, premium, CASE WHEN year_built < 1960 THEN 2 WHEN year_built < 1990 THEN 1 ELSE 0 END + CASE WHEN roof_age > 15 THEN 1 ELSE 0 END + CASE WHEN zone IN ('A', 'V') THEN 2 ELSE 0 END AS pts FROM x)
SELECT CASE WHEN pts >= 4 THEN 'High' WHEN pts >= 2 THEN 'Moderate' ELSE 'Low' END AS risk_band, COUNT(*) AS policies, {sql_percent('SUM(i)', 'SUM(premium)')} AS loss_ratio
FROM b LEFT JOIN (SELECT policy_id, SUM(amount) AS i FROM claims GROUP BY 1) USING (policy_id) GROUP BY 1""")
def _(b):
    p = b.policies.withColumn("risk_band", geo.property_band(
        F.lit(1930) + F.col("policy_id") % 90, F.col("policy_id") % 30,
        F.when(F.col("policy_id") % 5 == 0, "A").when(F.col("policy_id") % 5 == 1, "V").otherwise("X")))
    return p.join(geo.claims_per_policy(b.claims), "policy_id", "left").groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("policies"), geo.percent(F.sum("incurred"), F.sum("premium"), 1).alias("loss_ratio"))


@plan("state_map_points", "F27", roles="policies customers", sql=f"""
WITH p(i, state, latitude, longitude) AS (VALUES {', '.join(f"({i}, '{s}', CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))" for i, (s, (lat, lon)) in enumerate(ext.STATE_POINTS.items()))})
SELECT p.state, COUNT(*) AS policies, latitude, longitude FROM policies JOIN customers USING (customer_id) JOIN p ON p.i = state_id GROUP BY 1, 3, 4""")
def _(b):
    """The data's numbered states stand for the real ones in alphabetical order."""
    codes = F.array(*[F.lit(state) for state in ext.STATE_POINTS])
    own = geo.by_state(b.policies, b.customers, {"policies": ("sum", F.count(F.lit(1)))})
    return ext.with_points(own.select(F.get(codes, F.col("state_id")).alias("state"), "policies"), ext.state_points(b.spark))
