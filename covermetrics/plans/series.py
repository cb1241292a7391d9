"""Forecast, anomaly and scenario queries."""

from pyspark.sql import functions as F

from covermetrics.operators import geo, scenario, timeseries
from covermetrics.plans.geography import segments
from covermetrics.plans.registry import plan, sql_percent, sql_round
from covermetrics.plans.servicing import FEATURES, features


COUNT_SERIES = """series AS (SELECT policy_type AS series, CAST(DATE_TRUNC('month', claim_date) AS DATE) AS month, CAST(COUNT(*) AS DOUBLE) AS value
FROM claims JOIN policies USING (policy_id) GROUP BY 1, 2)"""


def count_series(b):
    per_policy = b.claims.groupBy("policy_id", F.trunc("claim_date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return per_policy.join(b.policies.select("policy_id", "policy_type"), "policy_id") \
        .groupBy(F.col("policy_type").alias("series"), "month").agg(F.sum("n").cast("double").alias("value"))


def cost_series(b):
    return timeseries.build_series(b.claims, "claim_date", "amount")


COST_SERIES = "series AS (SELECT 'all' AS series, CAST(DATE_TRUNC('month', claim_date) AS DATE) AS month, CAST(SUM(amount) AS DOUBLE) AS value FROM claims GROUP BY 2)"


def model_sql(p="", source="series"):
    """Line, seasonal effect and residual deviation; names carry prefix ``p``."""
    t = "CAST(YEAR(month) * 12 + MONTH(month) - 1 - 24000 AS DOUBLE)"
    return f"""{p}line AS (SELECT series, CASE WHEN COUNT(*) >= 3 THEN REGR_SLOPE(value, {t}) END AS slope, CASE WHEN COUNT(*) >= 3 THEN REGR_INTERCEPT(value, {t}) END AS intercept,
  MAX(month) AS last_month FROM {source} GROUP BY 1),
{p}resid AS (SELECT s.series, MONTH(month) AS moy, value - (intercept + slope * {t}) AS r FROM {source} s JOIN {p}line l ON l.series = s.series),
{p}season AS (SELECT series, moy, AVG(r) AS effect FROM {p}resid GROUP BY 1, 2),
{p}sigma AS (SELECT series, STDDEV_SAMP(r - effect) AS sigma FROM {p}resid JOIN {p}season USING (series, moy) GROUP BY 1)"""


def forecast_sql(periods, p="", source="series"):
    t = "CAST(YEAR(month) * 12 + MONTH(month) - 1 - 24000 AS DOUBLE)"
    return f"""{model_sql(p, source)},
{p}ahead AS (SELECT series, slope, intercept, CAST(last_month + h * INTERVAL 1 MONTH AS DATE) AS month FROM {p}line, (SELECT UNNEST(RANGE(1, {periods + 1})) AS h)),
{p}point AS (SELECT a.series, a.month, intercept + slope * {t} + COALESCE(effect, 0.0) AS y, sigma FROM {p}ahead a
  JOIN {p}sigma USING (series) LEFT JOIN {p}season s ON s.series = a.series AND s.moy = MONTH(a.month)),
{p}forecast AS (SELECT series, month, {sql_round('y', 2)} AS forecast, {sql_round('y - sigma * 1.96', 2)} AS lower_bound, {sql_round('y + sigma * 1.96', 2)} AS upper_bound FROM {p}point)"""


@plan("forecast_linear", "M2 X2 M1", roles="claims policies", sql=f"WITH {COUNT_SERIES}, {forecast_sql(6)} SELECT * FROM forecast")
def _(b):
    return timeseries.forecast(count_series(b), 6)


@plan("history_plus_forecast", "M3 U2", roles="claims", sql=f"""
WITH {COST_SERIES}, {forecast_sql(6)}
SELECT series, month, {sql_round('value', 2)} AS value, 'Historical' AS type FROM series UNION ALL SELECT series, month, forecast, 'Forecast' FROM forecast""")
def _(b):
    return timeseries.history_plus_forecast(cost_series(b), 6)


@plan("forecast_vs_recent", "M4", roles="claims policies", sql=f"""
WITH {COUNT_SERIES}, {forecast_sql(6)},
r AS (SELECT series, AVG(value) AS recent FROM (SELECT * FROM series QUALIFY ROW_NUMBER() OVER (PARTITION BY series ORDER BY month DESC) <= 6) GROUP BY 1),
f AS (SELECT series, AVG(forecast) AS ahead FROM forecast GROUP BY 1)
SELECT series, {sql_round('recent', 2)} AS recent_mean, {sql_round('ahead', 2)} AS forecast_mean, {sql_percent('ahead - recent', 'GREATEST(recent, 1.0)')} AS change_pct FROM f JOIN r USING (series)""")
def _(b):
    return timeseries.forecast_vs_recent(count_series(b))


@plan("widest_interval", "L8", roles="claims policies", sql=f"""
WITH {COUNT_SERIES}, {forecast_sql(6)}
SELECT series, month, lower_bound, upper_bound FROM forecast
QUALIFY ROW_NUMBER() OVER (PARTITION BY series ORDER BY {sql_round('upper_bound - lower_bound', 2)} DESC, month DESC) = 1""")
def _(b):
    return timeseries.widest_interval(timeseries.forecast(count_series(b), 6))


@plan("forecast_backtest", "M2 K7", roles="claims policies", sql=f"""
WITH {COUNT_SERIES}, cut AS (SELECT series, CAST(MAX(month) - INTERVAL 3 MONTH AS DATE) AS cut FROM series GROUP BY 1),
train AS (SELECT s.* FROM series s JOIN cut USING (series) WHERE month <= cut), {forecast_sql(3, source='train')}
SELECT s.series, COUNT(*) AS months, {sql_round('AVG(ABS(value - forecast) / NULLIF(value, 0) * 100)', 2)} AS mape, COUNT(*) FILTER (WHERE value BETWEEN lower_bound AND upper_bound) AS inside_bounds
FROM series s JOIN cut USING (series) JOIN forecast f ON f.series = s.series AND f.month = s.month WHERE s.month > cut GROUP BY 1""")
def _(b):
    return timeseries.backtest(count_series(b))


ANOMALY_SQL = f"""{COST_SERIES}, cut AS (SELECT series, CAST(MAX(month) - INTERVAL 3 MONTH AS DATE) AS cut FROM series GROUP BY 1),
train AS (SELECT s.* FROM series s JOIN cut USING (series) WHERE month < cut), {model_sql(source='train')},
e AS (SELECT s.series, month, value, intercept + slope * CAST(YEAR(month) * 12 + MONTH(month) - 1 - 24000 AS DOUBLE) + COALESCE(effect, 0.0) AS y, sigma
FROM series s JOIN line USING (series) JOIN sigma USING (series) LEFT JOIN season x ON x.series = s.series AND x.moy = MONTH(s.month))"""


@plan("anomaly_flags", "M6 X3", roles="claims", sql=f"""
WITH {ANOMALY_SQL}
SELECT series, month, {sql_round('value', 2)} AS actual, {sql_round('y', 2)} AS expected, {sql_round('(value - y) / sigma', 3)} AS distance,
       {sql_round('1.0 / (1.0 + EXP(-1.702 * (value - y) / sigma))', 3)} AS percentile, ABS({sql_round('(value - y) / sigma', 3)}) > 2 AS is_anomaly FROM e""")
def _(b):
    return timeseries.detect_anomalies(cost_series(b))


@plan("predicted_loss_ratio", "M5 T17", roles="claims policies", sql=f"""
WITH full_months AS (SELECT LEAST((SELECT DATE_TRUNC('month', MAX(claim_date)) FROM claims), (SELECT DATE_TRUNC('month', MAX(effective_date)) FROM policies)) AS until),
cost AS (SELECT 'all' AS series, CAST(DATE_TRUNC('month', claim_date) AS DATE) AS month, CAST(SUM(amount) AS DOUBLE) AS value FROM claims, full_months WHERE claim_date < until GROUP BY 2),
prem AS (SELECT 'all' AS series, CAST(DATE_TRUNC('month', effective_date) AS DATE) AS month, CAST(SUM(premium) AS DOUBLE) AS value FROM policies, full_months WHERE effective_date < until GROUP BY 2),
{forecast_sql(3, 'c_', 'cost')}, {forecast_sql(3, 'p_', 'prem')},
j AS (SELECT month, c.forecast AS predicted_cost, p.forecast AS predicted_premium, {sql_percent('c.forecast', 'p.forecast')} AS loss_ratio FROM c_forecast c LEFT JOIN p_forecast p USING (month))
SELECT *, CASE WHEN loss_ratio > 70 THEN 'error' WHEN loss_ratio > 50 THEN 'warning' WHEN loss_ratio IS NOT NULL THEN 'ok' END AS level FROM j""")
def _(b):
    # The last month of either table may be incomplete.
    full = F.least(*[df.agg(F.trunc(F.max(c), "month")).scalar() for df, c in ((b.claims, "claim_date"), (b.policies, "effective_date"))])
    return timeseries.predicted_loss_ratio(
        timeseries.build_series(b.claims.filter(F.col("claim_date") < full), "claim_date", "amount"),
        timeseries.build_series(b.policies.filter(F.col("effective_date") < full), "effective_date", "premium"))


@plan("series_of_any_column", "M1", roles="alerts", sql="""
SELECT event_type AS series, CAST(DATE_TRUNC('month', reported_at) AS DATE) AS month, CAST(ROUND(CAST(CAST(SUM(value) AS DOUBLE) / COUNT(value) AS DECIMAL(38,6)), 4) AS DOUBLE) AS value
FROM alerts GROUP BY 1, 2""")
def _(b):
    return timeseries.build_series(b.alerts, "reported_at", "value", "avg", by="event_type")


GRID = {"premium_pct": [-10, 0, 10], "churn_pct": [-10, 0, 10], "claims_pct": [-20, 0, 25], "inflation_pct": [0, 3], "cat_factor": [1, 1.5, 3], "interest_pct": [2, 5]}


@plan("scenario_grid", "M7 J8 J7", roles="claims policies", sql="WITH " + ", ".join(
    f"g{i} AS (SELECT CAST(UNNEST([{', '.join(str(float(x)) for x in v)}]) AS DOUBLE) AS {k})" for i, (k, v) in enumerate(GRID.items())) + f""",
b AS (SELECT CAST(SUM(premium) AS DOUBLE) AS bp, CAST(SUM(i) AS DOUBLE) AS bi, CAST(SUM(n) AS BIGINT) AS bn FROM policies LEFT JOIN (SELECT policy_id, SUM(amount) AS i, COUNT(*) AS n FROM claims GROUP BY 1) USING (policy_id)),
x AS (SELECT *, bp * (1 + premium_pct / 100) * (1 - churn_pct / 100) AS p, bi * (1 + claims_pct / 100) * (1 + inflation_pct / 100) * cat_factor AS i, bp * (interest_pct / 100) * 0.3 AS v
FROM g0, g1, g2, g3, g4, g5, b), y AS (SELECT *, {sql_round('i / GREATEST(p, 1) * 100', 1)} AS loss_ratio FROM x)
SELECT premium_pct, churn_pct, claims_pct, inflation_pct, cat_factor, interest_pct, {sql_round('p', 0)} AS premium, {sql_round('i', 0)} AS incurred,
CAST(FLOOR(bn * (1 + claims_pct / 100) * cat_factor) AS BIGINT) AS claims, loss_ratio, {sql_round('loss_ratio + 30', 1)} AS combined_ratio, {sql_round('v', 0)} AS investment_income,
{sql_round('p - i', 0)} AS underwriting_result, {sql_round('p - i + v', 0)} AS net_result FROM y""")
def _(b):
    return scenario.scenario_grid(b.policies, b.claims, scenario.lever_grid(b.spark, **GRID))


@plan("threshold_alerts", "M8 U1", roles="claims invoices policies customers", sql=f"""
WITH {ANOMALY_SQL}, {FEATURES}, seg AS (SELECT state_id, policy_type, {sql_percent('SUM(i)', 'SUM(premium)')} AS lr FROM policies LEFT JOIN (SELECT policy_id, SUM(amount) AS i FROM claims GROUP BY 1) USING (policy_id) JOIN customers USING (customer_id) GROUP BY 1, 2)
SELECT 'high_fraud_claims' AS alert, COUNT(*) AS n, {sql_round('SUM(amount)', 0)} AS amount FROM claims WHERE fraud_score > 80
UNION ALL SELECT 'overdue_invoices', COUNT(*), {sql_round('SUM(outstanding)', 0)} FROM invoices WHERE payment_status IN ('Overdue', 'PastDue')
UNION ALL SELECT 'high_churn_policies', COUNT(*), {sql_round('SUM(revenue_at_risk)', 0)} FROM features WHERE churn_probability > 0.7
UNION ALL SELECT 'underpriced_segments', COUNT(*), NULL FROM seg WHERE lr > 90
UNION ALL SELECT 'anomalous_months', COUNT(*), NULL FROM e WHERE ABS({sql_round('(value - y) / sigma', 3)}) > 2""")
def _(b):
    return scenario.threshold_alerts(b.claims, b.invoices, features(b), segments(b), timeseries.detect_anomalies(cost_series(b)))


@plan("brief_metrics", "K52 J11 P12 F17", roles="claims invoices policies", sql=f"""
WITH {FEATURES}, c AS (SELECT COUNT(*) AS new_claims, {sql_round('SUM(amount)', 0)} AS total_incurred, COUNT(*) FILTER (WHERE fraud_score > 80) AS high_fraud FROM claims WHERE claim_date >= DATE '2001-07-31' - 30),
p AS (SELECT COUNT(*) AS new_policies, {sql_round('SUM(premium)', 0)} AS new_premium FROM policies WHERE effective_date >= DATE '2001-07-31' - 30)
SELECT new_claims, total_incurred, new_policies, new_premium, (SELECT COUNT(*) FROM features WHERE churn_probability > 0.7) AS high_churn, high_fraud FROM c, p""")
def _(b):
    return scenario.brief_metrics(b.claims, b.policies, features(b), "2001-07-31", 30)


@plan("top_alert_type", "A17 L1", roles="alerts", sql="SELECT event_type, COUNT(*) AS n FROM alerts WHERE severity IN ('Severe', 'Extreme') GROUP BY 1 ORDER BY n DESC, event_type LIMIT 1")
def _(b):
    return scenario.most_common(b.alerts.filter(F.col("severity").isin(*geo.SEVERE)), "event_type")


