"""The semantic model over the bound tables, and queries through it."""

from pyspark.sql import functions as F

from covermetrics.operators.claims import COARSE_FRAUD_EDGES, COARSE_FRAUD_LAST, CREDIT_EDGES, CREDIT_LAST
from covermetrics.operators.cube import Domain, Measure, Parent, Perspective, SemanticModel, describe
from covermetrics.operators.quality import profile, scores
from covermetrics.operators.retention import risk_summary
from covermetrics.plans.quality import HEALTH, HISTORY, _health_sql, history
from covermetrics.plans.registry import plan, sql_mean, sql_round
from covermetrics.plans.servicing import FEATURES, features

POLICY = Parent("policies", "policy_id", "policy_id")
OWNER = Parent("customers", "customer_id", "customer_id")
PLACE = Parent("states", "state_id", "state_id")
ADJUSTER = Parent("agents", "adjuster_id", "agent_id")
PART = Parent("products", "part_id", "part_id")


def _by(label, expr=None, *via):
    return Perspective(label, expr or label, tuple(via))


def _bands(column, edges, last):
    return "CASE " + " ".join(f"WHEN {column} < {edge} THEN '{label}'" for edge, label in edges) + f" ELSE '{last}' END"


CREDIT = _bands("credit_score", CREDIT_EDGES, CREDIT_LAST)
FRAUD = _bands("fraud_score", COARSE_FRAUD_EDGES, COARSE_FRAUD_LAST)

MODEL = SemanticModel({
    "Claims": Domain("claims", {
        "By State": _by("state", None, POLICY, OWNER, PLACE),
        "By Policy Type": _by("policy_type", None, POLICY),
        "By Cause of Loss": _by("cause"),
        "By Status": _by("status"),
        "By Fraud Band": _by("fraud_band", FRAUD),
        "By Month": _by("month", "TRUNC(claim_date, 'month')"),
        "By Friction Reason": _by("friction_reason"),
        "By Product Line": _by("line", None, PART),
    }, {
        "Claim Count": Measure("count"), "Total Claim Amount": Measure("sum", "amount"), "Avg Claim Amount": Measure("avg", "amount"),
        "Avg Fraud Score": Measure("avg", "fraud_score", 1), "Avg Resolution Days": Measure("avg", "resolution_days", 1),
        "Max Claim Amount": Measure("max", "amount"),
    }),
    "Policies": Domain("policies", {
        "By Type": _by("policy_type"), "By State": _by("state", None, OWNER, PLACE), "By Line of Business": _by("line_of_business"),
        "By Status": _by("status"), "By Month": _by("month", "TRUNC(effective_date, 'month')"), "By Segment": _by("segment", None, OWNER),
    }, {
        "Policy Count": Measure("count"), "Total Premium": Measure("sum", "premium"), "Avg Premium": Measure("avg", "premium"),
        "Avg Coverage": Measure("avg", "coverage"), "Avg Underwriting Score": Measure("avg", "underwriting_score", 1),
        "Total Expense": Measure("sum", "expense"), "Total Paid Claims": Measure("sum", "paid", 0, "claims", "policy_id"),
    }),
    "Customers": Domain("customers", {
        "By Risk Tier": _by("risk_tier"), "By Segment": _by("segment"), "By State": _by("state", None, PLACE), "By Credit Band": _by("credit_band", CREDIT),
    }, {
        "Customer Count": Measure("count"), "Avg Credit Score": Measure("avg", "credit_score"), "Min Credit Score": Measure("min", "credit_score"),
        "Max Credit Score": Measure("max", "credit_score"),
    }),
    "Billing": Domain("invoices", {
        "By Payment Status": _by("payment_status"), "By Payment Method": _by("payment_method"), "By Month": _by("month", "TRUNC(due_date, 'month')"),
    }, {
        "Invoice Count": Measure("count"), "Total Outstanding": Measure("sum", "outstanding"), "Total Late Fees": Measure("sum", "late_fee"),
        "Avg Amount Due": Measure("avg", "amount_due"), "Total Amount Paid": Measure("sum", "amount_paid"),
    }),
    "Weather": Domain("alerts", {
        "By State": _by("state", None, OWNER, PLACE), "By Event Type": _by("event_type"), "By Severity": _by("severity"),
        "By Month": _by("month", "TRUNC(CAST(reported_at AS DATE), 'month')"),
    }, {"Alert Count": Measure("count")}, "reported_at >= '2024-01-01'"),
    "Disasters": Domain("disasters", {
        "By State": _by("state", None, OWNER, PLACE), "By Year": _by("year", "YEAR(designated_date)"),
    }, {"Disaster Count": Measure("count"), "Distinct Disasters": Measure("count_distinct", "disaster_id")}, "designated_date >= '1996-01-01'"),
    "Economic": Domain("price_series", {
        "By Series": _by("series_id"), "By Month": _by("observation_date"),
    }, {"Latest Value": Measure("max", "value"), "Avg Value": Measure("avg", "value", 2)}, "observation_date >= '1997-01-01'"),
})


def tables(b):
    def load(name):
        if name == "price_series":
            return b.policies.groupBy(F.col("policy_type").alias("series_id"), F.trunc("effective_date", "month").alias("observation_date")).agg(
                F.max("premium").alias("value"))
        return b.role(name)
    return load


PRICE_SERIES = "price_series AS (SELECT policy_type AS series_id, CAST(DATE_TRUNC('month', effective_date) AS DATE) AS observation_date, MAX(premium) AS value FROM policies GROUP BY 1, 2)"
WIDE_CLAIMS = """wide_claims AS (SELECT c.*, p.policy_type, s.state, r.line FROM claims c JOIN policies p USING (policy_id) JOIN customers u ON u.customer_id = p.customer_id
JOIN states s ON s.state_id = u.state_id JOIN products r ON r.part_id = c.part_id)"""
WIDE_POLICIES = """wide_policies AS (SELECT p.*, s.state, u.segment, x.paid FROM policies p JOIN customers u USING (customer_id) JOIN states s ON s.state_id = u.state_id
LEFT JOIN (SELECT policy_id, SUM(paid) AS paid FROM claims GROUP BY 1) x ON x.policy_id = p.policy_id)"""


def _matrix_sql(source, dims, measures, where="TRUE"):
    parts = []
    for name, expr in dims.items():
        for m, agg in measures.items():
            parts.append(f"SELECT '{name}' AS perspective, CAST({expr} AS VARCHAR) AS label, '{m}' AS measure, CAST({agg} AS DOUBLE) AS value "
                         f"FROM {source} WHERE {where} AND {expr} IS NOT NULL GROUP BY {expr}")
    return " UNION ALL ".join(parts)


def _month(c):
    return f"CAST(DATE_TRUNC('month', {c}) AS DATE)"


@plan("cube_claims_matrix", "C1 C2 C6", roles="claims policies customers states products", sql=f"WITH {WIDE_CLAIMS} " + _matrix_sql("wide_claims", {
    "By State": "state", "By Policy Type": "policy_type", "By Cause of Loss": "cause", "By Status": "status", "By Fraud Band": FRAUD, "By Month": _month("claim_date"),
    "By Friction Reason": "friction_reason", "By Product Line": "line",
}, {"claim_count": "COUNT(*)", "total_claim_amount": sql_round("SUM(amount)", 0), "avg_claim_amount": sql_mean("amount", 0), "avg_fraud_score": sql_mean("fraud_score", 1),
    "avg_resolution_days": sql_mean("resolution_days", 1), "max_claim_amount": "MAX(amount)"}))
def _(b):
    return MODEL.matrix(tables(b), "Claims")


@plan("cube_policies_matrix", "C1 C2 C6", roles="claims policies customers states", sql=f"WITH {WIDE_POLICIES} " + _matrix_sql("wide_policies", {
    "By Type": "policy_type", "By State": "state", "By Line of Business": "line_of_business", "By Status": "status", "By Month": _month("effective_date"), "By Segment": "segment",
}, {"policy_count": "COUNT(*)", "total_premium": sql_round("SUM(premium)", 0), "avg_premium": sql_mean("premium", 0), "avg_coverage": sql_mean("coverage", 0),
    "avg_underwriting_score": sql_mean("underwriting_score", 1), "total_expense": sql_round("SUM(expense)", 0), "total_paid_claims": sql_round("SUM(paid)", 0)}))
def _(b):
    return MODEL.matrix(tables(b), "Policies")


@plan("cube_customers_matrix", "C2", roles="customers states", sql="WITH wide AS (SELECT c.*, s.state FROM customers c JOIN states s USING (state_id)) " + _matrix_sql("wide", {
    "By Risk Tier": "risk_tier", "By Segment": "segment", "By State": "state", "By Credit Band": CREDIT},
    {"customer_count": "COUNT(*)", "avg_credit_score": sql_mean("credit_score", 0), "min_credit_score": "MIN(credit_score)", "max_credit_score": "MAX(credit_score)"}))
def _(b):
    return MODEL.matrix(tables(b), "Customers")


@plan("cube_billing_matrix", "C2", roles="invoices", sql=_matrix_sql("invoices", {
    "By Payment Status": "payment_status", "By Payment Method": "payment_method", "By Month": _month("due_date")},
    {"invoice_count": "COUNT(*)", "total_outstanding": sql_round("SUM(outstanding)", 0), "total_late_fees": sql_round("SUM(late_fee)", 0),
     "avg_amount_due": sql_mean("amount_due", 0), "total_amount_paid": sql_round("SUM(amount_paid)", 0)}))
def _(b):
    return MODEL.matrix(tables(b), "Billing")


@plan("cube_external_matrix", "C2 A5 F18", roles="alerts disasters customers states policies", sql=f"""
WITH {PRICE_SERIES}, w AS (SELECT a.*, s.state FROM alerts a JOIN customers USING (customer_id) JOIN states s USING (state_id)),
d AS (SELECT a.*, s.state FROM disasters a JOIN customers USING (customer_id) JOIN states s USING (state_id)) """
    + _matrix_sql("w", {"By State": "state", "By Event Type": "event_type", "By Severity": "severity", "By Month": _month("reported_at")},
                  {"alert_count": "COUNT(*)"}, "reported_at >= '2024-01-01'") + " UNION ALL "
    + _matrix_sql("d", {"By State": "state", "By Year": "YEAR(designated_date)"},
                  {"disaster_count": "COUNT(*)", "distinct_disasters": "COUNT(DISTINCT disaster_id)"}, "designated_date >= '1996-01-01'") + " UNION ALL "
    + _matrix_sql("price_series", {"By Series": "series_id", "By Month": "observation_date"},
                  {"latest_value": "MAX(value)", "avg_value": sql_mean("value", 2)}, "observation_date >= '1997-01-01'"))
def _(b):
    t = tables(b)
    return MODEL.matrix(t, "Weather").unionByName(MODEL.matrix(t, "Disasters")).unionByName(MODEL.matrix(t, "Economic"))


@plan("cube_explore", "C2 L1", roles="claims policies customers states products", sql=f"""
WITH {WIDE_CLAIMS} SELECT state, CAST({sql_mean('amount', 0)} AS DOUBLE) AS value FROM wide_claims GROUP BY 1 ORDER BY value DESC NULLS LAST, state LIMIT 50""")
def _(b):
    return MODEL.explore(tables(b), "Claims", "By State", "Avg Claim Amount")


@plan("cube_crosstab", "C3 A15", roles="claims policies", sql=f"""
WITH w AS (SELECT c.cause, p.policy_type, c.amount FROM claims c JOIN policies p USING (policy_id))
SELECT policy_type, {', '.join(f"COALESCE({sql_round(f'SUM(amount) FILTER (WHERE cause = {chr(39)}{v}{chr(39)})', 0)}, 0.0) AS {chr(34)}{v}{chr(34)}" for v in ('Hail', 'Collision', 'Water'))} FROM w GROUP BY 1""")
def _(b):
    return MODEL.crosstab(tables(b), "Claims", "By Policy Type", "By Cause of Loss", "Total Claim Amount", ["Hail", "Collision", "Water"])


@plan("cube_correlate_state", "C4 J19", roles="alerts claims policies customers states", sql=f"""
WITH a AS (SELECT state, CAST({sql_mean('amount', 0)} AS DOUBLE) AS value_a FROM claims JOIN policies USING (policy_id) JOIN customers USING (customer_id) JOIN states USING (state_id) GROUP BY 1),
w AS (SELECT state, CAST(COUNT(*) AS DOUBLE) AS value_b FROM alerts JOIN customers USING (customer_id) JOIN states USING (state_id) WHERE reported_at >= '2024-01-01' GROUP BY 1)
SELECT state, value_a, value_b, {sql_round('(SELECT CORR(value_a, value_b) FROM a JOIN w USING (state))', 4)} AS correlation FROM a JOIN w USING (state)""")
def _(b):
    return MODEL.correlate(tables(b), ("Claims", "By State", "Avg Claim Amount"), ("Weather", "By State", "Alert Count"))


@plan("cube_correlate_month", "C4 J19", roles="claims policies", sql=f"""
WITH a AS (SELECT {_month('claim_date')} AS month, {sql_round('SUM(amount)', 0)} AS value_a FROM claims GROUP BY 1),
w AS (SELECT {_month('effective_date')} AS month, {sql_round('SUM(premium)', 0)} AS value_b FROM policies GROUP BY 1)
SELECT month, value_a, value_b, {sql_round('(SELECT CORR(value_a, value_b) FROM a JOIN w USING (month))', 4)} AS correlation FROM a JOIN w USING (month)""")
def _(b):
    return MODEL.correlate(tables(b), ("Claims", "By Month", "Total Claim Amount"), ("Policies", "By Month", "Total Premium"))


@plan("cube_panel", "C5", roles="policies claims customers states", sql=f"""
WITH {WIDE_POLICIES} SELECT state, CAST(COUNT(*) AS DOUBLE) AS policy_count, {sql_round('SUM(premium)', 0)} AS total_premium, {sql_round('SUM(paid)', 0)} AS total_paid_claims
FROM wide_policies GROUP BY 1 ORDER BY policy_count DESC NULLS LAST, state LIMIT 10""")
def _(b):
    return MODEL.panel(tables(b), "Policies", "By State", ["Policy Count", "Total Premium", "Total Paid Claims"], 10)


@plan("cube_cards", "C5 A1", roles="invoices", sql=f"""
SELECT CAST(COUNT(*) AS DOUBLE) AS invoice_count, {sql_round('SUM(outstanding)', 0)} AS total_outstanding, {sql_mean('amount_due', 0)} AS avg_amount_due FROM invoices""")
def _(b):
    return MODEL.cards(tables(b), "Billing", ["Invoice Count", "Total Outstanding", "Avg Amount Due"])


def _describe_sql(table, columns):
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT({c}) AS n, {sql_round(f'AVG({c})', 4)} AS mean_value, {sql_round(f'STDDEV_SAMP({c})', 4)} AS std, "
                              f"CAST(MIN({c}) AS DOUBLE) AS low, CAST(MAX({c}) AS DOUBLE) AS high FROM {table}" for c in columns)


@plan("describe_columns", "A18", roles="claims", sql=_describe_sql("claims", ["fraud_score", "resolution_days", "line_number"]))
def _(b):
    return describe(b.claims, ["fraud_score", "resolution_days", "line_number"])


@plan("verified_premium_by_type", "C7", roles="policies", sql="SELECT policy_type, CAST(COUNT(*) AS DOUBLE) AS policy_count, "
      f"{sql_round('SUM(premium)', 0)} AS total_premium FROM policies GROUP BY 1")
def _(b):
    return MODEL.query(tables(b), "Policies", ["By Type"], ["Policy Count", "Total Premium"])


@plan("verified_claims_by_region", "C7", roles="claims agents states regions", sql=f"""
SELECT region, COUNT(*) AS claim_count, {sql_round('SUM(amount)', 2)} AS total_claimed, {sql_mean('fraud_score', 2)} AS avg_fraud_score
FROM claims c JOIN agents a ON a.agent_id = c.adjuster_id JOIN states USING (state_id) JOIN regions USING (region_id) GROUP BY 1""")
def _(b):
    per_agent = b.claims.groupBy("adjuster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("a"), F.sum("fraud_score").alias("f"), F.count("fraud_score").alias("fn"))
    places = b.agents.select(F.col("agent_id").alias("adjuster_id"), "state_id").join(b.states, "state_id").join(b.regions, "region_id")
    from covermetrics.functions.numbers import ratio, rounded
    return per_agent.join(places, "adjuster_id").groupBy("region").agg(
        F.sum("n").alias("claim_count"), rounded(F.sum("a"), 2).alias("total_claimed"), ratio(F.sum("f"), F.sum("fn"), 2).alias("avg_fraud_score"))


@plan("verified_risk_by_category", "C7 K31", roles="policies invoices claims", sql=f"""
WITH {FEATURES} SELECT risk_category, COUNT(*) AS at_risk, {sql_round('SUM(revenue_at_risk)', 2)} AS total_revenue_at_risk,
{sql_mean('CAST(churn_probability AS DECIMAL(9,4))', 4)} AS avg_churn FROM features GROUP BY 1""")
def _(b):
    return risk_summary(features(b), ["risk_category"]).drop("avg_missed")


@plan("verified_balance_by_status", "C7", roles="invoices", sql=f"""
SELECT payment_status, CAST(COUNT(*) AS DOUBLE) AS invoice_count, {sql_round('SUM(outstanding)', 0)} AS total_outstanding FROM invoices GROUP BY 1""")
def _(b):
    return MODEL.query(tables(b), "Billing", ["By Payment Status"], ["Invoice Count", "Total Outstanding"])


@plan("verified_risk_by_type_region", "C7", roles="policies invoices claims customers states regions", sql=f"""
WITH {FEATURES} SELECT policy_type, region, COUNT(DISTINCT policy_id) AS at_risk, {sql_round('SUM(revenue_at_risk)', 2)} AS total_revenue_at_risk
FROM features JOIN customers USING (customer_id) JOIN states USING (state_id) JOIN regions USING (region_id) GROUP BY 1, 2""")
def _(b):
    places = b.customers.select("customer_id", "state_id").join(b.states, "state_id").join(b.regions, "region_id")
    return risk_summary(features(b).join(places.select("customer_id", "region"), "customer_id"), ["policy_type", "region"]).drop("avg_churn", "avg_missed")


@plan("verified_failing_rules", "C7 Q20", roles="customers policies claims invoices", sql=f"""
WITH {HISTORY} SELECT rule_name, target_table, severity, COUNT(*) AS fail_count FROM results WHERE status = 'Fail' GROUP BY 1, 2, 3""")
def _(b):
    return scores.most_failing_rules(history(b), k=1000)


@plan("verified_current_scores", "C7 Q19", roles="customers policies claims invoices", sql=f"""
WITH {HISTORY} SELECT target_table, overall, completeness, validity, timeliness, trend FROM scores
QUALIFY ROW_NUMBER() OVER (PARTITION BY target_table ORDER BY run_date DESC) = 1""")
def _(b):
    return scores.latest_scores(scores.table_scores(history(b))).select("target_table", "overall", "completeness", "validity", "timeliness", "trend")


@plan("verified_worst_columns", "C7 Q21", roles="claims", sql=f"""
WITH {_health_sql('claims', *HEALTH)} SELECT table_name, column_name, null_rate, health_score FROM health ORDER BY health_score, column_name LIMIT 10""")
def _(b):
    health = profile.column_health(b.claims, "claims", *HEALTH)
    return health.select("table_name", "column_name", "null_rate", "health_score").orderBy("health_score", "column_name").limit(10)


