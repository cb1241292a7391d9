"""Data-quality queries over the bound tables."""

from pyspark.sql import functions as F

from covermetrics.functions.dates import month_of
from covermetrics.operators.claims import claims_by_region_month
from covermetrics.operators.quality import detect, profile, scores, similar
from covermetrics.operators.quality.rules import Rule, error_ids, rules_frame, run_rules
from covermetrics.plans.registry import plan, sql_mean, sql_percent, sql_round
from covermetrics.sources.book import AS_OF, BASE_TABLES

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# (rule, SQL that counts its failing rows)
BOOK_RULES = [
    (Rule("R01", "customers_unique_id", "customers", "customer_id", "Uniqueness", "unique", 100, "Critical"),
     "SELECT COUNT(*) - COUNT(DISTINCT customer_id) FROM customers"),
    (Rule("R02", "customers_email_format", "customers", "email", "Validity", "matches", 98, "High", {"like": "%@%.%"}),
     "SELECT COUNT(*) FROM customers WHERE email NOT LIKE '%@%.%'"),
    (Rule("R03", "customers_credit_range", "customers", "credit_score", "Validity", "in_range", 99, "Critical", {"low": 320, "high": 840}),
     "SELECT COUNT(*) FROM customers WHERE credit_score NOT BETWEEN 320 AND 840"),
    (Rule("R04", "customers_phone_length", "customers", "phone", "Validity", "length", 99, "Medium", {"n": 14}),
     "SELECT COUNT(*) FROM customers WHERE LENGTH(phone) != 14"),
    (Rule("R05", "customers_tier_valid", "customers", "risk_tier", "Validity", "allowed", 100, "Critical", {"values": ["Low", "Medium", "High"]}),
     "SELECT COUNT(*) FROM customers WHERE risk_tier NOT IN ('Low', 'Medium', 'High')"),
    (Rule("R06", "customers_balance_sign", "customers", "balance", "Validity", "sign", 95, "Low", {"zero_ok": True}),
     "SELECT COUNT(*) FROM customers WHERE balance < 0"),
    (Rule("R07", "policies_unique_id", "policies", "policy_id", "Uniqueness", "unique", 100, "Critical"),
     "SELECT COUNT(*) - COUNT(DISTINCT policy_id) FROM policies"),
    (Rule("R08", "policies_valid_customer", "policies", "customer_id", "Consistency", "references", 100, "Critical",
          {"parent": "customers", "parent_key": "customer_id"}),
     "SELECT COUNT(*) FROM policies p WHERE NOT EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = p.customer_id)"),
    (Rule("R09", "policies_end_after_start", "policies", "expiration_date", "Validity", "compare", 100, "Critical", {"op": ">", "other": "effective_date"}),
     "SELECT COUNT(*) FROM policies WHERE expiration_date <= effective_date"),
    (Rule("R10", "policies_premium_positive", "policies", "premium", "Validity", "sign", 100, "Critical"),
     "SELECT COUNT(*) FROM policies WHERE premium <= 0"),
    (Rule("R11", "policies_coverage_exceeds_premium", "policies", "coverage", "Validity", "compare", 99, "High", {"op": ">=", "other": "premium", "factor": 12}),
     "SELECT COUNT(*) FROM policies WHERE coverage < premium * 12"),
    (Rule("R12", "policies_type_valid", "policies", "policy_type", "Validity", "allowed", 100, "Critical", {"values": PRIORITIES[:4]}),
     "SELECT COUNT(*) FROM policies WHERE policy_type NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')"),
    (Rule("R13", "policies_effective_window", "policies", "effective_date", "Validity", "date_range", 99.5, "High", {"low": "1995-03-01", "high": "2001-06-30"}),
     "SELECT COUNT(*) FROM policies WHERE effective_date < DATE '1995-03-01' OR effective_date > DATE '2001-06-30'"),
    (Rule("R14", "policies_not_future", "policies", "expiration_date", "Timeliness", "not_future", 90, "High"),
     f"SELECT COUNT(*) FROM policies WHERE expiration_date > DATE '{AS_OF}'"),
    (Rule("R15", "policies_fresh", "policies", "effective_date", "Timeliness", "fresh", 100, "High", {"days": 7}),
     f"SELECT CASE WHEN MAX(effective_date) < DATE '{AS_OF}' - 7 THEN 1 ELSE 0 END FROM policies"),
    (Rule("R16", "claims_unique_id", "claims", "claim_id", "Uniqueness", "unique", 100, "Critical"),
     "SELECT COUNT(*) - COUNT(DISTINCT claim_id) FROM claims"),
    (Rule("R17", "claims_valid_policy", "claims", "policy_id", "Consistency", "references", 100, "Critical",
          {"parent": "policies", "parent_key": "policy_id"}),
     "SELECT COUNT(*) FROM claims p WHERE NOT EXISTS (SELECT 1 FROM policies c WHERE c.policy_id = p.policy_id)"),
    (Rule("R18", "claims_paid_within_amount", "claims", "paid", "Validity", "compare", 99, "High", {"op": "<=", "other": "amount"}),
     "SELECT COUNT(*) FROM claims WHERE paid > amount"),
    (Rule("R19", "claims_fraud_range", "claims", "fraud_score", "Validity", "in_range", 97, "High", {"low": 0, "high": 96}),
     "SELECT COUNT(*) FROM claims WHERE fraud_score NOT BETWEEN 0 AND 96"),
    (Rule("R20", "claims_resolution_present", "claims", "resolution_days", "Completeness", "not_null", 60, "Medium"),
     "SELECT COUNT(*) FROM claims WHERE resolution_days IS NULL"),
    (Rule("R21", "claims_reason_present", "claims", "friction_reason", "Completeness", "not_null", 95, "Medium"),
     "SELECT COUNT(*) FROM claims WHERE friction_reason IS NULL"),
    (Rule("R22", "claims_resolution_sign", "claims", "resolution_days", "Validity", "sign", 100, "Medium"),
     "SELECT COUNT(*) FROM claims WHERE resolution_days <= 0"),
    (Rule("R23", "invoices_paid_has_date", "invoices", "payment_date", "Consistency", "implies", 95, "Medium",
          {"when": "payment_status = 'Paid'", "then": "payment_date IS NOT NULL"}),
     "SELECT COUNT(*) FROM invoices WHERE payment_status = 'Paid' AND payment_date IS NULL"),
    (Rule("R24", "invoices_balance_consistent", "invoices", "outstanding", "Consistency", "reconciles", 98, "High",
          {"minuend": "amount_due", "subtrahend": "amount_paid", "tolerance": 0.005}),
     "SELECT COUNT(*) FROM invoices WHERE ABS(outstanding - (amount_due - amount_paid)) > 0.005"),
    (Rule("R25", "invoices_late_fee_logic", "invoices", "late_fee", "Consistency", "implies", 98, "Low",
          {"when": "late_fee > 0", "then": "payment_status IN ('PastDue', 'Overdue', 'Partial')"}),
     "SELECT COUNT(*) FROM invoices WHERE late_fee > 0 AND payment_status NOT IN ('PastDue', 'Overdue', 'Partial')"),
    (Rule("R26", "invoices_status_valid", "invoices", "payment_status", "Validity", "allowed", 100, "Critical", {"values": ["Paid", "Partial", "Overdue", "Pending"]}),
     "SELECT COUNT(*) FROM invoices WHERE payment_status NOT IN ('Paid', 'Partial', 'Overdue', 'Pending')"),
]
RULES = [r for r, _ in BOOK_RULES]
KEYS = {"customers": "customer_id", "policies": "policy_id", "claims": "claim_id", "invoices": "invoice_id"}


def rule_results(b, rules=RULES, **kw):
    names = dict.fromkeys([r.table for r in rules] + [r.args["parent"] for r in rules if "parent" in r.args])
    return run_rules(rules, {t: b.role(t) for t in names}, KEYS, AS_OF, **kw)


def _results_sql():
    def one(r, sql):
        fresh = r.template == "fresh"
        rate = "CASE WHEN f > 0 THEN CAST(0 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END" if fresh else sql_percent("n - f", "n", 2)
        return (f"SELECT '{r.rule_id}' AS rule_id, '{r.name}' AS rule_name, '{r.table}' AS target_table, '{r.dimension}' AS rule_type, "
                f"'{r.severity}' AS severity, n AS total_records, n - f AS passed_records, f AS failed_records, {rate} AS pass_rate, "
                f"{float(r.threshold)} AS threshold FROM (SELECT CAST(({sql}) AS BIGINT) AS f, (SELECT COUNT(*) FROM {r.table}) AS n)")
    return " UNION ALL ".join(one(r, s) for r, s in BOOK_RULES)


STATUS = "CASE WHEN pass_rate >= threshold THEN 'Pass' WHEN pass_rate >= threshold - 1 THEN 'Warning' ELSE 'Fail' END"
RESULTS = f"raw AS ({_results_sql()}), results AS (SELECT * EXCLUDE (threshold), {STATUS} AS status FROM raw)"
ALL_ROLES = "customers policies claims invoices"

# Rules that can be scored month by month, for score history.
MONTHLY = [r for r in RULES if r.rule_id in ("R18", "R19", "R20", "R21", "R22", "R16", "R12", "R13", "R07", "R10")]


def history(b):
    return rule_results(b, MONTHLY, slice_by={"claims": month_of("claim_date"), "policies": month_of("effective_date")})


def _history_sql():
    per_table = {"claims": "claim_date", "policies": "effective_date"}
    parts = []
    for r, sql in BOOK_RULES:
        if r not in MONTHLY:
            continue
        month = f"CAST(DATE_TRUNC('month', {per_table[r.table]}) AS DATE)"
        if r.template == "unique":
            failed = f"COUNT(*) - COUNT(DISTINCT {r.column})"
        else:
            failed = f"COUNT(*) FILTER (WHERE {sql.split(' WHERE ', 1)[1]})"
        parts.append(f"SELECT '{r.rule_id}' AS rule_id, '{r.name}' AS rule_name, '{r.severity}' AS severity, '{r.table}' AS target_table, '{r.dimension}' AS rule_type, {month} AS run_date, "
                     f"COUNT(*) AS n, {failed} AS f, {sql_percent(f'COUNT(*) - ({failed})', 'COUNT(*)', 2)} AS pass_rate, "
                     f"{float(r.threshold)} AS threshold FROM {r.table} GROUP BY {month}")
    dims = list(scores.DIMENSION_WEIGHTS.items())
    cols = ", ".join(sql_mean(f"CAST(CASE WHEN rule_type = '{d}' THEN pass_rate END AS DECIMAL(9,2))", 2) + f" AS {d.lower()}" for d, _ in dims)
    top = " + ".join(f"COALESCE({d.lower()}, 0.0) * {w}" for d, w in dims)
    bottom = " + ".join(f"CASE WHEN {d.lower()} IS NOT NULL THEN {w} ELSE 0 END" for d, w in dims)
    return f"""hist AS ({' UNION ALL '.join(parts)}),
results AS (SELECT *, {STATUS} AS status FROM hist),
s0 AS (SELECT target_table, run_date, {cols}, MAX(n) AS records_assessed, COUNT(*) AS rules_evaluated FROM hist GROUP BY 1, 2),
s1 AS (SELECT *, {sql_round(f'(CAST(0 AS DOUBLE) + {top}) / ({bottom})', 2)} AS overall FROM s0),
s2 AS (SELECT *, CAST(overall AS DECIMAL(9,2)) - CAST(LAG(overall) OVER (PARTITION BY target_table ORDER BY run_date) AS DECIMAL(9,2)) AS step FROM s1),
scores AS (SELECT * EXCLUDE (step), CASE WHEN step > 0.05 THEN 'Improving' WHEN step < -0.05 THEN 'Declining' ELSE 'Stable' END AS trend FROM s2)"""


HISTORY = _history_sql()


@plan("dq_run_rules", "Q1 Q2 Q3 Q4 Q5 Q6 Q7 Q8 Q9 Q10 Q11 Q12 Q13 Q14 Q15", roles=ALL_ROLES, sql=f"WITH {RESULTS} SELECT * FROM results")
def _(b):
    return rule_results(b).drop("run_date", "error_sample")


@plan("dq_error_samples", "Q15", roles=ALL_ROLES, sql="""
SELECT 'R12' AS rule_id, CAST(MIN(policy_id) AS VARCHAR) AS first_id, CAST(MAX(policy_id) AS VARCHAR) AS last_id FROM policies WHERE policy_type = '5-LOW'
UNION ALL SELECT 'R21', MIN(claim_id), MAX(claim_id) FROM claims WHERE friction_reason IS NULL
UNION ALL SELECT 'R16', MIN(claim_id), MAX(claim_id) FROM (SELECT claim_id FROM claims GROUP BY 1 HAVING COUNT(*) > 1)""")
def _(b):
    wanted = [r for r in RULES if r.rule_id in ("R12", "R16", "R21")]
    return rule_results(b, wanted).select("rule_id", F.get("error_sample", F.lit(0)).alias("first_id"), F.element_at("error_sample", -1).alias("last_id"))


@plan("dq_error_ids", "Q15 L6", roles=ALL_ROLES, sql="""
WITH x AS (SELECT 'R12' AS rule_id, CAST(policy_id AS VARCHAR) AS failing_id FROM policies WHERE policy_type = '5-LOW' UNION ALL SELECT 'R21', claim_id FROM claims WHERE friction_reason IS NULL
UNION ALL SELECT 'R16', claim_id FROM claims GROUP BY claim_id HAVING COUNT(*) > 1)
SELECT rule_id, failing_id, ROW_NUMBER() OVER (PARTITION BY rule_id ORDER BY MD5(failing_id), failing_id) AS rank FROM x QUALIFY rank <= 25""")
def _(b):
    wanted = [r for r in RULES if r.rule_id in ("R12", "R16", "R21")]
    return error_ids(wanted, {"policies": b.policies, "claims": b.claims}, {"policies": "policy_id", "claims": "claim_id"}, AS_OF, 25)


@plan("dq_referential", "Q10 J14", roles="claims policies agents customers alerts", sql="""
SELECT 'claims.adjuster_id' AS link, COUNT(*) AS orphans FROM claims c WHERE NOT EXISTS (SELECT 1 FROM agents a WHERE a.agent_id = c.adjuster_id AND a.status = 'Active')
UNION ALL SELECT 'alerts.customer_id', COUNT(*) FROM alerts c WHERE NOT EXISTS (SELECT 1 FROM customers a WHERE a.customer_id = c.customer_id)""")
def _(b):
    active = b.agents.filter(F.col("status") == "Active")
    rules = [Rule("L1", "claims.adjuster_id", "claims", "adjuster_id", "Consistency", "references", args={"parent": "agents", "parent_key": "agent_id"}),
             Rule("L2", "alerts.customer_id", "alerts", "customer_id", "Consistency", "references", args={"parent": "customers", "parent_key": "customer_id"})]
    tables = {"claims": b.claims, "alerts": b.alerts, "agents": active, "customers": b.customers}
    return run_rules(rules, tables, {"claims": "claim_id", "alerts": "alert_id"}, AS_OF).select(
        F.col("rule_name").alias("link"), F.col("failed_records").alias("orphans"))


@plan("dq_table_scores", "Q16 A14", roles=ALL_ROLES, sql=f"WITH {HISTORY} SELECT * FROM scores")
def _(b):
    return scores.table_scores(history(b))


@plan("dq_latest_scores", "Q19 W2 W3", roles=ALL_ROLES, sql=f"""
WITH {HISTORY} SELECT target_table, run_date, overall, trend FROM scores
QUALIFY ROW_NUMBER() OVER (PARTITION BY target_table ORDER BY run_date DESC) = 1""")
def _(b):
    return scores.latest_scores(scores.table_scores(history(b))).select("target_table", "run_date", "overall", "trend")


@plan("dq_mean_trust", "Q19 Q25", roles=ALL_ROLES, sql=f"""
WITH {HISTORY}, l AS (SELECT * FROM scores QUALIFY ROW_NUMBER() OVER (PARTITION BY target_table ORDER BY run_date DESC) = 1)
SELECT {sql_mean('CAST(overall AS DECIMAL(9,2))', 1)} AS mean_score, COUNT(*) AS tables,
       MIN(DATE_DIFF('hour', CAST(run_date AS TIMESTAMP), TIMESTAMP '{AS_OF}')) AS hours_since_refresh FROM l""")
def _(b):
    s = scores.table_scores(history(b))
    hours = scores.hours_since_refresh(s, AS_OF).scalar()
    return scores.mean_latest_score(s).withColumn("hours_since_refresh", hours)


@plan("trust_score", "Q26 P16", roles=ALL_ROLES, sql=f"""
WITH {HISTORY}, l AS (SELECT * FROM scores QUALIFY ROW_NUMBER() OVER (PARTITION BY target_table ORDER BY run_date DESC) = 1),
w AS (SELECT UNNEST(['claims', 'policies', 'treaties']) AS target_table)
SELECT {sql_mean('CAST(COALESCE(overall, 90.0) AS DECIMAL(9,2))', 1)} AS trust_score, COUNT(overall) AS tables_known,
       CASE WHEN (SELECT COUNT(*) FROM claims) >= 5 THEN 96 WHEN (SELECT COUNT(*) FROM claims) > 0 THEN 93 ELSE 78 END AS confidence
FROM w LEFT JOIN l USING (target_table)""")
def _(b):
    wanted = b.spark.createDataFrame([("claims",), ("policies",), ("treaties",)], "target_table string")
    rows = b.claims.agg(F.count(F.lit(1))).scalar()
    return scores.trust_score(wanted, scores.table_scores(history(b)), rows)


@plan("dq_failing_rules_top", "Q20", roles=ALL_ROLES, sql=f"""
WITH {HISTORY} SELECT rule_name, target_table, severity, COUNT(*) AS fail_count FROM results WHERE status = 'Fail'
GROUP BY 1, 2, 3 ORDER BY fail_count DESC, rule_name LIMIT 10""")
def _(b):
    return scores.most_failing_rules(history(b))


@plan("dq_pass_rate", "Q23 Q34", roles=ALL_ROLES, sql=f"""
WITH {HISTORY} SELECT target_table, status, COUNT(*) AS checks, COUNT(*) FILTER (WHERE status = 'Pass') AS passed,
{sql_percent("COUNT(*) FILTER (WHERE status = 'Pass')", 'COUNT(*)')} AS pass_pct, CAST(SUM(f) AS BIGINT) AS failed_records,
CASE status WHEN 'Fail' THEN CAST(0.85 AS DOUBLE) WHEN 'Warning' THEN 0.5 ELSE 0.1 END AS anomaly_score FROM results GROUP BY 1, 2""")
def _(b):
    return scores.pass_summary(history(b), ["target_table", "status"]).withColumn("anomaly_score", scores.anomaly_score("status"))


@plan("dq_rule_inventory", "Q22 S3", roles=ALL_ROLES, sql=f"""
WITH {RESULTS}, inv AS (SELECT severity, COUNT(*) AS rules, COUNT(*) AS active FROM results GROUP BY 1)
SELECT inv.severity, rules, active, CAST(f AS BIGINT) AS failed_records FROM inv JOIN (SELECT severity, SUM(failed_records) AS f FROM results GROUP BY 1) USING (severity)""")
def _(b):
    inventory = scores.rule_inventory(rules_frame(b.spark, RULES), "severity")
    failed = rule_results(b).groupBy("severity").agg(F.sum("failed_records").alias("failed_records"))
    return inventory.join(failed, "severity")


def _profile_sql(table, columns):
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(*) AS total, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS distinct_count FROM {table}"
        for c in columns)


CLAIM_COLUMNS = ["claim_id", "policy_id", "adjuster_id", "claim_date", "amount", "fraud_score", "cause", "resolution_days", "friction_reason"]
INVOICE_COLUMNS = ["invoice_id", "payment_status", "payment_method", "payment_date", "outstanding", "late_fee"]


@plan("dq_profile", "Q18 U3", roles="claims invoices", sql=f"{_profile_sql('claims', CLAIM_COLUMNS)} UNION ALL {_profile_sql('invoices', INVOICE_COLUMNS)}")
def _(b):
    return profile.profile_columns(b.claims, "claims", CLAIM_COLUMNS).unionByName(profile.profile_columns(b.invoices, "invoices", INVOICE_COLUMNS))


def _health_sql(table, columns, numeric, keys):
    parts = []
    for c in columns:
        out = (f"(SELECT COUNT(*) FROM {table}, (SELECT AVG({c}) AS m, STDDEV_SAMP({c}) AS s FROM {table}) WHERE ABS({c} - m) > 3 * s)" if c in numeric else "0")
        parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count, {sql_percent(f'COUNT(*) - COUNT({c})', 'COUNT(*)', 2)} AS null_rate, "
                     f"{sql_percent(f'COUNT({c}) - COUNT(DISTINCT {c})', f'COUNT({c})', 2)} AS duplicate_rate, {sql_percent(out, 'COUNT(*)', 2)} AS outlier_rate, "
                     f"{'TRUE' if c in keys else 'FALSE'} AS is_key FROM {table}")
    return f"""h0 AS ({' UNION ALL '.join(parts)}),
h1 AS (SELECT * EXCLUDE (is_key), {sql_round('100.0 - null_rate - outlier_rate - CASE WHEN is_key THEN duplicate_rate ELSE 0.0 END', 2)} AS health_score FROM h0),
health AS (SELECT *, CASE WHEN health_score >= 90 THEN 'Healthy' WHEN health_score >= 75 THEN 'Warning' ELSE 'Critical' END AS status FROM h1)"""


HEALTH = (["claim_id", "amount", "paid", "fraud_score", "resolution_days", "friction_reason"], ["amount", "paid", "fraud_score", "resolution_days"], ["claim_id"])


@plan("dq_column_health", "Q17", roles="claims", sql=f"WITH {_health_sql('claims', *HEALTH)} SELECT * FROM health")
def _(b):
    return profile.column_health(b.claims, "claims", *HEALTH)


# Resolution days as text with a gap word, and days as text of which some are not dates.
MESSY = """messy AS (SELECT *, CASE WHEN line_number = 7 THEN 'open' ELSE CAST(resolution_days AS VARCHAR) END AS days_text,
CASE WHEN line_number = 1 AND claim_date < DATE '1999-01-01' THEN CAST(claim_date AS VARCHAR) WHEN line_number = 7 THEN 'unknown' END AS day_text FROM claims)"""
FULL_HEALTH = (["claim_id", "amount", "resolution_days", "days_text", "day_text", "friction_reason"], ["amount", "resolution_days"], ["claim_id"])


def _type_sql(columns):
    """Type, its consistency and age of each column of the messy claims."""
    shapes = profile.SHAPES | {"boolean": "(?i)^(true|false)$"}
    out = []
    for c in columns:
        if c in ("amount", "resolution_days"):
            kind, share = ("'decimal(18,2)'" if c == "amount" else "'int'"), "CAST(100 AS DOUBLE)"
        else:
            shares = {t: sql_percent(f"COUNT(*) FILTER (WHERE REGEXP_MATCHES(TRIM({c}), '{shape}'))", f"COUNT({c})", 2) for t, shape in shapes.items()}
            kind = "CASE " + " ".join(f"WHEN {v} >= 75 THEN '{t}'" for t, v in shares.items()) + " ELSE 'text' END"
            share = "CASE " + " ".join(f"WHEN {v} >= 75 THEN {v}" for v in shares.values()) + " ELSE CAST(100 AS DOUBLE) END"
        out.append(f"SELECT '{c}' AS column_name, {kind} AS value_type, {share} AS type_consistency, CAST(DATE '{AS_OF}' - MAX(claim_date) FILTER (WHERE {c} IS NOT NULL) AS INT) AS age_days FROM messy")
    return "types AS (" + " UNION ALL ".join(out) + ")"


@plan("dq_column_health_full", "Q17", roles="claims", sql=f"""
WITH {MESSY}, {_health_sql('messy', *FULL_HEALTH)}, {_type_sql(FULL_HEALTH[0])},
j AS (SELECT * EXCLUDE (health_score, status), COALESCE(age_days > 1050, TRUE) AS is_stale,
 {sql_round('health_score - (100 - type_consistency) - CASE WHEN COALESCE(age_days > 1050, TRUE) THEN 10 ELSE 0 END', 2)} AS health_score FROM health JOIN types USING (column_name))
SELECT *, CASE WHEN health_score >= 90 THEN 'Healthy' WHEN health_score >= 75 THEN 'Warning' ELSE 'Critical' END AS status FROM j""")
def _(b):
    line, day = F.col("line_number"), F.col("claim_date")
    messy = b.claims.withColumns({
        "days_text": F.when(line == 7, "open").otherwise(F.col("resolution_days").cast("string")),
        "day_text": F.when((line == 1) & (day < F.lit("1999-01-01").cast("date")), day.cast("string")).when(line == 7, "unknown")})
    return profile.column_health_full(messy, "messy", *FULL_HEALTH, "claim_date", AS_OF, 1050)


@plan("dq_unhealthiest_columns", "Q21 A10 T7", roles="claims", sql=f"""
WITH {_health_sql('claims', *HEALTH)}
SELECT table_name, MIN(health_score) AS lowest_health, ARG_MIN(column_name, {{'h': health_score, 'c': column_name}}) AS weakest_column,
       CASE MAX(CASE status WHEN 'Critical' THEN 2 WHEN 'Warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'Critical' WHEN 1 THEN 'Warning' ELSE 'Healthy' END AS worst_status
FROM health GROUP BY 1""")
def _(b):
    return profile.unhealthiest_columns(profile.column_health(b.claims, "claims", *HEALTH))


@plan("freshness_report", "Q24", roles="policies claims alerts", sql=f"""
SELECT *, DATE '{AS_OF}' - latest AS age_days, COALESCE(DATE '{AS_OF}' - latest > 30, TRUE) AS stale FROM (
SELECT 'policies' AS source, MAX(effective_date) AS latest, COUNT(*) AS rows FROM policies
UNION ALL SELECT 'claims', MAX(claim_date), COUNT(*) FROM claims UNION ALL SELECT 'alerts', MAX(CAST(reported_at AS DATE)), COUNT(*) FROM alerts)""")
def _(b):
    return profile.freshness_report({"policies": (b.policies, "effective_date"), "claims": (b.claims, "claim_date"), "alerts": (b.alerts, "reported_at")}, AS_OF) \
        .withColumn("age_days", F.col("age_days").cast("long"))


@plan("catalog_tables", "S7", sql=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS rows FROM {t}" for t in BASE_TABLES))
def _(b):
    return profile.catalog_tables({t: b.base(t) for t in BASE_TABLES}).drop("columns")


@plan("catalog_columns", "S8", sql=" UNION ALL ".join(
    f"SELECT 'orders' AS table_name, '{c}' AS column_name, {i} AS position, COUNT({c}) AS non_null FROM orders"
    for i, c in enumerate(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], 1)))
def _(b):
    columns = profile.schema_rows(b.spark, {"orders": b.base("orders")})
    filled = profile.profile_columns(b.base("orders"), "orders", exact=False).select("column_name", (F.col("total") - F.col("nulls")).alias("non_null"))
    return columns.join(filled, "column_name").select("table_name", "column_name", "position", "non_null")


@plan("catalog_all_columns", "S8", sql=f"""
SELECT table_name, column_name, CAST(ordinal_position AS INT) AS position, is_nullable = 'YES' AS nullable,
CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE LOWER(data_type) END AS data_type
FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in BASE_TABLES)})""")
def _(b):
    return profile.schema_rows(b.spark, {t: b.base(t) for t in BASE_TABLES}).select("table_name", "column_name", "position", "nullable", "data_type")


@plan("catalog_table_sizes", "S7")
def _(b):
    """Files and bytes from the listing, rows from the tables; bytes have no SQL over the tables, a test holds them against the files."""
    rows = profile.catalog_tables({t: b.base(t) for t in BASE_TABLES})
    return rows.join(profile.catalog_files(b.spark, b.folder), "table_name").select("table_name", "rows", "columns", "files", "bytes")


@plan("schema_drift_defaults", "Q33", sql="""
SELECT 'policies' AS table_name, column_name, event_type, old_value, new_value, severity FROM (
SELECT 'o_orderstatus' AS column_name, 'DEFAULT_CHANGED' AS event_type, '1' AS old_value, '2' AS new_value, 'Low' AS severity UNION ALL SELECT 'o_totalprice', 'DEFAULT_CHANGED', NULL, '0', 'Low'
UNION ALL SELECT 'o_totalprice', 'TYPE_CHANGED', 'double', 'decimal(18,2)', 'Medium' UNION ALL SELECT 'o_orderpriority', 'DEFAULT_CHANGED', '3', NULL, 'Low') WHERE (SELECT COUNT(*) FROM orders) > 0""")
def _(b):
    orders = b.base("orders")
    old = profile.with_default(profile.with_default(orders, "o_orderstatus", "1"), "o_orderpriority", "3")
    new = profile.with_default(orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")), "o_totalprice", "0")
    new = profile.with_default(new, "o_orderstatus", "2")
    return profile.schema_drift(profile.schema_rows(b.spark, {"policies": old}), profile.schema_rows(b.spark, {"policies": new}))


@plan("schema_drift", "Q33 D9", sql="""
SELECT 'policies' AS table_name, c AS column_name, e AS event_type, o AS old_value, n AS new_value, s AS severity, k AS filled FROM (
SELECT 'premium_amount' AS c, 'COLUMN_RENAMED' AS e, 'o_totalprice' AS o, 'premium_amount' AS n, 'Medium' AS s, (SELECT COUNT(o_totalprice) FROM orders) AS k
UNION ALL SELECT 'o_orderpriority', 'COLUMN_DROPPED', 'string', NULL, 'High', NULL
UNION ALL SELECT 'o_orderdate', 'TYPE_CHANGED', 'timestamp_ntz', 'date', 'Medium', (SELECT COUNT(o_orderdate) FROM orders)
UNION ALL SELECT 'is_urgent', 'COLUMN_ADDED', NULL, 'boolean', 'Low', (SELECT COUNT(o_orderpriority) FROM orders))""")
def _(b):
    old = b.base("orders")
    new = (old.withColumnRenamed("o_totalprice", "premium_amount").withColumn("o_orderdate", F.to_date("o_orderdate"))
           .withColumn("is_urgent", F.col("o_orderpriority") == "1-URGENT").drop("o_orderpriority"))
    drift = profile.schema_drift(profile.schema_rows(b.spark, {"policies": old}), profile.schema_rows(b.spark, {"policies": new}),
                                 {"o_totalprice": "premium_amount"})
    filled = profile.profile_columns(new, "policies", exact=False).select("column_name", (F.col("total") - F.col("nulls")).alias("filled"))
    return drift.join(filled, "column_name", "left").select("table_name", "column_name", "event_type", "old_value", "new_value", "severity", "filled")


@plan("content_duplicates", "Q29 F9", roles="filings", sql="""
WITH g AS (SELECT content, COUNT(*) AS copies, MIN(document_id) AS original FROM filings GROUP BY 1 HAVING COUNT(*) > 1)
SELECT document_id, original, copies FROM filings JOIN g USING (content) WHERE document_id <> original""")
def _(b):
    return detect.content_duplicates(b.filings, ["content"], "document_id")


@plan("duplicate_claim_keys", "Q29 A13", roles="claims", sql="SELECT claim_id, COUNT(*) AS copies FROM claims GROUP BY 1 HAVING COUNT(*) > 1")
def _(b):
    return detect.duplicate_groups(b.claims, ["claim_id"])


@plan("near_duplicates", "Q28 J13", roles="products", sql="""
WITH f AS (SELECT *, MIN(part_id) OVER w AS original, ARG_MIN(carrier, part_id) OVER w AS first_carrier, COUNT(*) OVER w AS members
FROM products WINDOW w AS (PARTITION BY product_name, line, size))
SELECT * FROM (SELECT part_id, original, CAST(ROUND(CAST(1 - CAST(LEVENSHTEIN(LOWER(carrier), LOWER(first_carrier)) AS DOUBLE) / GREATEST(LENGTH(carrier), LENGTH(first_carrier)) AS DECIMAL(38,6)), 4) AS DOUBLE) AS similarity, members
FROM f WHERE part_id <> original) WHERE similarity >= 0.8""")
def _(b):
    return detect.near_duplicate_entities(b.products, ["product_name", "line", "size"], "part_id", "carrier")


@plan("near_duplicate_classes", "Q28 J13", roles="customers", sql="""
WITH RECURSIVE v AS (SELECT state_id, email, MIN(customer_id) AS least, COUNT(*) AS copies FROM customers GROUP BY 1, 2),
l AS (SELECT x.state_id, x.email AS a, y.email AS b FROM v x JOIN v y ON x.state_id = y.state_id AND x.email <> y.email
      WHERE CAST(ROUND(CAST(1 - CAST(LEVENSHTEIN(x.email, y.email) AS DOUBLE) / GREATEST(LENGTH(x.email), LENGTH(y.email)) AS DECIMAL(38,6)), 4) AS DOUBLE) >= 0.95),
r AS (SELECT state_id, email AS a, email AS b FROM v UNION SELECT r.state_id, r.a, l.b FROM r JOIN l ON l.state_id = r.state_id AND l.a = r.b),
c AS (SELECT r.state_id, r.a AS email, MIN(least) AS class_id, SUM(copies) AS members FROM r JOIN v ON v.state_id = r.state_id AND v.email = r.b GROUP BY 1, 2),
d AS (SELECT state_id, a AS email, COUNT(*) AS links FROM l GROUP BY 1, 2)
SELECT customer_id, class_id, CAST(members AS BIGINT) AS members, COALESCE(links, 0) AS links FROM customers JOIN c USING (state_id, email) LEFT JOIN d USING (state_id, email) WHERE members > 1""")
def _(b):
    """E-mail addresses of a state that differ in a character or two, closed to classes."""
    return similar.similarity_classes(b.customers, ["state_id"], "customer_id", "email", 0.95)


@plan("outliers_z", "Q30 A19", roles="policies", sql=f"""
WITH s AS (SELECT policy_type, AVG(CAST(premium AS DOUBLE)) AS m, STDDEV_SAMP(CAST(premium AS DOUBLE)) AS s FROM policies GROUP BY 1)
SELECT policy_id, policy_type, CAST(premium AS DOUBLE) AS premium, {sql_round('(CAST(premium AS DOUBLE) - m) / s', 4)} AS z FROM policies JOIN s USING (policy_type)
WHERE ABS({sql_round('(CAST(premium AS DOUBLE) - m) / s', 4)}) > 1.7""")
def _(b):
    return detect.outliers_by_z(b.policies.withColumn("premium", F.col("premium").cast("double")), ["policy_type"], "premium", ["policy_id"], z=1.7)


@plan("outliers_iqr", "Q30", roles="alerts", sql="""
WITH r AS (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) AS i, COUNT(*) OVER (PARTITION BY event_type) AS n FROM alerts),
q AS (SELECT event_type, MAX(value) FILTER (WHERE i = CEIL(n * 0.25)) AS q1, MAX(value) FILTER (WHERE i = CEIL(n * 0.75)) AS q3 FROM r GROUP BY 1)
SELECT event_type, COUNT(*) AS rows, CAST(q1 AS DOUBLE) AS q1, CAST(q3 AS DOUBLE) AS q3,
       COUNT(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM alerts JOIN q USING (event_type) GROUP BY 1, 3, 4""")
def _(b):
    return detect.outliers_by_iqr(b.alerts, ["event_type"], "value")


@plan("slow_claims", "Q30 P5", roles="claims", sql="SELECT claim_id, amount, resolution_days FROM (SELECT claim_id, CAST(amount AS DOUBLE) AS amount, resolution_days FROM claims WHERE resolution_days > 200)")
def _(b):
    return detect.above_threshold(b.claims, "resolution_days", 200, ["claim_id", "amount"]).withColumn("amount", F.col("amount").cast("double"))


@plan("spike_zscore", "Q31 A19", roles="claims agents states regions", sql=f"""
WITH s AS (SELECT region, CAST(DATE_TRUNC('month', claim_date) AS DATE) AS month, COUNT(*) AS claim_count
FROM claims c JOIN agents a ON a.agent_id = c.adjuster_id JOIN states USING (state_id) JOIN regions USING (region_id) GROUP BY 1, 2),
t AS (SELECT region, AVG(claim_count) AS m, STDDEV_SAMP(claim_count) AS d FROM s GROUP BY 1)
SELECT s.region, month, claim_count, {sql_round('m', 4)} AS mean_value, {sql_round('m + d * 1.5', 4)} AS limit_value, claim_count > {sql_round('m + d * 1.5', 4)} AS is_spike
FROM s JOIN t ON t.region = s.region""")
def _(b):
    series = claims_by_region_month(b.claims, b.agents, b.states, b.regions, "1900-01-01").select("region", "month", "claim_count")
    return detect.spikes(series, ["region"], "claim_count", 1.5)


@plan("stale_snapshots", "Q32", roles="alerts", sql="""
SELECT event_type, COUNT(*) AS snapshots, COUNT(*) FILTER (WHERE CAST(reported_at AS DATE) < DATE '2024-02-28' - 44) AS stale FROM alerts GROUP BY 1""")
def _(b):
    stale = detect.stale_snapshots(b.alerts, "day", "2024-02-28")
    return b.alerts.withColumn("day", F.to_date("reported_at")).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("snapshots"), F.count_if(stale).alias("stale"))


@plan("spike_explained_by_duplicates", "Q35", roles="claims", sql=f"""
WITH g AS (SELECT CAST(DATE_TRUNC('month', claim_date) AS DATE) AS period, claim_id, COUNT(*) AS n, SUM(amount) AS v, MAX(amount) AS one FROM claims GROUP BY 1, 2)
SELECT period, CAST(SUM(n) AS BIGINT) AS rows, CAST(SUM(n - 1) AS BIGINT) AS surplus_rows, {sql_round('SUM(v)', 2)} AS total, {sql_round('SUM(one)', 2)} AS total_without_copies,
       {sql_percent('SUM(v) - SUM(one)', 'SUM(v)', 2)} AS explained_pct FROM g GROUP BY 1""")
def _(b):
    return detect.spike_explained_by_duplicates(b.claims, month_of("claim_date"), ["claim_id"], "amount")


# As an injector would leave them: no e-mail for critical customers, no phone for those of balance under -500.
FAULTY = """faulty AS (SELECT * REPLACE (CASE WHEN risk_tier <> 'Critical' THEN email END AS email, CASE WHEN balance >= -500 THEN phone END AS phone) FROM customers)"""


@plan("ten_faults", "Q27 U1 Q32", roles="customers claims agents policies alerts", sql=f"""
WITH {FAULTY}, h AS (SELECT adjuster_id, COUNT(*) AS handled FROM claims GROUP BY 1)
SELECT 'null_emails' AS issue, COUNT(*) AS rows FROM faulty WHERE email IS NULL UNION ALL SELECT 'null_phones', COUNT(*) FROM faulty WHERE phone IS NULL
UNION ALL SELECT 'duplicate_customers', COUNT(*) - COUNT(DISTINCT household_id) FROM faulty
UNION ALL SELECT 'extreme_resolution', COUNT(*) FROM claims WHERE resolution_days > 200 UNION ALL SELECT 'high_fraud_score', COUNT(*) FROM claims WHERE fraud_score > 80
UNION ALL SELECT 'storm_claims', COUNT(*) FROM claims WHERE cause IN ('Hail', 'Hurricane') UNION ALL SELECT 'duplicate_claims', COUNT(*) - COUNT(DISTINCT claim_id) FROM claims
UNION ALL SELECT 'busy_low_rated_agents', COUNT(*) FROM agents JOIN h ON agent_id = adjuster_id WHERE performance_rating < 2 AND handled > 75
UNION ALL SELECT 'stale_snapshots', COUNT(*) FROM alerts WHERE CAST(reported_at AS DATE) < DATE '2024-02-28' - 44 UNION ALL SELECT 'premium_outliers', COUNT(*) FROM policies WHERE premium > 450000""")
def _(b):
    faulty = b.customers.withColumns({"email": F.when(F.col("risk_tier") != "Critical", F.col("email")), "phone": F.when(F.col("balance") >= -500, F.col("phone"))})
    snapshots = b.alerts.select(F.to_date("reported_at").alias("snapshot_date"))
    return detect.ten_faults(faulty, b.claims, b.agents, b.policies, snapshots, "2024-02-28", ["household_id"], ["Hail", "Hurricane"], 450000)


@plan("issue_report", "Q27 U1 Q32", roles="customers claims invoices agents", sql="""
SELECT 'critical_customers' AS issue, COUNT(*) AS rows FROM customers WHERE risk_tier = 'Critical'
UNION ALL SELECT 'slow_claims', COUNT(*) FROM claims WHERE resolution_days > 200 UNION ALL SELECT 'high_fraud', COUNT(*) FROM claims WHERE fraud_score > 80
UNION ALL SELECT 'storm_claims', COUNT(*) FROM claims WHERE cause = 'Hail' UNION ALL SELECT 'no_reason', COUNT(*) FROM claims WHERE friction_reason IS NULL
UNION ALL SELECT 'paid_without_date', COUNT(*) FROM invoices WHERE payment_status = 'Paid' AND payment_date IS NULL
UNION ALL SELECT 'balance_mismatch', COUNT(*) FROM invoices WHERE ABS(outstanding - (amount_due - amount_paid)) > 0.005
UNION ALL SELECT 'low_rated_agents', COUNT(*) FROM agents WHERE performance_rating < 2""")
def _(b):
    c = F.col
    return detect.issue_report({
        "customers": (b.customers, {"critical_customers": c("risk_tier") == "Critical"}),
        "claims": (b.claims, {"slow_claims": c("resolution_days") > 200, "high_fraud": c("fraud_score") > 80,
                              "storm_claims": c("cause") == "Hail", "no_reason": c("friction_reason").isNull()}),
        "invoices": (b.invoices, {"paid_without_date": (c("payment_status") == "Paid") & c("payment_date").isNull(),
                                  "balance_mismatch": F.abs(c("outstanding") - (c("amount_due") - c("amount_paid"))) > 0.005}),
        "agents": (b.agents, {"low_rated_agents": c("performance_rating") < 2}),
    })
