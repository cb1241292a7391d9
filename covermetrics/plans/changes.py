"""Change, activity and access queries."""

from pyspark.sql import functions as F

from covermetrics.operators import access, activity, change
from covermetrics.operators.quality.profile import catalog_tables
from covermetrics.operators.relational import round_robin_assign
from covermetrics.plans.registry import plan, sql_round
from covermetrics.sources.book import BASE_TABLES
from covermetrics.sources.tables import VersionedTable
from covermetrics.session import scratch_path

STEPS = [(["Active"], "InForce"), (["Renewed", "InForce"], "Live"), (["Cancelled"], "Lapsed"), (["Lapsed"], "Closed")]


@plan("remap_statuses", "D4 D2 P14 T5", roles="policies", sql="""
SELECT CASE WHEN status = 'Cancelled' THEN 'Closed' ELSE 'Live' END AS new_status, policy_type, COUNT(*) AS policies FROM policies GROUP BY 1, 2""")
def _(b):
    return b.policies.select(change.remap(F.col("status"), STEPS).alias("new_status"), "policy_type").groupBy("new_status", "policy_type").agg(
        F.count(F.lit(1)).alias("policies"))


@plan("update_where", "D2 P15", roles="claims", sql=f"""
SELECT status, {sql_round("SUM(CASE WHEN status = 'Open' AND fraud_score > 50 THEN reserve + 100 ELSE reserve END)", 2)} AS reserve FROM claims GROUP BY 1""")
def _(b):
    raised = change.update_where(b.claims, (F.col("status") == "Open") & (F.col("fraud_score") > 50), {"reserve": F.col("reserve") + 100})
    return raised.groupBy("status").agg(F.sum("reserve").cast("double").alias("reserve"))


@plan("update_where_in", "D3 J13", roles="claims policies", sql="""
SELECT cause, CAST(SUM(CASE WHEN policy_id IN (SELECT policy_id FROM policies WHERE premium > 450000) THEN 95 ELSE fraud_score END) AS DOUBLE) AS fraud_total FROM claims GROUP BY 1""")
def _(b):
    big = b.policies.filter(F.col("premium") > 450000).select("policy_id")
    return change.update_where_in(b.claims, big, "policy_id", {"fraud_score": F.lit(95.0)}).groupBy("cause").agg(F.sum("fraud_score").alias("fraud_total"))


def renewals(b):
    """Incoming batch: renewals with a new premium, and cancelled policies sold anew under a new number."""
    p = b.policies
    renewed = p.filter(F.col("status") == "Renewed").withColumn("premium", F.col("premium") + 100).withColumn("policy_type", F.lit("changed"))
    resold = p.filter(F.col("status") == "Cancelled").withColumn("policy_id", F.col("policy_id") + 1_000_000_000).withColumn("status", F.lit("Active"))
    return renewed.unionByName(resold).withColumns({"premium": F.col("premium").cast("decimal(18,2)")})


UPSERTED = """merged AS (SELECT policy_id, policy_type, status, CASE WHEN status = 'Renewed' THEN premium + 100 ELSE premium END AS premium FROM policies
UNION ALL SELECT policy_id + 1000000000, policy_type, 'Active', premium FROM policies WHERE status = 'Cancelled')"""


@plan("upsert_policies", "D6 D8", roles="policies", sql=f"""
WITH {UPSERTED} SELECT policy_type, status, COUNT(*) AS policies, CAST(SUM(premium) AS DOUBLE) AS premium, MAX(policy_id) AS last_id FROM merged GROUP BY 1, 2""")
def _(b):
    columns = ["policy_id", "policy_type", "status", "premium"]
    slot = F.pmod("policy_id", F.lit(8)).cast("int").alias("slot")
    table = VersionedTable(scratch_path(b.spark, "policies"), "slot", "policy_id bigint, policy_type string, status string, premium decimal(18,2), slot int")
    table.write(b.policies.select(*columns, slot), 0, range(8))
    table.merge(renewals(b).select(*columns, slot), ["policy_id"], ["premium", "status"], ["premium", "status", "policy_type"], 1)
    return table.read(b.spark).groupBy("policy_type", "status").agg(
        F.count(F.lit(1)).alias("policies"), F.sum("premium").cast("double").alias("premium"), F.max("policy_id").alias("last_id"))


@plan("insert_only_merge", "D5 D1", roles="policies", sql="""
SELECT status, COUNT(*) AS policies, CAST(SUM(premium) AS DOUBLE) AS premium FROM (SELECT status, premium FROM policies
UNION ALL SELECT 'Active', premium FROM policies WHERE status = 'Cancelled') GROUP BY 1""")
def _(b):
    columns = ["policy_id", "status", "premium"]
    return change.insert_new(b.policies.select(*columns), renewals(b).select(*columns), ["policy_id"], ["premium"]).groupBy("status").agg(
        F.count(F.lit(1)).alias("policies"), F.sum("premium").cast("double").alias("premium"))


@plan("replace_children", "D7", roles="policies claims", sql="""
WITH t AS (SELECT policy_id, line_number, amount FROM claims), n AS (SELECT policy_id, 0 AS line_number, premium AS amount FROM policies WHERE status = 'Renewed')
SELECT line_number, COUNT(*) AS lines, CAST(SUM(amount) AS DOUBLE) AS amount FROM (SELECT * FROM t WHERE policy_id NOT IN (SELECT policy_id FROM n) UNION ALL SELECT * FROM n) GROUP BY 1""")
def _(b):
    new = b.policies.filter(F.col("status") == "Renewed").select("policy_id", F.lit(0).alias("line_number"), F.col("premium").alias("amount"))
    return change.replace_children(b.claims.select("policy_id", "line_number", "amount"), new, "policy_id").groupBy("line_number").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("amount").cast("double").alias("amount"))


@plan("schema_evolution", "D9", roles="claims", sql="""
SELECT reason, COUNT(*) AS claims, CAST(SUM(claim_amount) AS DOUBLE) AS claim_amount, COUNT(*) FILTER (WHERE is_large) AS large FROM (
SELECT amount AS claim_amount, COALESCE(friction_reason, 'None stated') AS reason, amount > 50000 AS is_large FROM claims) GROUP BY 1""")
def _(b):
    new = change.evolve(b.claims, rename={"amount": "claim_amount", "friction_reason": "reason"}, add={"is_large": F.col("claim_amount") > 50000},
                        widen={"claim_amount": "decimal(28,2)"}, backfill={"reason": F.lit("None stated")}, drop=["reserve", "litigation"])
    return new.groupBy("reason").agg(F.count(F.lit(1)).alias("claims"), F.sum("claim_amount").cast("double").alias("claim_amount"),
                                     F.count_if("is_large").alias("large"))


@plan("allocate_vehicles", "D10 D11 J10 J15 W1 F1", roles="policies products", sql="""
WITH existing AS (SELECT policy_id, 'VEH-' || LPAD(CAST(policy_id % 90000 AS VARCHAR), 5, '0') AS vehicle_id FROM policies WHERE status = 'Cancelled'),
makes AS (SELECT DISTINCT product_name FROM products), m AS (SELECT product_name, ROW_NUMBER() OVER (ORDER BY MD5(product_name)) AS mrn, COUNT(*) OVER () AS total FROM makes),
n AS (SELECT policy_id, ROW_NUMBER() OVER (ORDER BY MD5(CAST(policy_id AS VARCHAR)), policy_id) AS rn FROM policies WHERE policy_id NOT IN (SELECT policy_id FROM existing)),
x AS (SELECT policy_id, product_name, CAST((SELECT MAX(CAST(REPLACE(vehicle_id, 'VEH-', '') AS BIGINT)) FROM existing) + rn AS VARCHAR) AS no FROM n JOIN m ON mrn = (rn - 1) % total + 1)
SELECT policy_id, product_name, 'VEH-' || CASE WHEN LENGTH(no) >= 5 THEN no ELSE LPAD(no, 5, '0') END AS vehicle_id FROM x""")
def _(b):
    existing = b.policies.filter(F.col("status") == "Cancelled").select(
        "policy_id", F.concat(F.lit("VEH-"), F.lpad((F.col("policy_id") % 90000).cast("string"), 5, "0")).alias("vehicle_id"))
    fresh = change.missing_children(b.policies.select("policy_id"), existing, "policy_id")
    makes = b.products.select("product_name").distinct()
    with_ids = change.allocate_ids(existing, fresh, "vehicle_id", "VEH-", "policy_id")
    return round_robin_assign(with_ids, "policy_id", makes, "product_name")


@plan("friction_backfill", "D12 P15 F26", roles="claims", sql="""
WITH f AS (SELECT CASE WHEN friction_score > 3 AND friction_reason IS NULL THEN ['Documentation Delay', 'Adjuster Reassignment', 'Dispute Resolution', 'Third Party Response', 'System Error', 'Policy Verification']
[CAST('0x' || SUBSTR(MD5(claim_id || 'fr'), 1, 8) AS BIGINT) % 6 + 1] ELSE friction_reason END AS reason FROM claims)
SELECT reason, COUNT(*) AS claims FROM f GROUP BY 1""")
def _(b):
    return change.backfill_friction(b.claims).groupBy(F.col("friction_reason").alias("reason")).agg(F.count(F.lit(1)).alias("claims"))


@plan("status_transitions", "K34 W7", roles="alerts", sql="""
WITH p AS (SELECT event_type, LAG(event_type) OVER (PARTITION BY customer_id ORDER BY reported_at, alert_id) AS prev FROM alerts)
SELECT prev AS from_state, event_type AS to_state, COUNT(*) AS changes FROM p WHERE prev IS NOT NULL AND prev <> event_type GROUP BY 1, 2""")
def _(b):
    return activity.transitions(b.alerts, "customer_id", "reported_at", "alert_id", "event_type")


@plan("inactivity_gaps", "G7 K49 W7", roles="alerts", sql="""
WITH p AS (SELECT alert_id, customer_id, reported_at, LAG(reported_at) OVER (PARTITION BY customer_id ORDER BY reported_at, alert_id) AS prev FROM alerts)
SELECT alert_id, customer_id, CAST(FLOOR((EPOCH_US(reported_at) - EPOCH_US(prev)) / 1000000) AS BIGINT) AS gap_seconds FROM p
WHERE CAST(FLOOR((EPOCH_US(reported_at) - EPOCH_US(prev)) / 1000000) AS BIGINT) > 86400""")
def _(b):
    return activity.gaps(b.alerts, "customer_id", "reported_at", "alert_id").select("alert_id", "customer_id", "gap_seconds")


@plan("activity_sessions", "G7", roles="alerts", sql="""
WITH p AS (SELECT *, CASE WHEN EPOCH_US(reported_at) - LAG(EPOCH_US(reported_at)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS opens FROM alerts WINDOW w AS (PARTITION BY customer_id ORDER BY reported_at, alert_id)),
s AS (SELECT *, SUM(opens) OVER (PARTITION BY customer_id ORDER BY reported_at, alert_id ROWS UNBOUNDED PRECEDING) AS n FROM p)
SELECT customer_id, MIN(reported_at) AS session_start, MAX(reported_at) AS session_end, COUNT(*) AS events FROM s GROUP BY customer_id, n""")
def _(b):
    return activity.sessions(b.alerts, "customer_id", "reported_at", "alert_id", 360)


ROLES_TRIED = ("EXECUTIVE", "UNDERWRITER", "CLAIMS")


@plan("mask_customer", "V1 V2 V3 F8 F3", roles="customers", sql="""
SELECT customer_id, role, CASE WHEN role IN ('ACCOUNTADMIN', 'EXECUTIVE') THEN email ELSE REGEXP_REPLACE(email, '(^[^@]{2})[^@]*(@.*)', '\\1****\\2') END AS email,
CASE WHEN role IN ('ACCOUNTADMIN', 'EXECUTIVE') THEN phone ELSE '(***) ***-' || RIGHT(phone, 4) END AS phone,
CASE WHEN role IN ('ACCOUNTADMIN', 'EXECUTIVE', 'UNDERWRITER') THEN credit_score END AS credit_score
FROM customers, (SELECT UNNEST(['EXECUTIVE', 'UNDERWRITER', 'CLAIMS']) AS role)""")
def _(b):
    seen_by = b.customers.withColumn("role", F.explode(F.array(*[F.lit(r) for r in ROLES_TRIED])))
    return access.masked_customers(seen_by, F.col("role")).select("customer_id", "role", "email", "phone", "credit_score")


SCHEMA_OF = {t: ("documents" if t in ("documents", "pages", "benchmark", "embeddings") else "external" if t == "events"
                 else "quality" if t == "labels" else "analytics") for t in BASE_TABLES}


@plan("visible_tables", "V4", sql="WITH c AS (" + " UNION ALL ".join(f"SELECT '{s}' AS schema_name, '{t}' AS table_name, COUNT(*) AS rows FROM {t}" for t, s in SCHEMA_OF.items())
      + "), e AS (SELECT UNNEST(['EXECUTIVE', 'EXECUTIVE', 'EXECUTIVE', 'EXECUTIVE', 'UNDERWRITER', 'UNDERWRITER', 'UNDERWRITER', 'CLAIMS', 'CLAIMS', 'DATA_STEWARD']) AS role, "
      "UNNEST(['analytics', 'external', 'documents', 'quality', 'analytics', 'external', 'documents', 'analytics', 'documents', 'quality']) AS schema_name) "
      "SELECT role, schema_name, table_name, rows FROM c JOIN e USING (schema_name)")
def _(b):
    schema = F.create_map(*[F.lit(x) for pair in SCHEMA_OF.items() for x in pair])[F.col("table_name")]
    catalog = catalog_tables({t: b.base(t) for t in BASE_TABLES}).select(schema.alias("schema_name"), "table_name", "rows")
    return access.visible_tables(catalog, access.entitlement_rows(b.spark))
