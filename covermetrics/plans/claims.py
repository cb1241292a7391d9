"""Claims queries."""

from pyspark.sql import functions as F

from covermetrics.operators import claims as op
from covermetrics.plans.registry import plan, sql_mean, sql_percent, sql_ratio, sql_round
from covermetrics.sources.book import AS_OF

PLACES = "places AS (SELECT agent_id, region FROM agents JOIN states USING (state_id) JOIN regions USING (region_id))"


@plan("claims_summary", "K12 A1 A4", roles="claims", sql=f"""
SELECT COUNT(*) AS total_claims, {sql_round('SUM(amount)', 0)} AS total_claimed, {sql_mean('fraud_score', 1)} AS avg_fraud,
       {sql_mean('resolution_days', 1)} AS avg_resolution, {sql_mean('amount', 2)} AS avg_claim FROM claims""")
def _(b):
    return op.claims_summary(b.claims)


@plan("fraud_bands", "K9 P13 A3", roles="claims", sql="""
SELECT CASE WHEN fraud_score IS NULL THEN 'unknown' WHEN fraud_score < 20 THEN '0-20 (Low)' WHEN fraud_score < 40 THEN '20-40 (Normal)'
            WHEN fraud_score < 60 THEN '40-60 (Elevated)' WHEN fraud_score < 80 THEN '60-80 (High)' ELSE '80-100 (Critical)' END AS fraud_band,
       COUNT(*) AS claims FROM claims GROUP BY 1""")
def _(b):
    return b.claims.groupBy(op.fraud_band("fraud_score").alias("fraud_band")).agg(F.count(F.lit(1)).alias("claims"))


@plan("fraud_bands_coarse", "K9", roles="claims", sql="""
SELECT CASE WHEN fraud_score < 20 THEN '1. Low' WHEN fraud_score < 50 THEN '2. Medium' WHEN fraud_score < 80 THEN '3. High'
            ELSE '4. Critical' END AS fraud_band, COUNT(*) AS claims FROM claims GROUP BY 1""")
def _(b):
    return b.claims.groupBy(op.coarse_fraud_band("fraud_score").alias("fraud_band")).agg(F.count(F.lit(1)).alias("claims"))


@plan("resolution_bands", "K10", roles="claims", sql=f"""
SELECT CASE WHEN resolution_days IS NULL THEN 'open' WHEN resolution_days <= 30 THEN '0-30 days' WHEN resolution_days <= 90 THEN '31-90 days'
            WHEN resolution_days <= 180 THEN '91-180 days' ELSE '180+ days' END AS resolution_band,
       COUNT(*) AS claims, {sql_mean('friction_score', 2)} AS avg_friction FROM claims GROUP BY 1""")
def _(b):
    return b.claims.groupBy(op.resolution_band("resolution_days").alias("resolution_band")).agg(
        F.count(F.lit(1)).alias("claims"), op.mean("friction_score", 2).alias("avg_friction"))


@plan("resolution_bands_as_written", "K10", roles="claims", sql="""
SELECT CASE WHEN resolution_days <= 30 THEN '0-30 days' WHEN resolution_days <= 90 THEN '31-90 days'
            WHEN resolution_days <= 180 THEN '91-180 days' ELSE '180+ days' END AS resolution_band,
       COUNT(*) AS claims FROM claims GROUP BY 1""")
def _(b):
    return b.claims.groupBy(op.resolution_band("resolution_days", as_written=True).alias("resolution_band")).agg(
        F.count(F.lit(1)).alias("claims"))


@plan("friction_reasons", "K13 P8", roles="claims", sql=f"""
SELECT friction_reason, COUNT(*) AS claims, {sql_mean('amount', 0)} AS avg_claim, {sql_mean('resolution_days', 1)} AS avg_resolution
FROM claims WHERE friction_reason IS NOT NULL GROUP BY 1""")
def _(b):
    return op.friction_reasons(b.claims)


@plan("claims_by_region_month", "K14 J1 P5", roles="claims agents states regions", sql=f"""
WITH {PLACES}
SELECT region, CAST(DATE_TRUNC('month', claim_date) AS DATE) AS month, COUNT(*) AS claim_count,
       {sql_round('SUM(amount)', 2)} AS total_claimed, {sql_mean('fraud_score', 2)} AS avg_fraud_score
FROM claims c JOIN places p ON p.agent_id = c.adjuster_id WHERE claim_date >= DATE '1997-01-01' GROUP BY 1, 2""")
def _(b):
    return op.claims_by_region_month(b.claims, b.agents, b.states, b.regions, "1997-01-01")


@plan("catastrophe_claims", "K15", roles="claims", sql=f"""
SELECT cause, COUNT(*) AS claims, {sql_mean('amount', 2)} AS avg_amount FROM claims WHERE cause = 'Hail' GROUP BY cause""")
def _(b):
    return op.catastrophe_claims(b.claims, "Hail")


@plan("similar_claims", "K16 L1", roles="claims agents", sql="""
WITH top AS (SELECT * FROM claims WHERE cause = 'Collision' ORDER BY claim_date DESC, claim_id, amount, adjuster_id LIMIT 10)
SELECT claim_id, CAST(amount AS DOUBLE) AS amount, claim_date, top.status, fraud_score, resolution_days, a.agent_name AS adjuster
FROM top LEFT JOIN agents a ON a.agent_id = top.adjuster_id""")
def _(b):
    return op.similar_claims(b.claims, b.agents, "Collision").select(
        "claim_id", F.col("amount").cast("double").alias("amount"), "claim_date", "status", "fraud_score",
        "resolution_days", "adjuster")


@plan("recommend_adjuster", "K17 J3 L4", roles="claims agents", sql="""
SELECT a.agent_id, agent_name, specialization, CAST(performance_rating AS DOUBLE) AS performance_rating, COUNT(c.claim_id) AS open_claims
FROM agents a LEFT JOIN claims c ON c.adjuster_id = a.agent_id AND c.status IN ('Open', 'UnderInvestigation')
WHERE a.status = 'Active' GROUP BY ALL ORDER BY open_claims, performance_rating DESC, a.agent_id LIMIT 5""")
def _(b):
    return op.recommend_adjuster(b.agents, b.claims)


@plan("escalation_rate", "K18 F26", roles="claims", sql=f"""
WITH e AS (SELECT cause, (litigation OR fraud_score > 75 OR amount > 100000
           OR CAST('0x' || SUBSTR(MD5(claim_id || 'esc'), 1, 8) AS BIGINT) % 100 < 8) AS hit FROM claims)
SELECT cause, COUNT(*) AS claims, COUNT(*) FILTER (WHERE hit) AS escalated,
       {sql_percent('COUNT(*) FILTER (WHERE hit)', 'COUNT(*)', 2)} AS escalated_pct FROM e GROUP BY cause""")
def _(b):
    return op.escalation_rate(b.claims, ["cause"])


@plan("claim_rates", "K19", roles="claims policies", sql=f"""
SELECT {sql_percent('COUNT(*)', "(SELECT COUNT(*) FROM policies WHERE status = 'Active')", 2)} AS claims_frequency,
       {sql_ratio("SUM(paid) FILTER (WHERE status = 'Closed')", "COUNT(*) FILTER (WHERE status = 'Closed')", 2)} AS average_severity,
       {sql_percent('COUNT(*) FILTER (WHERE fraud_score > 80)', 'COUNT(*)', 2)} AS fraud_detection_rate FROM claims""")
def _(b):
    return op.claim_rates(b.policies, b.claims)


@plan("loss_by_make_model", "K47", roles="claims products", sql=f"""
SELECT carrier, product_name, COUNT(*) AS claims, {sql_round('SUM(amount)', 2)} AS total_loss, {sql_ratio('SUM(amount)', 'COUNT(*)', 2)} AS severity,
       CAST(MAX(amount) AS DOUBLE) AS largest FROM claims JOIN products USING (part_id) GROUP BY 1, 2""")
def _(b):
    return op.loss_by_product(b.claims, b.products, ["carrier", "product_name"])


@plan("friction_top_by_region", "K48 W2", roles="claims agents states regions", sql=f"""
WITH {PLACES}, n AS (SELECT region, friction_reason, COUNT(*) AS claims FROM claims c JOIN places p ON p.agent_id = c.adjuster_id
WHERE friction_reason IS NOT NULL GROUP BY 1, 2)
SELECT region, friction_reason, claims, ROW_NUMBER() OVER (PARTITION BY region ORDER BY claims DESC, friction_reason) AS rank
FROM n QUALIFY rank <= 3""")
def _(b):
    return op.friction_by_region(b.claims, b.agents, b.states, b.regions)


@plan("adjuster_workload", "K49 F15", roles="claims", sql=f"""
SELECT adjuster_id, COUNT(*) FILTER (WHERE status = 'Open') AS open_claims, MAX(claim_date) AS last_activity,
       DATE_DIFF('hour', CAST(MAX(claim_date) AS TIMESTAMP), TIMESTAMP '{AS_OF}') AS hours_idle FROM claims GROUP BY 1""")
def _(b):
    return op.adjuster_workload(b.claims, AS_OF)
