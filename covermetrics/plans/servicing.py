"""Billing, retention, distribution, finance and survey queries."""

from pyspark.sql import functions as F

from covermetrics.functions.dates import fiscal_quarter_start, fiscal_quarter_text
from covermetrics.operators import billing, distribution, finance, retention
from covermetrics.plans.registry import plan, sql_mean, sql_percent, sql_ratio, sql_round
from covermetrics.sources.book import AS_OF

FEATURES = f"""features AS (
SELECT policy_id, customer_id, policy_type, COALESCE(m, 0) AS missed_payments, COALESCE(c, 0) AS claims_filed,
       {sql_round('LEAST(0.9999, CAST(0.20 AS DOUBLE) + COALESCE(m, 0) * CAST(0.08 AS DOUBLE) + COALESCE(c, 0) * CAST(0.04 AS DOUBLE))', 4)} AS churn_probability,
       premium * 12 AS revenue_at_risk, CAST(GREATEST(expiration_date - DATE '{AS_OF}', 0) AS INT) AS days_until_renewal,
       CASE WHEN COALESCE(m, 0) >= 2 THEN 'Payment Default' WHEN COALESCE(m, 0) + COALESCE(c, 0) >= 3 THEN 'Churn' ELSE 'Underinsured' END AS risk_category
FROM policies LEFT JOIN (SELECT policy_id, COUNT(*) AS m FROM invoices WHERE payment_status IN ('Overdue', 'PastDue', 'Partial') GROUP BY 1) USING (policy_id)
LEFT JOIN (SELECT policy_id, COUNT(*) AS c FROM claims GROUP BY 1) USING (policy_id) WHERE status = 'Active')"""
SERVED = "served AS (SELECT adjuster_id AS agent_id, policy_id, COUNT(*) AS claims, SUM(amount) AS incurred FROM claims GROUP BY 1, 2)"


def features(b):
    return retention.churn_features(b.policies, b.invoices, b.claims, AS_OF)


def surveys(b):
    return b.ratings.join(b.filings.select("document_id", F.col("document_type").alias("survey_type")), "document_id")


def applications(b):
    """Every policy request with its outcome, from the policy book."""
    declined = F.col("status") == "Cancelled"
    return b.policies.select(
        "policy_id", "policy_type", F.trunc("bound_date", "month").alias("month"),
        F.when(declined & (F.col("underwriting_score") < 50), "Declined").when(declined, "Withdrawn").otherwise("Bound").alias("status"),
        F.when(declined & (F.col("underwriting_score") < 20), "Poor score").when(declined & (F.col("underwriting_score") < 50), "Prior losses")
        .alias("decline_reason"))


APPLICATIONS = """applications AS (SELECT policy_id, policy_type, CAST(DATE_TRUNC('month', bound_date) AS DATE) AS month,
CASE WHEN status = 'Cancelled' AND underwriting_score < 50 THEN 'Declined' WHEN status = 'Cancelled' THEN 'Withdrawn' ELSE 'Bound' END AS status,
CASE WHEN status = 'Cancelled' AND underwriting_score < 20 THEN 'Poor score' WHEN status = 'Cancelled' AND underwriting_score < 50 THEN 'Prior losses' END AS decline_reason
FROM policies)"""


def ledger(b):
    """Quarterly postings: claims paid, reserves and incurred amounts of each product line."""
    per_part = b.claims.groupBy("part_id", F.trunc("claim_date", "quarter").alias("q")).agg(*[F.sum(c).alias(c) for c in ("paid", "reserve", "amount")])
    per_line = per_part.join(b.products.select("part_id", "line"), "part_id").groupBy("q", "line").agg(
        F.sum("paid").alias("Claims Paid"), F.sum("reserve").alias("Reserve"), F.sum("amount").alias("Incurred"))
    return per_line.unpivot(["q", "line"], ["Claims Paid", "Reserve", "Incurred"], "account_type", "amount").select(
        fiscal_quarter_text("q").alias("fiscal_quarter"), "line", "account_type", "amount")


LEDGER = """ledger AS (SELECT YEAR(claim_date) || '-Q' || QUARTER(claim_date) AS fiscal_quarter, line, k AS account_type, v AS amount FROM (
SELECT claim_date, line, UNNEST(['Claims Paid', 'Reserve', 'Incurred']) AS k, UNNEST([paid, reserve, amount]) AS v
FROM claims JOIN products USING (part_id)))"""


@plan("billing_summary", "K22", roles="invoices", sql=f"""
SELECT payment_status, COUNT(*) AS invoices, {sql_round('SUM(outstanding)', 2)} AS total_outstanding, {sql_round('SUM(late_fee)', 2)} AS total_late_fees
FROM invoices GROUP BY 1""")
def _(b):
    return billing.billing_summary(b.invoices)


@plan("billing_by_method", "K22 P8", roles="invoices", sql=f"""
SELECT payment_method, COUNT(*) AS invoices, {sql_round('SUM(outstanding)', 2)} AS total_outstanding, {sql_round('SUM(late_fee)', 2)} AS total_late_fees
FROM invoices WHERE payment_method IS NOT NULL GROUP BY 1""")
def _(b):
    return billing.billing_summary(b.invoices, "payment_method")


@plan("delinquency_by_month", "K23 A8 A9 L1", roles="invoices", sql=f"""
SELECT CAST(DATE_TRUNC('month', invoice_date) AS DATE) AS month, COUNT(*) AS invoices,
       COUNT(*) FILTER (WHERE payment_status IN ('Overdue', 'PastDue')) AS overdue,
       {sql_percent("COUNT(*) FILTER (WHERE payment_status IN ('Overdue', 'PastDue'))", 'COUNT(*)', 2)} AS overdue_pct
FROM invoices GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def _(b):
    return billing.delinquency_by_month(b.invoices)


@plan("outstanding_receivables", "K24", roles="invoices", sql=f"""
SELECT COUNT(*) AS invoices, {sql_round('SUM(outstanding)', 2)} AS outstanding, {sql_ratio('SUM(outstanding)', 'COUNT(*)', 2)} AS mean_outstanding
FROM invoices WHERE payment_status IN ('Overdue', 'PastDue')""")
def _(b):
    return billing.outstanding_receivables(b.invoices)


@plan("payment_reconciliation", "K51 F21", roles="invoices", sql=f"""
SELECT payment_status, CASE WHEN amount_paid >= amount_due THEN 'full' WHEN amount_paid > 0 THEN 'partial' ELSE 'none' END AS payment_pattern,
       COUNT(*) AS invoices, COUNT(*) FILTER (WHERE ABS(outstanding - (amount_due - amount_paid)) > 0.01) AS mismatched,
       {sql_round('SUM(amount_due)', 2)} AS due, {sql_round('SUM(amount_paid)', 2)} AS paid FROM invoices GROUP BY 1, 2""")
def _(b):
    return billing.payment_reconciliation(b.invoices)


@plan("customer_360", "K25 J5 J6 F2", roles="customers policies claims invoices", sql=f"""
SELECT c.customer_id, full_name, risk_tier, credit_score, segment,
       COALESCE(policy_count, 0) AS policy_count, CAST(COALESCE(claim_count, 0) AS BIGINT) AS claim_count,
       {sql_round('COALESCE(p, 0)', 2)} AS total_premium, {sql_round('COALESCE(o, 0)', 2)} AS total_outstanding
FROM customers c LEFT JOIN (SELECT customer_id, COUNT(*) AS policy_count, SUM(premium) AS p FROM policies GROUP BY 1) a ON a.customer_id = c.customer_id
LEFT JOIN (SELECT customer_id, COUNT(*) AS claim_count FROM claims JOIN policies USING (policy_id) GROUP BY 1) b ON b.customer_id = c.customer_id
LEFT JOIN (SELECT customer_id, SUM(outstanding) AS o FROM invoices JOIN policies USING (policy_id)
           WHERE payment_status IN ('Overdue', 'PastDue') GROUP BY 1) d ON d.customer_id = c.customer_id
ORDER BY total_outstanding DESC, c.customer_id LIMIT 20""")
def _(b):
    return retention.customer_360(b.customers, b.policies, b.claims, b.invoices)


@plan("churn_features", "K30 F22 J5", roles="policies invoices claims", sql=f"""
WITH {FEATURES}
SELECT policy_id, missed_payments, claims_filed, churn_probability, CAST(revenue_at_risk AS DOUBLE) AS revenue_at_risk, days_until_renewal, risk_category
FROM features""")
def _(b):
    return retention.most_exposed(features(b)).select(
        "policy_id", "missed_payments", "claims_filed", "churn_probability",
        F.col("revenue_at_risk").cast("double").alias("revenue_at_risk"), "days_until_renewal", "risk_category")


@plan("risk_summary", "K31", roles="policies invoices claims", sql=f"""
WITH {FEATURES}
SELECT risk_category, COUNT(*) AS at_risk, {sql_round('SUM(revenue_at_risk)', 2)} AS total_revenue_at_risk,
       {sql_mean('CAST(churn_probability AS DECIMAL(9,4))', 4)} AS avg_churn, {sql_mean('missed_payments', 1)} AS avg_missed FROM features GROUP BY 1""")
def _(b):
    return retention.risk_summary(features(b), ["risk_category"])


@plan("revenue_at_risk_by_region", "K31 J1", roles="policies invoices claims customers states regions", sql=f"""
WITH {FEATURES}
SELECT policy_type, region, COUNT(*) AS at_risk, {sql_round('SUM(revenue_at_risk)', 2)} AS total_revenue_at_risk,
       {sql_mean('CAST(churn_probability AS DECIMAL(9,4))', 4)} AS avg_churn, {sql_mean('missed_payments', 1)} AS avg_missed
FROM features JOIN customers USING (customer_id) JOIN states USING (state_id) JOIN regions USING (region_id) GROUP BY 1, 2""")
def _(b):
    places = b.customers.select("customer_id", "state_id").join(b.states, "state_id").join(b.regions, "region_id")
    return retention.risk_summary(features(b).join(places.select("customer_id", "region"), "customer_id"), ["policy_type", "region"])


@plan("top_at_risk", "K32 L3", roles="policies invoices claims", sql=f"""
WITH {FEATURES}
SELECT policy_id, customer_id, churn_probability, CAST(revenue_at_risk AS DOUBLE) AS revenue_at_risk FROM features
ORDER BY CAST(churn_probability AS DECIMAL(9,4)) * revenue_at_risk DESC, policy_id LIMIT 10""")
def _(b):
    return retention.top_at_risk(features(b)).select(
        "policy_id", "customer_id", "churn_probability", F.col("revenue_at_risk").cast("double").alias("revenue_at_risk"))


@plan("retention_candidates", "K33 T11", roles="policies invoices claims customers", sql=f"""
WITH {FEATURES}, best AS (SELECT * FROM features WHERE churn_probability > 0.5 ORDER BY revenue_at_risk DESC, policy_id LIMIT 30)
SELECT policy_id, customer_id, state_id, risk_category, churn_probability, CAST(revenue_at_risk AS DOUBLE) AS revenue_at_risk, credit_score, risk_tier, segment, missed_payments,
       CASE WHEN risk_category = 'Payment Default' AND churn_probability > 0.7 THEN 'Payment plan and agent call'
            WHEN risk_category = 'Payment Default' THEN 'Payment reminder' WHEN churn_probability > 0.7 THEN 'Agent call with discount offer'
            WHEN risk_category = 'Underinsured' THEN 'Coverage review' ELSE 'Auto-renew lock' END AS action
FROM best JOIN customers USING (customer_id)""")
def _(b):
    return retention.retention_candidates(features(b), b.customers)


@plan("tier_drift", "K34", roles="attribute_history", sql="""
SELECT old_value, new_value, COUNT(*) AS changes, MIN(change_date) AS earliest, MAX(change_date) AS latest FROM attribute_history
WHERE attribute_name = 'RISK_TIER' GROUP BY 1, 2 ORDER BY changes DESC, old_value, new_value LIMIT 10""")
def _(b):
    return retention.tier_drift(b.attribute_history)


@plan("tier_drift_after_claim", "K35 J12", roles="attribute_history policies claims", sql=f"""
WITH h AS (SELECT *, EXISTS (SELECT 1 FROM claims c JOIN policies p USING (policy_id) WHERE p.customer_id = a.customer_id
           AND c.claim_date BETWEEN a.change_date - 90 AND a.change_date) AS hit FROM attribute_history a WHERE attribute_name = 'RISK_TIER')
SELECT old_value, new_value, COUNT(*) AS changes, COUNT(*) FILTER (WHERE hit) AS after_claim,
       {sql_percent('COUNT(*) FILTER (WHERE hit)', 'COUNT(*)', 2)} AS after_claim_pct FROM h GROUP BY 1, 2""")
def _(b):
    return retention.tier_drift_after_claim(b.attribute_history, b.policies, b.claims)


@plan("customer_lifetime_value", "K36", roles="policies", sql=f"""
SELECT customer_id, {sql_round('CAST(SUM(premium) AS DOUBLE) * 3.5', 2)} AS lifetime_value FROM policies GROUP BY 1""")
def _(b):
    return retention.customer_lifetime_value(b.policies)


@plan("household_rollup", "K36", roles="customers policies", sql=f"""
SELECT household_id, COUNT(DISTINCT customer_id) AS members, COUNT(policy_id) AS policies, {sql_round('COALESCE(SUM(premium), 0)', 2)} AS premium
FROM customers LEFT JOIN policies USING (customer_id) GROUP BY 1""")
def _(b):
    return retention.household_rollup(b.customers, b.policies)


NPS = f"""COUNT(*) AS surveys, COUNT(*) FILTER (WHERE nps_rating >= 9) AS promoters, COUNT(*) FILTER (WHERE nps_rating IN (7, 8)) AS passives,
COUNT(*) FILTER (WHERE nps_rating <= 6) AS detractors,
{sql_percent('COUNT(*) FILTER (WHERE nps_rating >= 9) - COUNT(*) FILTER (WHERE nps_rating <= 6)', 'COUNT(*)')} AS nps,
{sql_mean('satisfaction', 1)} AS avg_satisfaction, {sql_mean('nps_rating', 1)} AS avg_rating"""


@plan("nps_from_labels", "K37 K38 T16", roles="ratings", sql=f"SELECT {NPS} FROM ratings")
def _(b):
    return retention.nps(b.ratings)


@plan("satisfaction_by_type", "K39", roles="ratings filings", sql=f"""
SELECT document_type AS survey_type, {NPS} FROM ratings JOIN filings USING (document_id) GROUP BY 1""")
def _(b):
    return retention.nps(surveys(b), ["survey_type"])


@plan("nps_distribution", "K39 A17", roles="ratings", sql="""
SELECT CASE WHEN nps_rating >= 9 THEN 'Promoter' WHEN nps_rating >= 7 THEN 'Passive' ELSE 'Detractor' END AS category, COUNT(*) AS surveys
FROM ratings GROUP BY 1""")
def _(b):
    return b.ratings.groupBy(retention.nps_category("nps_rating").alias("category")).agg(F.count(F.lit(1)).alias("surveys"))


@plan("renewal_calendar", "K50 F22", roles="policies", sql=f"""
SELECT days_until_renewal, COUNT(*) AS policies FROM (SELECT CAST(GREATEST(expiration_date - DATE '{AS_OF}', 0) AS INT) AS days_until_renewal FROM policies) GROUP BY 1""")
def _(b):
    return retention.renewal_calendar(b.policies, AS_OF).groupBy("days_until_renewal").agg(F.count(F.lit(1)).alias("policies"))


@plan("agent_scorecard", "K26 L2", roles="agents policies invoices claims", sql=f"""
WITH {FEATURES}, {SERVED},
g AS (SELECT agent_id, COUNT(*) AS policies, CAST(SUM(claims) AS BIGINT) AS claims, COUNT(features.policy_id) AS at_risk, SUM(revenue_at_risk) AS v
      FROM served LEFT JOIN features USING (policy_id) GROUP BY 1)
SELECT agent_id, agent_name, specialization, CAST(performance_rating AS DOUBLE) AS performance_rating, COALESCE(policies, 0) AS policies, COALESCE(claims, 0) AS claims,
       COALESCE(at_risk, 0) AS at_risk, {sql_round('v', 2)} AS revenue_at_risk
FROM agents LEFT JOIN g USING (agent_id) ORDER BY revenue_at_risk DESC NULLS LAST, agent_id LIMIT 20""")
def _(b):
    return distribution.agent_scorecard(b.agents, distribution.agent_policies(b.claims), features(b))


@plan("agent_loss_ratio", "K20 K29", roles="claims policies", sql=f"""
WITH {SERVED} SELECT agent_id, COUNT(*) AS policies, {sql_percent('SUM(incurred)', 'SUM(premium)')} AS loss_ratio FROM served JOIN policies USING (policy_id) GROUP BY 1""")
def _(b):
    return distribution.agent_loss_ratio(distribution.agent_policies(b.claims), b.policies)


@plan("commission_payout", "K20", roles="claims policies agents", sql=f"""
WITH {SERVED}, g AS (SELECT agent_id, SUM(premium) AS p FROM served JOIN policies USING (policy_id) GROUP BY 1)
SELECT agent_id, {sql_round('CAST(p AS DOUBLE) * CAST(commission_rate AS DOUBLE)', 2)} AS commission FROM g JOIN agents USING (agent_id)""")
def _(b):
    return distribution.commission_payout(distribution.agent_policies(b.claims), b.policies, b.agents)


@plan("agents_in_state", "K27", roles="claims agents", sql=f"""
WITH {SERVED} SELECT agent_id, agent_name, specialization, COUNT(policy_id) AS policies FROM agents LEFT JOIN served USING (agent_id)
WHERE state_id = 3 AND status = 'Active' GROUP BY 1, 2, 3 ORDER BY policies DESC, agent_id LIMIT 10""")
def _(b):
    return distribution.agents_in_state(b.agents, distribution.agent_policies(b.claims), 3)


@plan("low_rated_busy_agents", "K27", roles="claims agents", sql=f"""
WITH {SERVED} SELECT agent_id, agent_name, CAST(performance_rating AS DOUBLE) AS performance_rating, COUNT(*) AS policies FROM agents JOIN served USING (agent_id)
WHERE performance_rating < 2 GROUP BY 1, 2, 3 HAVING COUNT(*) > 75""")
def _(b):
    return distribution.low_rated_busy_agents(b.agents, distribution.agent_policies(b.claims))


@plan("coverage_profile", "K28 J13", roles="policies customers", sql=f"""
SELECT policy_type, COUNT(*) AS policies, {sql_mean('premium', 0)} AS avg_premium, {sql_mean('coverage', 0)} AS avg_coverage, {sql_mean('deductible', 0)} AS avg_deductible
FROM policies WHERE customer_id IN (SELECT customer_id FROM customers WHERE state_id = 7) GROUP BY 1""")
def _(b):
    return distribution.coverage_profile(b.policies, b.customers, 7)


@plan("onboarding_velocity", "K42", roles="agents", sql=f"""
SELECT specialization, COUNT(*) AS agents, {sql_mean('hire_date - application_date', 2)} AS mean_days FROM agents GROUP BY 1""")
def _(b):
    return distribution.onboarding_velocity(b.agents, "specialization")


@plan("quote_to_bind", "K40", roles="policies", sql=f"""
WITH {APPLICATIONS} SELECT month, COUNT(*) AS applications, COUNT(*) FILTER (WHERE status = 'Bound') AS bound,
{sql_percent("COUNT(*) FILTER (WHERE status = 'Bound')", 'COUNT(*)')} AS bind_pct FROM applications GROUP BY 1""")
def _(b):
    return finance.quote_to_bind(applications(b), ["month"])


@plan("decline_rate", "K41", roles="policies", sql=f"""
WITH {APPLICATIONS} SELECT policy_type, COUNT(*) AS applications, COUNT(*) FILTER (WHERE status = 'Declined') AS declined,
{sql_percent("COUNT(*) FILTER (WHERE status = 'Declined')", 'COUNT(*)')} AS decline_pct FROM applications GROUP BY 1""")
def _(b):
    return finance.decline_rate(applications(b), ["policy_type"])


@plan("decline_reasons", "K41", roles="policies", sql=f"""
WITH {APPLICATIONS} SELECT decline_reason, COUNT(*) AS applications FROM applications WHERE decline_reason IS NOT NULL GROUP BY 1""")
def _(b):
    return finance.decline_reasons(applications(b))


@plan("endorsement_churn", "K43 F32", roles="attribute_history", sql=f"""
WITH r AS (SELECT attribute_name, NULLIF(LIST_POSITION(['Critical', 'High', 'Medium', 'Low'], old_value), 0) AS o,
                  NULLIF(LIST_POSITION(['Critical', 'High', 'Medium', 'Low'], new_value), 0) AS n FROM attribute_history)
SELECT attribute_name, COUNT(*) AS changes, COUNT(*) FILTER (WHERE n < o) AS downgrades,
       {sql_percent('COUNT(*) FILTER (WHERE n < o)', 'COUNT(*)', 2)} AS downgrade_pct FROM r GROUP BY 1""")
def _(b):
    return finance.endorsement_churn(b.attribute_history, ["Critical", "High", "Medium", "Low"], ["attribute_name"])


@plan("ledger_rollup", "K44 F19", roles="claims products", sql=f"""
WITH {LEDGER} SELECT fiscal_quarter, account_type, line, {sql_round('SUM(amount)', 2)} AS amount,
CAST(MAKE_DATE(CAST(SUBSTR(fiscal_quarter, 1, 4) AS INT), (CAST(SUBSTR(fiscal_quarter, 7, 1) AS INT) - 1) * 3 + 1, 1) AS DATE) AS quarter_start
FROM ledger GROUP BY 1, 2, 3""")
def _(b):
    return finance.ledger_rollup(ledger(b)).withColumn("quarter_start", fiscal_quarter_start("fiscal_quarter"))


@plan("ledger_pivot", "K44 A15", roles="claims products", sql=f"""
WITH {LEDGER} SELECT fiscal_quarter, {sql_round("COALESCE(SUM(amount) FILTER (WHERE account_type = 'Claims Paid'), 0)", 2)} AS "Claims Paid",
{sql_round("COALESCE(SUM(amount) FILTER (WHERE account_type = 'Reserve'), 0)", 2)} AS "Reserve",
{sql_round("COALESCE(SUM(amount) FILTER (WHERE account_type = 'Incurred'), 0)", 2)} AS "Incurred" FROM ledger GROUP BY 1""")
def _(b):
    return finance.ledger_pivot(ledger(b), ["Claims Paid", "Reserve", "Incurred"])


def treaties(b):
    """A treaty per agent state; every fifth state's treaty states no rate."""
    return b.states.select(F.col("state_id").alias("treaty_id"),
                           F.when(F.col("state_id") % 5 != 0, (F.lit(20) + F.col("state_id") * 2) / 100.0).alias("cession_rate"))


@plan("reinsurance_recovery", "K45 P16", roles="claims agents states", sql=f"""
WITH g AS (SELECT a.state_id AS treaty_id, c.status, SUM(amount) AS g, SUM(reserve) AS r FROM claims c JOIN agents a ON a.agent_id = c.adjuster_id GROUP BY 1, 2),
t AS (SELECT g.*, {sql_round("CAST(g AS DOUBLE) * COALESCE(CASE WHEN treaty_id % 5 <> 0 THEN (20 + treaty_id * 2) / CAST(100 AS DOUBLE) END, 0.5)", 2)} AS ceded FROM g)
SELECT treaty_id, status, {sql_round('SUM(g)', 2)} AS gross_loss, {sql_round('SUM(ceded)', 2)} AS ceded, {sql_percent('SUM(r)', 'SUM(ceded)')} AS recovery_pct FROM t GROUP BY 1, 2""")
def _(b):
    per_agent = b.claims.groupBy(F.col("adjuster_id").alias("agent_id"), "status").agg(
        F.sum("amount").alias("gross_loss"), F.sum("reserve").alias("recovered"))
    losses = per_agent.join(b.agents.select("agent_id", F.col("state_id").alias("treaty_id")), "agent_id")
    return finance.reinsurance_recovery(losses, treaties(b))


@plan("reserve_vs_guideline", "K46", roles="claims agents states", sql=f"""
WITH g AS (SELECT a.state_id, cause, {sql_ratio('SUM(reserve)', 'SUM(amount)', 4)} AS reserve_ratio FROM claims c JOIN agents a ON a.agent_id = c.adjuster_id GROUP BY 1, 2)
SELECT state_id, cause, reserve_ratio, (85 + state_id % 10) / CAST(1000 AS DOUBLE) AS minimum_ratio,
       reserve_ratio >= (85 + state_id % 10) / CAST(1000 AS DOUBLE) AS adequate FROM g""")
def _(b):
    per_agent = b.claims.groupBy(F.col("adjuster_id").alias("agent_id"), "cause").agg(F.sum("reserve").alias("reserve"), F.sum("amount").alias("amount"))
    located = per_agent.join(b.agents.select("agent_id", "state_id"), "agent_id")
    guide = b.states.select("state_id", ((F.lit(85) + F.col("state_id") % 10) / 1000.0).alias("minimum_ratio"))
    causes = F.explode(F.array(F.lit("Hail"), F.lit("Collision"), F.lit("Water"))).alias("cause")
    return finance.reserve_vs_guideline(located, guide.select("state_id", causes, "minimum_ratio"), ["state_id", "cause"])
