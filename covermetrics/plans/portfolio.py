"""Portfolio queries."""

from pyspark.sql import functions as F

from covermetrics.functions.dates import period_start
from covermetrics.operators import portfolio as op
from covermetrics.plans.registry import plan, sql_mean, sql_percent, sql_round
from covermetrics.sources.book import AS_OF

PER_POLICY = "per_policy AS (SELECT policy_id, COUNT(*) AS claims, SUM(amount) AS incurred, SUM(paid) AS paid FROM claims GROUP BY policy_id)"


@plan("combined_ratio_by_tier", "K2 J5 P16 P17 A2 S1", roles="policies claims", sql=f"""
WITH {PER_POLICY}
SELECT policy_type, {sql_round('SUM(premium)', 2)} AS premium,
       {sql_percent('COALESCE(SUM(paid), 0)', 'SUM(premium)')} AS loss_ratio,
       {sql_percent('SUM(expense)', 'SUM(premium)')} AS expense_ratio,
       {sql_percent('CAST(COALESCE(SUM(paid), 0) AS DOUBLE) + CAST(SUM(expense) AS DOUBLE)', 'SUM(premium)')} AS combined_ratio
FROM policies LEFT JOIN per_policy USING (policy_id) GROUP BY policy_type""")
def _(b):
    return op.combined_ratio(b.policies, b.claims, ["policy_type"])


@plan("combined_ratio_by_line", "K2 J5", roles="policies claims", sql=f"""
WITH {PER_POLICY}
SELECT line_of_business, {sql_round('SUM(premium)', 2)} AS premium,
       {sql_percent('COALESCE(SUM(paid), 0)', 'SUM(premium)')} AS loss_ratio,
       {sql_percent('SUM(expense)', 'SUM(premium)')} AS expense_ratio,
       {sql_percent('CAST(COALESCE(SUM(paid), 0) AS DOUBLE) + CAST(SUM(expense) AS DOUBLE)', 'SUM(premium)')} AS combined_ratio
FROM policies LEFT JOIN per_policy USING (policy_id) GROUP BY line_of_business""")
def _(b):
    return op.combined_ratio(b.policies, b.claims, ["line_of_business"])


@plan("loss_ratio_fanout_as_written", "K3 J2", roles="policies claims", sql=f"""
SELECT policy_type, COUNT(c.policy_id) AS claims, {sql_percent('SUM(amount)', 'SUM(premium)')} AS loss_ratio,
       CASE WHEN {sql_percent('SUM(amount)', 'SUM(premium)')} > 100 THEN 'Critical (>100%)'
            WHEN {sql_percent('SUM(amount)', 'SUM(premium)')} > 70 THEN 'Elevated (70-100%)' ELSE 'Healthy (<70%)' END AS status
FROM policies p LEFT JOIN claims c ON c.policy_id = p.policy_id GROUP BY policy_type""")
def _(b):
    return op.loss_ratio_by(b.policies, b.claims, ["policy_type"], fanout=True)


@plan("loss_ratio_by_line_banded", "K3 K29 J3 P13", roles="policies claims", sql=f"""
WITH r AS (SELECT policy_type, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS claims, {sql_percent('SUM(i)', 'SUM(premium)')} AS loss_ratio
FROM policies p LEFT JOIN (SELECT policy_id, COUNT(*) AS n, SUM(amount) AS i FROM claims
                           WHERE claim_date >= DATE '1999-01-01' GROUP BY policy_id) c USING (policy_id)
GROUP BY policy_type)
SELECT *, CASE WHEN loss_ratio > 100 THEN 'Critical (>100%)' WHEN loss_ratio > 70 THEN 'Elevated (70-100%)'
               WHEN loss_ratio IS NOT NULL THEN 'Healthy (<70%)' END AS status FROM r""")
def _(b):
    return op.loss_ratio_by(b.policies, b.claims, ["policy_type"], since="1999-01-01")


@plan("loss_ratio_by_state", "K29 J1", roles="policies claims customers states", sql=f"""
WITH {PER_POLICY},
r AS (SELECT s.state, CAST(COALESCE(SUM(claims), 0) AS BIGINT) AS claims, {sql_percent('SUM(incurred)', 'SUM(premium)')} AS loss_ratio
FROM policies p LEFT JOIN per_policy USING (policy_id) JOIN customers c USING (customer_id) JOIN states s USING (state_id)
GROUP BY s.state)
SELECT *, CASE WHEN loss_ratio > 100 THEN 'Critical (>100%)' WHEN loss_ratio > 70 THEN 'Elevated (70-100%)'
               WHEN loss_ratio IS NOT NULL THEN 'Healthy (<70%)' END AS status FROM r""")
def _(b):
    located = b.policies.join(b.customers.select("customer_id", "state_id"), "customer_id")
    by_id = op.with_claims(located, b.claims).groupBy("state_id").agg(
        F.sum("premium").alias("p"), F.sum("incurred").alias("i"), F.sum("claims").alias("n"))
    out = by_id.join(b.states, "state_id").select(
        "state", F.coalesce("n", F.lit(0)).alias("claims"), op.percent("i", "p").alias("loss_ratio"))
    return out.withColumn("status", op.ratio_status("loss_ratio"))


@plan("portfolio_kpis", "K1 A1 F20", roles="policies claims", sql=f"""
WITH c AS (SELECT policy_id, SUM(amount) AS i FROM claims WHERE claim_date >= DATE '2001-01-01' GROUP BY policy_id)
SELECT COUNT(*) AS policies, {sql_round('SUM(premium)', 0)} AS written_premium,
       {sql_round('CAST(SUM(premium) AS DOUBLE) * 0.92', 0)} AS earned_premium, {sql_round('SUM(i)', 0)} AS incurred_claims,
       {sql_percent('SUM(i)', 'CAST(SUM(premium) AS DOUBLE) * 0.92')} AS loss_ratio
FROM policies LEFT JOIN c USING (policy_id) WHERE effective_date <= DATE '{AS_OF}'""")
def _(b):
    return op.portfolio_kpis(b.policies, b.claims, AS_OF, since="2001-01-01")


@plan("premium_by_period", "F20 U1", roles="policies", sql="""
SELECT 'MTD' AS period, COUNT(*) AS policies, CAST(SUM(premium) AS DOUBLE) AS premium FROM policies WHERE effective_date >= DATE '2001-07-01'
UNION ALL SELECT 'QTD', COUNT(*), CAST(SUM(premium) AS DOUBLE) FROM policies WHERE effective_date >= DATE '2001-07-01'
UNION ALL SELECT 'YTD', COUNT(*), CAST(SUM(premium) AS DOUBLE) FROM policies WHERE effective_date >= DATE '2001-01-01'""")
def _(b):
    as_of = "2001-07-31"
    inside = {p: F.col("effective_date") >= period_start(as_of, p) for p in ("MTD", "QTD", "YTD")}
    cells = b.policies.filter(inside["YTD"]).agg(*[
        F.struct(F.count_if(c).alias("policies"), F.sum(F.when(c, F.col("premium"))).cast("double").alias("premium")).alias(p)
        for p, c in inside.items()])
    return cells.unpivot([], list(inside), "period", "v").select("period", "v.policies", "v.premium")


@plan("premium_vs_claims_monthly", "K4 J4 F13 F14", roles="policies claims", sql=f"""
WITH c AS (SELECT policy_id, CAST(DATE_TRUNC('month', claim_date) AS DATE) AS month, SUM(amount) AS i FROM claims GROUP BY 1, 2)
SELECT CAST(DATE_TRUNC('month', effective_date) AS DATE) AS month, {sql_round('SUM(premium)', 0)} AS written_premium,
       {sql_round('SUM(i)', 0)} AS incurred_claims
FROM policies p LEFT JOIN c ON c.policy_id = p.policy_id AND c.month = CAST(DATE_TRUNC('month', effective_date) AS DATE)
WHERE effective_date >= DATE '2000-07-31' GROUP BY 1""")
def _(b):
    return op.premium_vs_claims_trend(b.policies, b.claims, "2000-07-31")


@plan("premium_claims_unpivot", "A16 K4", roles="policies claims", sql=f"""
WITH c AS (SELECT policy_id, CAST(DATE_TRUNC('month', claim_date) AS DATE) AS month, SUM(amount) AS i FROM claims GROUP BY 1, 2),
w AS (SELECT CAST(DATE_TRUNC('month', effective_date) AS DATE) AS month, {sql_round('SUM(premium)', 0)} AS p, {sql_round('SUM(i)', 0)} AS i
FROM policies p LEFT JOIN c ON c.policy_id = p.policy_id AND c.month = CAST(DATE_TRUNC('month', effective_date) AS DATE)
WHERE effective_date >= DATE '2000-07-31' GROUP BY 1)
SELECT month, 'written_premium' AS metric, p AS amount FROM w UNION ALL SELECT month, 'incurred_claims', i FROM w""")
def _(b):
    wide = op.premium_vs_claims_trend(b.policies, b.claims, "2000-07-31")
    return op.melt(wide, ["month"], ["written_premium", "incurred_claims"], "metric", "amount")


@plan("portfolio_mix", "K5 A11 P7", roles="policies", sql=f"""
WITH g AS (SELECT policy_type, SUM(premium) AS p FROM policies WHERE status IN ('Active', 'InForce', 'Renewed') GROUP BY 1)
SELECT policy_type, {sql_round('p', 0)} AS premium, {sql_percent('p', 'SUM(p) OVER ()')} AS share_pct FROM g""")
def _(b):
    return op.portfolio_mix(b.policies, ["Active", "InForce", "Renewed"])


@plan("policy_distribution", "K8 A7 W4", roles="policies", sql=f"""
SELECT status, COUNT(*) AS n, {sql_mean('premium', 2)} AS avg_premium, {sql_mean('coverage', 0)} AS avg_coverage,
       {sql_mean('underwriting_score', 2)} AS avg_score FROM policies GROUP BY status""")
def _(b):
    return op.distribution(b.policies, "status", {
        "avg_premium": ("premium", 2), "avg_coverage": ("coverage", 0), "avg_score": ("underwriting_score", 2)})


@plan("customer_distribution", "K8 K11 A3", roles="customers", sql=f"""
SELECT CASE WHEN credit_score < 580 THEN '1. Poor' WHEN credit_score < 670 THEN '2. Fair' WHEN credit_score < 740 THEN '3. Good'
            WHEN credit_score < 800 THEN '4. Very Good' ELSE '5. Excellent' END AS credit_band,
       risk_tier, COUNT(*) AS customers, {sql_mean('credit_score', 0)} AS avg_credit FROM customers GROUP BY 1, 2""")
def _(b):
    from covermetrics.operators.claims import credit_band
    return b.customers.groupBy(credit_band("credit_score").alias("credit_band"), "risk_tier").agg(
        F.count(F.lit(1)).alias("customers"), op.mean("credit_score", 0).alias("avg_credit"))


@plan("monthly_claim_series", "K6 M1", roles="policies claims", sql=f"""
SELECT policy_type AS series, CAST(DATE_TRUNC('month', claim_date) AS DATE) AS month, COUNT(*) AS claim_count,
       {sql_round('SUM(amount)', 2)} AS total_incurred, {sql_mean('fraud_score', 2)} AS avg_fraud_score
FROM claims JOIN policies USING (policy_id) GROUP BY 1, 2""")
def _(b):
    return op.monthly_claim_series(b.policies, b.claims)


@plan("loss_ratio_series_split", "K7 K6 J17", roles="policies claims", sql=f"""
WITH c AS (SELECT policy_id, CAST(DATE_TRUNC('month', claim_date) AS DATE) AS month, SUM(amount) AS i FROM claims GROUP BY 1, 2),
s AS (SELECT month, {sql_percent('SUM(i)', 'SUM(premium)', 2)} AS loss_ratio FROM c JOIN policies USING (policy_id) GROUP BY month)
SELECT month, loss_ratio, CASE WHEN month >= CAST((SELECT MAX(month) FROM s) - INTERVAL 3 MONTH AS DATE) THEN 'test' ELSE 'train' END AS part FROM s""")
def _(b):
    return op.split_last_months(op.monthly_loss_ratio(b.policies, b.claims))


@plan("premium_yoy_change", "A20 W7 J20", roles="policies", sql=f"""
WITH s AS (SELECT CAST(DATE_TRUNC('month', effective_date) AS DATE) AS month, CAST(SUM(premium) AS DOUBLE) AS premium FROM policies GROUP BY 1),
t AS (SELECT month, premium, LAG(premium) OVER (ORDER BY month) AS prev,
             (SELECT premium FROM s y WHERE y.month = CAST(s.month - INTERVAL 12 MONTH AS DATE)) AS year_ago FROM s)
SELECT month, premium, {sql_percent('premium - prev', 'prev', 2)} AS mom_pct, {sql_percent('premium - year_ago', 'year_ago', 2)} AS yoy_pct FROM t""")
def _(b):
    monthly = b.policies.groupBy(op.month_of("effective_date").alias("month")).agg(F.sum("premium").cast("double").alias("premium"))
    return op.change_over_periods(monthly, "premium")


@plan("underwriting_profit_by_tier", "K20", roles="policies claims", sql=f"""
WITH {PER_POLICY}
SELECT policy_type, {sql_round('CAST(SUM(premium) AS DOUBLE) * 0.92 - (CAST(COALESCE(SUM(incurred), 0) AS DOUBLE) + CAST(SUM(expense) AS DOUBLE))', 0)} AS underwriting_profit
FROM policies LEFT JOIN per_policy USING (policy_id) GROUP BY policy_type""")
def _(b):
    return op.underwriting_profit(b.policies, b.claims, ["policy_type"])


@plan("binding_velocity", "K20 F15", roles="policies", sql=f"""
SELECT policy_type, COUNT(*) AS policies, {sql_mean("effective_date - bound_date", 2)} AS mean_days_to_effective FROM policies GROUP BY 1""")
def _(b):
    return op.binding_velocity(b.policies, ["policy_type"])


@plan("churn_rate", "K21 A8", roles="policies", sql=f"""
SELECT line_of_business, COUNT(*) FILTER (WHERE status IN ('Cancelled', 'Non-Renewed')) AS lost,
       COUNT(*) FILTER (WHERE status = 'Active') AS active,
       {sql_percent("COUNT(*) FILTER (WHERE status IN ('Cancelled', 'Non-Renewed'))", "COUNT(*) FILTER (WHERE status = 'Active')", 2)} AS churn_pct
FROM policies GROUP BY 1""")
def _(b):
    return op.churn_rate(b.policies, ["line_of_business"])
