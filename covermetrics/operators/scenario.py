"""What-if grids, threshold alerts, brief metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermetrics.functions.numbers import rounded
from covermetrics.operators.billing import status_is
from covermetrics.operators.portfolio import claims_per_policy

# Expense loading in points and the invested share of premium.
EXPENSE_POINTS = 30.0
INVESTED_SHARE = 0.3
LEVERS = ("premium_pct", "churn_pct", "claims_pct", "inflation_pct", "cat_factor", "interest_pct")


def lever_grid(spark: SparkSession, **values: Sequence[float]) -> DataFrame:
    """Every combination of the given lever values; a lever left out stays neutral."""
    neutral = {name: [1.0 if name == "cat_factor" else 0.0] for name in LEVERS}
    grid = spark.range(1)
    for name, options in {**neutral, **values}.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in options])))
    return grid.drop("id")


def scenario_grid(policies: DataFrame, claims: DataFrame, levers: DataFrame) -> DataFrame:
    """Adjusted premium, losses, ratios and net result of each lever combination.

    The baseline is one aggregate row, read as a scalar subquery.
    """
    base = policies.join(claims_per_policy(claims), "policy_id", "left").agg(F.struct(
        F.sum("premium").cast("double").alias("premium"), F.sum("incurred").cast("double").alias("incurred"),
        F.sum("claims").alias("claims"))).scalar()

    def up(lever):
        return F.lit(1.0) + F.col(lever) / 100.0
    g = levers.withColumn("_b", base)
    g = g.withColumn("_p", F.col("_b.premium") * up("premium_pct") * (F.lit(1.0) - F.col("churn_pct") / 100.0))
    g = g.withColumn("_i", F.col("_b.incurred") * up("claims_pct") * up("inflation_pct") * F.col("cat_factor"))
    g = g.withColumn("_n", F.col("_b.premium") * (F.col("interest_pct") / 100.0) * INVESTED_SHARE)
    g = g.withColumn("loss_ratio", rounded(F.col("_i") / F.greatest("_p", F.lit(1.0)) * 100.0, 1))
    return g.select(
        *LEVERS, rounded("_p", 0).alias("premium"), rounded("_i", 0).alias("incurred"),
        F.floor(F.col("_b.claims") * up("claims_pct") * F.col("cat_factor")).alias("claims"),
        "loss_ratio", rounded(F.col("loss_ratio") + EXPENSE_POINTS, 1).alias("combined_ratio"),
        rounded("_n", 0).alias("investment_income"), rounded(F.col("_p") - F.col("_i"), 0).alias("underwriting_result"),
        rounded(F.col("_p") - F.col("_i") + F.col("_n"), 0).alias("net_result"))


def threshold_alerts(claims: DataFrame, invoices: DataFrame, at_risk: DataFrame, segments: DataFrame, anomalies: DataFrame) -> DataFrame:
    def one(name, df, cond, amount=None):
        total = rounded(F.sum(F.when(cond, F.col(amount))), 0) if amount else F.lit(None).cast("double")
        return df.agg(F.count_if(cond).alias("n"), total.alias("amount")).select(F.lit(name).alias("alert"), "n", "amount")
    parts = [
        one("high_fraud_claims", claims, F.col("fraud_score") > 80, "amount"),
        one("overdue_invoices", invoices, status_is("payment_status", "Overdue"), "outstanding"),
        one("high_churn_policies", at_risk, F.col("churn_probability") > 0.7, "revenue_at_risk"),
        one("underpriced_segments", segments, F.col("pricing_status") == "UNDERPRICED"),
        one("anomalous_months", anomalies, F.col("is_anomaly")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brief_metrics(claims: DataFrame, policies: DataFrame, at_risk: DataFrame, as_of: str, days: int) -> DataFrame:
    """Recent claims and policies, each aggregated on its own, side by side."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    new_policies = policies.filter(F.col("effective_date") >= since).agg(F.struct(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("premium"), 0).alias("p"))).scalar()
    churn = at_risk.agg(F.count_if(F.col("churn_probability") > 0.7)).scalar()
    return claims.filter(F.col("claim_date") >= since).agg(
        F.count(F.lit(1)).alias("new_claims"), rounded(F.sum("amount"), 0).alias("total_incurred"),
        F.count_if(F.col("fraud_score") > 80).alias("high_fraud"),
    ).withColumn("_p", new_policies).select(
        "new_claims", "total_incurred", F.col("_p.n").alias("new_policies"), F.col("_p.p").alias("new_premium"),
        churn.alias("high_churn"), "high_fraud")


def most_common(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1)


__all__ = ["LEVERS", "brief_metrics", "lever_grid", "most_common", "scenario_grid", "threshold_alerts"]
