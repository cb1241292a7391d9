"""Customers: lifetime view, churn features, tier drift, surveys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.functions.dates import days_until
from covermetrics.functions.numbers import mean, percent, rounded
from covermetrics.operators.billing import status_is

# Churn score weights and thresholds.
CHURN_BASE, CHURN_PER_MISSED, CHURN_PER_CLAIM, CHURN_MAX = 0.20, 0.08, 0.04, 0.9999


def customer_360(customers: DataFrame, policies: DataFrame, claims: DataFrame, invoices: DataFrame,
                 k: int | None = 20) -> DataFrame:
    """Policies, claims, premium and overdue balance per customer, each summed on its own."""
    owned = policies.groupBy("customer_id").agg(F.count(F.lit(1)).alias("policy_count"), F.sum("premium").alias("p"))
    per_policy = claims.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n"))
    balance = invoices.filter(status_is("payment_status", "Overdue")).groupBy("policy_id").agg(F.sum("outstanding").alias("o"))
    owner = policies.select("policy_id", "customer_id")
    activity = (
        owner.join(per_policy, "policy_id", "left").join(balance, "policy_id", "left")
        .groupBy("customer_id").agg(F.sum("n").alias("claim_count"), F.sum("o").alias("o"))
    )
    out = customers.join(owned, "customer_id", "left").join(activity, "customer_id", "left").select(
        "customer_id", "full_name", "risk_tier", "credit_score", "segment",
        F.coalesce("policy_count", F.lit(0)).alias("policy_count"),
        F.coalesce("claim_count", F.lit(0)).alias("claim_count"),
        rounded(F.coalesce("p", F.lit(0)), 2).alias("total_premium"),
        rounded(F.coalesce("o", F.lit(0)), 2).alias("total_outstanding"),
    )
    return out if k is None else out.orderBy(F.desc("total_outstanding"), "customer_id").limit(k)


def churn_features(policies: DataFrame, invoices: DataFrame, claims: DataFrame, as_of: str,
                   statuses: Sequence[str] = ("Active",)) -> DataFrame:
    """Missed payments, claims, churn probability and revenue at risk of each live policy."""
    missed = invoices.filter(status_is("payment_status", "Overdue", "Partial")).groupBy("policy_id").agg(
        F.count(F.lit(1)).alias("m"))
    filed = claims.groupBy("policy_id").agg(F.count(F.lit(1)).alias("c"))
    live = policies.filter(F.col("status").isin(*statuses))
    joined = live.join(missed, "policy_id", "left").join(filed, "policy_id", "left") \
        .withColumn("missed_payments", F.coalesce("m", F.lit(0))).withColumn("claims_filed", F.coalesce("c", F.lit(0)))
    score = F.lit(CHURN_BASE) + F.col("missed_payments") * CHURN_PER_MISSED + F.col("claims_filed") * CHURN_PER_CLAIM
    return joined.select(
        "policy_id", "customer_id", "policy_type", "missed_payments", "claims_filed",
        rounded(F.least(F.lit(CHURN_MAX), score), 4).alias("churn_probability"),
        (F.col("premium") * 12).cast("decimal(18,2)").alias("revenue_at_risk"),
        days_until("expiration_date", as_of).alias("days_until_renewal"),
        risk_category(F.col("missed_payments"), F.col("claims_filed")).alias("risk_category"),
    )


def risk_category(missed: Column, filed: Column) -> Column:
    """Ours: payment trouble first, then claims-driven churn, otherwise cover too thin."""
    return F.when(missed >= 2, "Payment Default").when(filed + missed >= 3, "Churn").otherwise("Underinsured")


def most_exposed(features: DataFrame, k: int | None = None) -> DataFrame:
    """All policies, or with k the k that have most missed payments plus claims."""
    if k is None:
        return features
    return features.orderBy(
        F.desc(F.col("missed_payments") + F.col("claims_filed")), F.desc("missed_payments"), "policy_id").limit(k)


def risk_summary(at_risk: DataFrame, by: Sequence[str]) -> DataFrame:
    return at_risk.groupBy(*by).agg(
        F.count(F.lit(1)).alias("at_risk"),
        rounded(F.sum("revenue_at_risk"), 2).alias("total_revenue_at_risk"),
        mean(F.col("churn_probability").cast("decimal(9,4)"), 4).alias("avg_churn"),
        mean("missed_payments", 1).alias("avg_missed"),
    )


def top_at_risk(at_risk: DataFrame, k: int = 10) -> DataFrame:
    weight = F.col("churn_probability").cast("decimal(9,4)") * F.col("revenue_at_risk")
    return at_risk.orderBy(F.desc(weight), "policy_id").limit(k)


def retention_action(probability: Column, category: Column) -> Column:
    """Ours, in place of model-written advice: an action by category and urgency."""
    return (
        F.when((category == "Payment Default") & (probability > 0.7), "Payment plan and agent call")
        .when(category == "Payment Default", "Payment reminder")
        .when(probability > 0.7, "Agent call with discount offer")
        .when(category == "Underinsured", "Coverage review")
        .otherwise("Auto-renew lock")
    )


def retention_candidates(at_risk: DataFrame, customers: DataFrame, k: int = 30, above: float = 0.5) -> DataFrame:
    best = at_risk.filter(F.col("churn_probability") > above).orderBy(F.desc("revenue_at_risk"), "policy_id").limit(k)
    return best.join(customers.select("customer_id", "state_id", "segment", "risk_tier", "credit_score"), "customer_id").select(
        "policy_id", "customer_id", "state_id", "risk_category", "churn_probability",
        F.col("revenue_at_risk").cast("double").alias("revenue_at_risk"), "credit_score", "risk_tier", "segment", "missed_payments",
        retention_action(F.col("churn_probability"), F.col("risk_category")).alias("action"))


def tier_drift(history: DataFrame, attribute: str = "RISK_TIER", k: int = 10) -> DataFrame:
    return (
        history.filter(F.col("attribute_name") == attribute).groupBy("old_value", "new_value")
        .agg(F.count(F.lit(1)).alias("changes"), F.min("change_date").alias("earliest"), F.max("change_date").alias("latest"))
        .orderBy(F.desc("changes"), "old_value", "new_value").limit(k)
    )


def changes_after_claim(history: DataFrame, policies: DataFrame, claims: DataFrame, days: int = 90) -> DataFrame:
    """Attribute changes with a flag: did a claim of the customer fall in the ``days`` before?

    Time is cut in slots of ``days`` days. A claim within reach of a change lies in the
    change's slot, on or before it, or in the slot before, so each customer and slot needs
    only its earliest and latest claim date: no claim is ever paired with a change.
    """
    def slot(c):
        return F.floor(F.unix_date(c) / days).cast("long")
    dated = claims.groupBy("policy_id", slot("claim_date").alias("slot")).agg(
        F.min("claim_date").alias("lo"), F.max("claim_date").alias("hi"))
    edges = dated.join(policies.select("policy_id", "customer_id"), "policy_id").groupBy("customer_id", "slot").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = edges.select("customer_id", "slot", F.col("lo").alias("first_here"))
    before = edges.select("customer_id", (F.col("slot") + 1).alias("slot"), F.col("hi").alias("last_before"))
    reach = own.join(before, ["customer_id", "slot"], "full")
    hit = (F.col("first_here") <= F.col("change_date")) | (F.date_add("last_before", days) >= F.col("change_date"))
    return (
        history.withColumn("slot", slot("change_date")).join(reach, ["customer_id", "slot"], "left")
        .withColumn("after_claim", F.coalesce(hit, F.lit(False)))
        .drop("slot", "first_here", "last_before")
    )


def tier_drift_after_claim(history: DataFrame, policies: DataFrame, claims: DataFrame, days: int = 90) -> DataFrame:
    flagged = changes_after_claim(history.filter(F.col("attribute_name") == "RISK_TIER"), policies, claims, days)
    return flagged.groupBy("old_value", "new_value").agg(
        F.count(F.lit(1)).alias("changes"), F.count_if("after_claim").alias("after_claim"),
        percent(F.count_if("after_claim"), F.count(F.lit(1)), 2).alias("after_claim_pct"))


def customer_lifetime_value(policies: DataFrame, multiplier: float = 3.5) -> DataFrame:
    return policies.groupBy("customer_id").agg(F.sum("premium").alias("p")).select(
        "customer_id", rounded(F.col("p").cast("double") * multiplier, 2).alias("lifetime_value"))


def household_rollup(customers: DataFrame, policies: DataFrame) -> DataFrame:
    spend = policies.groupBy("customer_id").agg(F.sum("premium").alias("p"), F.count(F.lit(1)).alias("n"))
    return customers.select("customer_id", "household_id").join(spend, "customer_id", "left").groupBy("household_id").agg(
        F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("policies"),
        rounded(F.coalesce(F.sum("p"), F.lit(0)), 2).alias("premium"))


def nps_category(rating: Column | str) -> Column:
    r = F.col(rating) if isinstance(rating, str) else rating
    return F.when(r >= 9, "Promoter").when(r >= 7, "Passive").when(r >= 0, "Detractor")


def nps(surveys: DataFrame, by: Sequence[str] = (), survey_type: str | None = None) -> DataFrame:
    """Net promoter score in points, counts and mean satisfaction."""
    if survey_type is not None:
        surveys = surveys.filter(F.col("survey_type") == survey_type)
    c = nps_category("nps_rating")
    up, down = F.count_if(c == "Promoter"), F.count_if(c == "Detractor")
    return surveys.groupBy(*by).agg(
        F.count(F.lit(1)).alias("surveys"), up.alias("promoters"), F.count_if(c == "Passive").alias("passives"),
        down.alias("detractors"), percent(up - down, F.count(F.lit(1)), 1).alias("nps"),
        mean("satisfaction", 1).alias("avg_satisfaction"), mean("nps_rating", 1).alias("avg_rating"))


def renewal_calendar(policies: DataFrame, as_of: str) -> DataFrame:
    return policies.select("policy_id", "expiration_date", days_until("expiration_date", as_of).alias("days_until_renewal"))
