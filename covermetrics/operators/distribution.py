"""Agents: scorecards, commissions, local ranking, onboarding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermetrics.functions.numbers import mean, percent, rounded


def agent_policies(claims: DataFrame) -> DataFrame:
    """Which policies an agent serves, with the agent's claims on each."""
    return claims.groupBy(F.col("adjuster_id").alias("agent_id"), "policy_id").agg(
        F.count(F.lit(1)).alias("claims"), F.sum("amount").alias("incurred"))


def agent_scorecard(agents: DataFrame, served: DataFrame, at_risk: DataFrame, k: int | None = 20) -> DataFrame:
    """Policies, claims, at-risk policies and revenue per agent, without multiplying rows."""
    risk = at_risk.select("policy_id", F.lit(1).alias("r"), F.col("revenue_at_risk").alias("v"))
    per_agent = served.join(risk, "policy_id", "left").groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("policies"), F.sum("claims").alias("claims"), F.count("r").alias("at_risk"), F.sum("v").alias("v"))
    out = agents.join(per_agent, "agent_id", "left").select(
        "agent_id", "agent_name", "specialization", F.col("performance_rating").cast("double").alias("performance_rating"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("policies", "claims", "at_risk")],
        rounded("v", 2).alias("revenue_at_risk"))
    return out if k is None else out.orderBy(F.desc_nulls_last("revenue_at_risk"), "agent_id").limit(k)


def agent_loss_ratio(served: DataFrame, policies: DataFrame) -> DataFrame:
    return served.join(policies.select("policy_id", "premium"), "policy_id").groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("policies"), percent(F.sum("incurred"), F.sum("premium"), 1).alias("loss_ratio"))


def commission_payout(served: DataFrame, policies: DataFrame, agents: DataFrame) -> DataFrame:
    book = served.join(policies.select("policy_id", "premium"), "policy_id").groupBy("agent_id").agg(F.sum("premium").alias("p"))
    return book.join(agents.select("agent_id", "commission_rate"), "agent_id").select(
        "agent_id", rounded(F.col("p").cast("double") * F.col("commission_rate").cast("double"), 2).alias("commission"))


def agents_in_state(agents: DataFrame, served: DataFrame, state_id: int, k: int = 10) -> DataFrame:
    volume = served.groupBy("agent_id").agg(F.count(F.lit(1)).alias("policies"))
    local = agents.filter((F.col("state_id") == state_id) & (F.col("status") == "Active"))
    return local.join(volume, "agent_id", "left").select(
        "agent_id", "agent_name", "specialization", F.coalesce("policies", F.lit(0)).alias("policies")) \
        .orderBy(F.desc("policies"), "agent_id").limit(k)


def low_rated_busy_agents(agents: DataFrame, served: DataFrame, rating_below: float = 2.0, volume_above: int = 75) -> DataFrame:
    volume = served.groupBy("agent_id").agg(F.count(F.lit(1)).alias("policies"))
    return agents.filter(F.col("performance_rating") < rating_below).join(volume, "agent_id") \
        .filter(F.col("policies") > volume_above) \
        .select("agent_id", "agent_name", F.col("performance_rating").cast("double").alias("performance_rating"), "policies")


def coverage_profile(policies: DataFrame, customers: DataFrame, state_id: int) -> DataFrame:
    local = customers.filter(F.col("state_id") == state_id).select("customer_id")
    return policies.join(local, "customer_id", "left_semi").groupBy("policy_type").agg(
        F.count(F.lit(1)).alias("policies"), mean("premium", 0).alias("avg_premium"),
        mean("coverage", 0).alias("avg_coverage"), mean("deductible", 0).alias("avg_deductible"))


def onboarding_velocity(agents: DataFrame, by: str) -> DataFrame:
    return agents.groupBy(by).agg(
        F.count(F.lit(1)).alias("agents"), mean(F.datediff("hire_date", "application_date"), 2).alias("mean_days"))
