"""Claims intelligence: bands, frictions, triage, adjusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.functions.dates import hours_between_boundaries, month_of
from covermetrics.functions.numbers import band, hash_bucket, mean, percent, ratio, rounded
from covermetrics.operators.relational import top_k_per_group

# Band edges and labels of the standard reports.
FRAUD_EDGES = ((20, "0-20 (Low)"), (40, "20-40 (Normal)"), (60, "40-60 (Elevated)"), (80, "60-80 (High)"))
FRAUD_LAST = "80-100 (Critical)"
COARSE_FRAUD_EDGES = ((20, "1. Low"), (50, "2. Medium"), (80, "3. High"))
COARSE_FRAUD_LAST = "4. Critical"
RESOLUTION_EDGES = ((30, "0-30 days"), (90, "31-90 days"), (180, "91-180 days"))
RESOLUTION_LAST = "180+ days"
CREDIT_EDGES = ((580, "1. Poor"), (670, "2. Fair"), (740, "3. Good"), (800, "4. Very Good"))
CREDIT_LAST = "5. Excellent"


def fraud_band(c: Column | str, as_written: bool = False) -> Column:
    return band(c, FRAUD_EDGES, FRAUD_LAST, None if as_written else "unknown")


def coarse_fraud_band(c: Column | str) -> Column:
    return band(c, COARSE_FRAUD_EDGES, COARSE_FRAUD_LAST)


def resolution_band(c: Column | str, as_written: bool = False) -> Column:
    return band(c, RESOLUTION_EDGES, RESOLUTION_LAST, None if as_written else "open", inclusive=True)


def credit_band(c: Column | str) -> Column:
    return band(c, CREDIT_EDGES, CREDIT_LAST)


def claims_summary(claims: DataFrame) -> DataFrame:
    return claims.agg(
        F.count(F.lit(1)).alias("total_claims"),
        rounded(F.sum("amount"), 0).alias("total_claimed"),
        mean("fraud_score", 1).alias("avg_fraud"),
        mean("resolution_days", 1).alias("avg_resolution"),
        mean("amount", 2).alias("avg_claim"),
    )


def friction_reasons(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("friction_reason").isNotNull()).groupBy("friction_reason").agg(
        F.count(F.lit(1)).alias("claims"),
        mean("amount", 0).alias("avg_claim"),
        mean("resolution_days", 1).alias("avg_resolution"),
    )


def claims_by_region_month(claims: DataFrame, agents: DataFrame, states: DataFrame, regions: DataFrame,
                           since: str) -> DataFrame:
    """Claims of each agent region and month; claims are reduced per agent and month first."""
    per_agent = claims.filter(F.col("claim_date") >= F.lit(since).cast("date")).groupBy(
        F.col("adjuster_id").alias("agent_id"), month_of("claim_date").alias("month")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("a"),
          F.sum("fraud_score").alias("f"), F.count("fraud_score").alias("fn"))
    places = agents.select("agent_id", "state_id").join(states, "state_id").join(regions, "region_id")
    return (
        per_agent.join(places.select("agent_id", "region"), "agent_id").groupBy("region", "month")
        .agg(F.sum("n").alias("claim_count"), rounded(F.sum("a"), 2).alias("total_claimed"),
             ratio(F.sum("f"), F.sum("fn"), 2).alias("avg_fraud_score"))
    )


def catastrophe_claims(claims: DataFrame, cause: str) -> DataFrame:
    return claims.filter(F.col("cause") == cause).groupBy("cause").agg(
        F.count(F.lit(1)).alias("claims"), mean("amount", 2).alias("avg_amount"))


def similar_claims(claims: DataFrame, agents: DataFrame, cause: str, k: int = 10) -> DataFrame:
    """The latest k claims of a kind with their adjusters."""
    latest = claims.filter(F.col("cause") == cause).orderBy(
        F.desc("claim_date"), "claim_id", "amount", "adjuster_id").limit(k)
    return latest.join(agents.select(F.col("agent_id").alias("adjuster_id"), F.col("agent_name").alias("adjuster")),
                       "adjuster_id", "left")


def recommend_adjuster(agents: DataFrame, claims: DataFrame, k: int = 5,
                       open_statuses: Sequence[str] = ("Open", "UnderInvestigation")) -> DataFrame:
    workload = open_claims_per_adjuster(claims, open_statuses)
    ranked = agents.filter(F.col("status") == "Active").join(
        workload.withColumnRenamed("adjuster_id", "agent_id"), "agent_id", "left")
    return ranked.select("agent_id", "agent_name", "specialization",
                         F.col("performance_rating").cast("double").alias("performance_rating"),
                         F.coalesce("open_claims", F.lit(0)).alias("open_claims")) \
        .orderBy("open_claims", F.desc("performance_rating"), "agent_id").limit(k)


def open_claims_per_adjuster(claims: DataFrame, open_statuses: Sequence[str] = ("Open", "UnderInvestigation")) -> DataFrame:
    return claims.filter(F.col("status").isin(*open_statuses)).groupBy("adjuster_id").agg(
        F.count(F.lit(1)).alias("open_claims"))


def adjuster_workload(claims: DataFrame, as_of: str) -> DataFrame:
    """Open claims per adjuster and hours since the adjuster's last activity."""
    return claims.groupBy("adjuster_id").agg(
        F.count_if(F.col("status") == "Open").alias("open_claims"),
        F.max("claim_date").alias("last_activity"),
    ).withColumn("hours_idle", hours_between_boundaries(
        F.col("last_activity").cast("timestamp"), F.lit(as_of).cast("timestamp")))


def escalated(claims: DataFrame) -> DataFrame:
    """Escalate litigated, suspicious or large claims, and a stable 8 % of the rest."""
    flag = (
        F.col("litigation") | (F.col("fraud_score") > 75) | (F.col("amount") > 100000)
        | (hash_bucket("claim_id", 100, "esc") < 8)
    )
    return claims.withColumn("escalated", flag)


def escalation_rate(claims: DataFrame, by: Sequence[str]) -> DataFrame:
    e = F.count_if("escalated")
    return escalated(claims).groupBy(*by).agg(
        F.count(F.lit(1)).alias("claims"), e.alias("escalated"), percent(e, F.count(F.lit(1)), 2).alias("escalated_pct"))


def claim_rates(policies: DataFrame, claims: DataFrame, fraud_threshold: float = 80.0) -> DataFrame:
    """Frequency per active policy, severity of settled claims, share of flagged claims."""
    active = policies.agg(F.count_if(F.col("status") == "Active")).scalar()
    settled = F.col("status") == "Closed"
    return claims.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(settled, F.col("paid"))).alias("paid"), F.count_if(settled).alias("settled"),
        F.count_if(F.col("fraud_score") > fraud_threshold).alias("flagged"),
    ).select(
        percent("n", active, 2).alias("claims_frequency"),
        ratio("paid", "settled", 2).alias("average_severity"),
        percent("flagged", "n", 2).alias("fraud_detection_rate"),
    )


def loss_by_product(claims: DataFrame, products: DataFrame, by: Sequence[str]) -> DataFrame:
    """Claims and severity by make and model, reduced per part before the join."""
    per_part = claims.groupBy("part_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("a"),
                                             F.max("amount").alias("m"))
    return per_part.join(products.select("part_id", *by), "part_id").groupBy(*by).agg(
        F.sum("n").alias("claims"), rounded(F.sum("a"), 2).alias("total_loss"),
        ratio(F.sum("a"), F.sum("n"), 2).alias("severity"), F.max("m").cast("double").alias("largest"))


def friction_by_region(claims: DataFrame, agents: DataFrame, states: DataFrame, regions: DataFrame, k: int = 3) -> DataFrame:
    per_agent = claims.filter(F.col("friction_reason").isNotNull()).groupBy(
        F.col("adjuster_id").alias("agent_id"), "friction_reason").agg(F.count(F.lit(1)).alias("n"))
    places = agents.select("agent_id", "state_id").join(states, "state_id").join(regions, "region_id")
    counts = per_agent.join(places.select("agent_id", "region"), "agent_id") \
        .groupBy("region", "friction_reason").agg(F.sum("n").alias("claims"))
    return top_k_per_group(counts, ["region"], [F.desc("claims"), F.col("friction_reason")], k)
