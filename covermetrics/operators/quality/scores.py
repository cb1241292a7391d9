"""Scores from rule results: per dimension, overall, trend, freshness, trust."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermetrics.functions.dates import hours_between_boundaries
from covermetrics.functions.numbers import mean, percent, rounded
from covermetrics.operators.relational import latest_per_key

# Ours: the reports name a weighted overall score without giving the weights.
DIMENSION_WEIGHTS = {"Completeness": 25, "Uniqueness": 20, "Validity": 25, "Timeliness": 10, "Consistency": 20}
TREND_STEP = 0.05
UNKNOWN_TRUST = 90.0


def table_scores(results: DataFrame) -> DataFrame:
    """Mean pass rate per dimension, weighted overall over the dimensions present, trend."""
    dims = {d: mean(F.when(F.col("rule_type") == d, F.col("pass_rate").cast("decimal(9,2)")), 2) for d in DIMENSION_WEIGHTS}
    scores = results.groupBy("target_table", "run_date").agg(
        *[c.alias(d.lower()) for d, c in dims.items()],
        F.max("total_records").alias("records_assessed"), F.count(F.lit(1)).alias("rules_evaluated"))
    top = sum((F.coalesce(F.col(d.lower()), F.lit(0.0)) * w for d, w in DIMENSION_WEIGHTS.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(d.lower()).isNotNull(), w).otherwise(0) for d, w in DIMENSION_WEIGHTS.items()), F.lit(0))
    scored = scores.withColumn("overall", rounded(top / bottom, 2))
    before = F.lag("overall").over(Window.partitionBy("target_table").orderBy("run_date"))
    step = F.col("overall").cast("decimal(9,2)") - before.cast("decimal(9,2)")
    return scored.withColumn("trend", F.when(step > TREND_STEP, "Improving").when(step < -TREND_STEP, "Declining").otherwise("Stable"))


def latest_scores(scores: DataFrame) -> DataFrame:
    return latest_per_key(scores, ["target_table"], ["run_date"])


def mean_latest_score(scores: DataFrame) -> DataFrame:
    return latest_scores(scores).agg(mean(F.col("overall").cast("decimal(9,2)"), 1).alias("mean_score"),
                                     F.count(F.lit(1)).alias("tables"))


def hours_since_refresh(scores: DataFrame, as_of: str) -> DataFrame:
    return latest_scores(scores).agg(F.min(hours_between_boundaries(
        F.col("run_date").cast("timestamp"), F.lit(as_of).cast("timestamp"))).alias("hours_since_refresh"))


def trust_score(wanted: DataFrame, scores: DataFrame, result_rows: Column) -> DataFrame:
    """Mean latest score of the tables a question used, and confidence from its row count."""
    joined = wanted.join(latest_scores(scores).select("target_table", "overall"), "target_table", "left")
    known = F.coalesce("overall", F.lit(UNKNOWN_TRUST)).cast("decimal(9,2)")
    return joined.agg(mean(known, 1).alias("trust_score"), F.count("overall").alias("tables_known")).withColumn(
        "confidence", F.when(result_rows >= 5, 96).when(result_rows > 0, 93).otherwise(78))


def most_failing_rules(results: DataFrame, k: int = 10) -> DataFrame:
    return results.filter(F.col("status") == "Fail").groupBy("rule_name", "target_table", "severity").agg(
        F.count(F.lit(1)).alias("fail_count")).orderBy(F.desc("fail_count"), "rule_name").limit(k)


def pass_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    passed = F.count_if(F.col("status") == "Pass")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checks"), passed.alias("passed"), percent(passed, F.count(F.lit(1)), 1).alias("pass_pct"),
        F.sum("failed_records").alias("failed_records"))


def rule_inventory(rules: DataFrame, by: str) -> DataFrame:
    return rules.groupBy(by).agg(F.count(F.lit(1)).alias("rules"), F.count_if("is_active").alias("active"))


def anomaly_score(status: Column | str) -> Column:
    """Ours: midpoint of the score band that belongs to an outcome."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == "Fail", 0.85).when(s == "Warning", 0.5).when(s == "Pass", 0.1)
