"""Ledger, reinsurance, reserves, applications, endorsements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.functions.numbers import percent, ratio, rounded

DEFAULT_CESSION = 0.5


def ledger_rollup(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("fiscal_quarter", "account_type", "line").agg(rounded(F.sum("amount"), 2).alias("amount"))


def ledger_pivot(ledger: DataFrame, accounts: Sequence[str]) -> DataFrame:
    """Quarter by account; listing the accounts spares a pass to find them."""
    wide = ledger.groupBy("fiscal_quarter").pivot("account_type", list(accounts)).agg(rounded(F.sum("amount"), 2))
    return wide.fillna(0.0, subset=list(accounts))


def reinsurance_recovery(losses: DataFrame, treaties: DataFrame, by: Sequence[str] = ("treaty_id", "status")) -> DataFrame:
    """Ceded and recovered amounts; a treaty without a rate cedes half of the loss."""
    per_treaty = losses.groupBy("treaty_id", "status").agg(F.sum("gross_loss").alias("g"), F.sum("recovered").alias("r"))
    joined = per_treaty.join(treaties, "treaty_id", "left")
    rate = F.coalesce(F.col("cession_rate").cast("double"), F.lit(DEFAULT_CESSION))
    ceded = F.col("g").cast("double") * rate
    return joined.groupBy(*by).agg(
        rounded(F.sum("g"), 2).alias("gross_loss"), rounded(F.sum(rounded(ceded, 2)), 2).alias("ceded"),
        percent(F.sum("r"), F.sum(rounded(ceded, 2)), 1).alias("recovery_pct"))


def reserve_vs_guideline(claims: DataFrame, guidelines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Reserve held over incurred against a statutory minimum per key."""
    held = claims.groupBy(*by).agg(F.sum("reserve").alias("r"), F.sum("amount").alias("a"))
    out = held.join(guidelines, list(by), "left").select(
        *by, ratio("r", "a", 4).alias("reserve_ratio"), F.col("minimum_ratio"))
    return out.withColumn("adequate", F.col("reserve_ratio") >= F.col("minimum_ratio"))


def quote_to_bind(applications: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    bound = F.count_if(F.col("status") == "Bound")
    return applications.groupBy(*by).agg(
        F.count(F.lit(1)).alias("applications"), bound.alias("bound"), percent(bound, F.count(F.lit(1)), 1).alias("bind_pct"))


def decline_rate(applications: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    declined = F.count_if(F.col("status") == "Declined")
    return applications.groupBy(*by).agg(
        F.count(F.lit(1)).alias("applications"), declined.alias("declined"),
        percent(declined, F.count(F.lit(1)), 1).alias("decline_pct"))


def decline_reasons(applications: DataFrame) -> DataFrame:
    return applications.filter(F.col("decline_reason").isNotNull()).groupBy("decline_reason").agg(
        F.count(F.lit(1)).alias("applications"))


def endorsement_churn(changes: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of tier changes that are downgrades, tiers ranked by ``order`` from low to high."""
    ranks = F.array(*[F.lit(t) for t in order])

    def rank(c: str) -> Column:
        return F.nullif(F.array_position(ranks, F.col(c)), F.lit(0))
    down = F.count_if(rank("new_value") < rank("old_value"))
    return changes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("changes"), down.alias("downgrades"), percent(down, F.count(F.lit(1)), 2).alias("downgrade_pct"))
