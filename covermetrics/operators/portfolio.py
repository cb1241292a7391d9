"""Premium, loss and combined ratios.

Claims are always reduced to one row per policy before they meet policies, so that a
policy's premium is counted once. ``fanout=True`` keeps the form in which it is counted
once per claim, for comparison with reports written that way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermetrics.functions.dates import month_index, month_of
from covermetrics.functions.numbers import mean, percent, ratio, rounded

EARN_RATE = 0.92
RATIO_BANDS = ((100.0, "Critical (>100%)"), (70.0, "Elevated (70-100%)"))


def claims_per_policy(claims: DataFrame, since: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    if since is not None:
        claims = claims.filter(F.col("claim_date") >= F.lit(since).cast("date"))
    return claims.groupBy("policy_id", *extra).agg(
        F.count(F.lit(1)).alias("claims"),
        F.sum("amount").alias("incurred"),
        F.sum("paid").alias("paid"),
    )


def with_claims(policies: DataFrame, claims: DataFrame, since: str | None = None, fanout: bool = False) -> DataFrame:
    if fanout:
        if since is not None:
            claims = claims.filter(F.col("claim_date") >= F.lit(since).cast("date"))
        right = claims.select("policy_id", F.lit(1).alias("claims"), F.col("amount").alias("incurred"), "paid")
    else:
        right = claims_per_policy(claims, since)
    return policies.join(right, "policy_id", "left")


def portfolio_kpis(policies: DataFrame, claims: DataFrame, as_of: str, since: str | None = None,
                   fanout: bool = False) -> DataFrame:
    book = with_claims(policies.filter(F.col("effective_date") <= F.lit(as_of).cast("date")), claims, since, fanout)
    n = F.countDistinct("policy_id") if fanout else F.count(F.lit(1))
    sums = book.agg(n.alias("policies"), F.sum("premium").alias("p"), F.sum("incurred").alias("i"))
    earned = F.col("p").cast("double") * F.lit(EARN_RATE)
    return sums.select(
        "policies",
        rounded("p", 0).alias("written_premium"),
        rounded(earned, 0).alias("earned_premium"),
        rounded("i", 0).alias("incurred_claims"),
        percent("i", earned).alias("loss_ratio"),
    )


def combined_ratio(policies: DataFrame, claims: DataFrame, by: Sequence[str] = (), fanout: bool = False) -> DataFrame:
    """Loss, expense and combined ratio in percent of premium, from unrounded parts."""
    sums = with_claims(policies, claims, fanout=fanout).groupBy(*by).agg(
        F.sum("premium").alias("p"), F.sum("paid").alias("l"), F.sum("expense").alias("e"))
    loss = F.coalesce(F.col("l"), F.lit(0)).cast("double")
    return sums.select(
        *by,
        rounded("p", 2).alias("premium"),
        percent(loss, "p").alias("loss_ratio"),
        percent("e", "p").alias("expense_ratio"),
        percent(loss + F.col("e").cast("double"), "p").alias("combined_ratio"),
    )


def ratio_status(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    (critical, critical_label), (elevated, elevated_label) = RATIO_BANDS
    return (
        F.when(c > critical, critical_label).when(c > elevated, elevated_label)
        .when(c.isNotNull(), "Healthy (<70%)")
    )


def loss_ratio_by(policies: DataFrame, claims: DataFrame, by: Sequence[str], since: str | None = None,
                  fanout: bool = False) -> DataFrame:
    sums = with_claims(policies, claims, since, fanout).groupBy(*by).agg(
        F.sum("premium").alias("p"), F.sum("incurred").alias("i"), F.sum("claims").alias("n"))
    out = sums.select(*by, F.coalesce("n", F.lit(0)).alias("claims"), percent("i", "p").alias("loss_ratio"))
    return out.withColumn("status", ratio_status("loss_ratio"))


def premium_vs_claims_trend(policies: DataFrame, claims: DataFrame, since: str) -> DataFrame:
    """Monthly written premium beside the claims that fell in the policy's own first month."""
    policies = policies.filter(F.col("effective_date") >= F.lit(since).cast("date")) \
        .select("policy_id", "premium", month_of("effective_date").alias("month"))
    monthly = claims.filter(F.col("claim_date") >= F.trunc(F.lit(since).cast("date"), "month")) \
        .groupBy("policy_id", month_of("claim_date").alias("month")).agg(F.sum("amount").alias("i"))
    return (
        policies.join(monthly, ["policy_id", "month"], "left").groupBy("month")
        .agg(rounded(F.sum("premium"), 0).alias("written_premium"), rounded(F.sum("i"), 0).alias("incurred_claims"))
    )


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def share_of_total(grouped: DataFrame, value: str, name: str = "share_pct", digits: int = 1) -> DataFrame:
    total = grouped.agg(F.sum(value).cast("double")).scalar()
    return grouped.withColumn(name, percent(F.col(value), total, digits))


def portfolio_mix(policies: DataFrame, statuses: Sequence[str], by: str = "policy_type") -> DataFrame:
    grouped = policies.filter(F.col("status").isin(*statuses)).groupBy(by).agg(F.sum("premium").alias("p"))
    return share_of_total(grouped, "p").select(by, rounded("p", 0).alias("premium"), "share_pct")


def distribution(df: DataFrame, by: str, means: dict[str, tuple[str, int]]) -> DataFrame:
    """Rows and averages per category; ``means`` maps output name to (column, digits)."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), *[mean(c, d).alias(out) for out, (c, d) in means.items()])


def monthly_claim_series(policies: DataFrame, claims: DataFrame, by: str = "policy_type") -> DataFrame:
    """Count, incurred and mean fraud score per series and month."""
    per_policy = claims.groupBy("policy_id", month_of("claim_date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("a"),
        F.sum("fraud_score").alias("f"), F.count("fraud_score").alias("fn"))
    return (
        per_policy.join(policies.select("policy_id", by), "policy_id")
        .groupBy(F.col(by).alias("series"), "month")
        .agg(F.sum("n").alias("claim_count"), rounded(F.sum("a"), 2).alias("total_incurred"),
             ratio(F.sum("f"), F.sum("fn"), 2).alias("avg_fraud_score"))
    )


def monthly_loss_ratio(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Loss ratio per claim month: each policy with a claim in the month counts its premium once."""
    per_policy = claims.groupBy("policy_id", month_of("claim_date").alias("month")).agg(F.sum("amount").alias("i"))
    return (
        per_policy.join(policies.select("policy_id", "premium"), "policy_id").groupBy("month")
        .agg(percent(F.sum("i"), F.sum("premium"), 2).alias("loss_ratio"))
    )


def split_last_months(series: DataFrame, months: int = 3, month: str = "month") -> DataFrame:
    last = series.agg(F.max(month)).scalar()
    held_out = F.col(month) >= F.add_months(last, -months)
    return series.withColumn("part", F.when(held_out, "test").otherwise("train"))


def change_over_periods(series: DataFrame, value: str, month: str = "month", keys: Sequence[str] = ()) -> DataFrame:
    """Month-on-month and year-on-year change of an aggregated monthly series."""
    index = month_index(month)
    timeline = Window.partitionBy(*keys).orderBy(index)
    year_back = Window.partitionBy(*keys).orderBy(index).rangeBetween(-12, -12)
    prev = F.lag(value).over(timeline)
    year_ago = F.max(value).over(year_back)
    return series.select(
        *keys, month, value,
        percent(F.col(value) - prev, prev, 2).alias("mom_pct"),
        percent(F.col(value) - year_ago, year_ago, 2).alias("yoy_pct"),
    )


def underwriting_profit(policies: DataFrame, claims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sums = with_claims(policies, claims).groupBy(*by).agg(
        F.sum("premium").alias("p"), F.sum("incurred").alias("i"), F.sum("expense").alias("e"))
    earned = F.col("p").cast("double") * F.lit(EARN_RATE)
    losses = F.coalesce(F.col("i"), F.lit(0)).cast("double") + F.col("e").cast("double")
    return sums.select(*by, rounded(earned - losses, 0).alias("underwriting_profit"))


def binding_velocity(policies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return policies.groupBy(*by).agg(
        F.count(F.lit(1)).alias("policies"),
        mean(F.datediff("effective_date", "bound_date"), 2).alias("mean_days_to_effective"))


def churn_rate(policies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cancelled or non-renewed policies over active ones, in percent."""
    lost = F.count_if(F.col("status").isin("Cancelled", "Non-Renewed"))
    active = F.count_if(F.col("status") == "Active")
    return policies.groupBy(*by).agg(lost.alias("lost"), active.alias("active"), percent(lost, active, 2).alias("churn_pct"))
