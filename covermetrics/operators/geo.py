"""Geographic risk: portfolio, weather, disasters and floods by state.

Facts that carry a customer are first counted per customer and only then placed in a
state, so the join sees one row per customer whatever the volume of the feed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.functions.dates import month_of
from covermetrics.functions.numbers import percent, ratio, rounded
from covermetrics.operators.portfolio import claims_per_policy
from covermetrics.operators.relational import cover_days

SEVERE = ("Severe", "Extreme")
# Ours: pricing status by loss ratio of the segment.
PRICING_BANDS = ((90.0, "UNDERPRICED"), (75.0, "MARGINAL"), (50.0, "ADEQUATE"))


def by_state(df: DataFrame, customers: DataFrame, aggs: dict[str, tuple[str, Column]], extra: Sequence[str] = ()) -> DataFrame:
    """Aggregate per customer, then per state. ``aggs``: name to (merge function, first-step aggregate)."""
    first = df.groupBy("customer_id", *extra).agg(*[c.alias(n) for n, (_, c) in aggs.items()])
    merge = {"sum": F.sum, "max": F.max, "min": F.min}
    return first.join(customers.select("customer_id", "state_id"), "customer_id").groupBy("state_id", *extra).agg(
        *[merge[m](n).alias(n) for n, (m, _) in aggs.items()])


def portfolio_by_state(customers: DataFrame, policies: DataFrame, claims: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    book = policies.join(claims_per_policy(claims), "policy_id", "left")
    return by_state(book, customers, {
        "policies": ("sum", F.count(F.lit(1))), "claims": ("sum", F.sum("claims")),
        "premium": ("sum", F.sum("premium")), "incurred": ("sum", F.sum("incurred"))}, extra)


def severe_alerts_by_state(alerts: DataFrame, customers: DataFrame, since: str) -> DataFrame:
    severe = alerts.filter(F.col("severity").isin(*SEVERE) & (F.col("reported_at") >= F.lit(since).cast("timestamp_ntz")))
    return by_state(severe, customers, {"severe_alerts": ("sum", F.count(F.lit(1)))})


def disasters_by_state(disasters: DataFrame, customers: DataFrame, since: str) -> DataFrame:
    recent = disasters.filter(F.col("designated_date") >= F.lit(since).cast("date"))
    return by_state(recent, customers, {"disasters": ("sum", F.count(F.lit(1))), "last_disaster": ("max", F.max("designated_date"))})


def floods_by_state(floods: DataFrame, customers: DataFrame, since: str) -> DataFrame:
    recent = floods.filter(F.col("loss_date") >= F.lit(since).cast("date"))
    return by_state(recent, customers, {"flood_claims": ("sum", F.count(F.lit(1))), "_damage": ("sum", F.sum("building_damage"))})


def risk_level(loss_ratio: Column, alerts: Column, disasters: Column, many: int, very_many: int, disasters_over: int) -> Column:
    return (
        F.when((loss_ratio > 70) & (alerts > many), "CRITICAL").when((loss_ratio > 50) | (alerts > very_many), "HIGH")
        .when((alerts > many) | (disasters > disasters_over), "ELEVATED").otherwise("NORMAL")
    )


def geo_risk_scorecard(customers: DataFrame, policies: DataFrame, claims: DataFrame, alerts: DataFrame, disasters: DataFrame,
                       floods: DataFrame, states: DataFrame, alerts_since: str, disasters_since: str,
                       many_alerts: int = 1000, very_many_alerts: int = 5000, many_disasters: int = 10) -> DataFrame:
    own = portfolio_by_state(customers, policies, claims)
    joined = (
        own.join(severe_alerts_by_state(alerts, customers, alerts_since), "state_id", "left")
        .join(disasters_by_state(disasters, customers, disasters_since), "state_id", "left")
        .join(floods_by_state(floods, customers, disasters_since), "state_id", "left")
        .join(states.select("state_id", "state"), "state_id")
    )
    zero = F.lit(0)
    out = joined.select(
        "state", "policies", F.coalesce("claims", zero).alias("claims"), rounded("premium", 0).alias("total_premium"),
        rounded("incurred", 0).alias("total_incurred"), percent("incurred", "premium", 1).alias("loss_ratio"),
        F.coalesce("severe_alerts", zero).alias("severe_weather"), F.coalesce("disasters", zero).alias("disasters"), "last_disaster",
        F.coalesce("flood_claims", zero).alias("flood_claims"), F.coalesce(ratio("_damage", "flood_claims", 0), F.lit(0.0)).alias("avg_flood_payout"))
    return out.withColumn("risk_level", risk_level(
        F.col("loss_ratio"), F.col("severe_weather"), F.col("disasters"), many_alerts, very_many_alerts, many_disasters))


def weather_correlated_claims(customers: DataFrame, policies: DataFrame, claims: DataFrame, alerts: DataFrame, states: DataFrame,
                              since: str, k: int = 15, many: int = 1000, very_many: int = 5000, claims_over: int = 100) -> DataFrame:
    own = portfolio_by_state(customers, policies, claims)
    joined = own.join(severe_alerts_by_state(alerts, customers, since), "state_id", "left").join(states, "state_id")
    alerts_n, claims_n = F.coalesce("severe_alerts", F.lit(0)), F.coalesce("claims", F.lit(0))
    level = F.when((alerts_n > very_many) & (claims_n > claims_over), "HIGH RISK").when(alerts_n > many, "ELEVATED").otherwise("NORMAL")
    return joined.select("state", claims_n.alias("claims"), rounded("incurred", 0).alias("total_claimed"),
                         alerts_n.alias("severe_weather_alerts"), level.alias("risk_level")) \
        .orderBy(F.desc("severe_weather_alerts"), "state").limit(k)


def flood_benchmark(customers: DataFrame, policies: DataFrame, floods: DataFrame, states: DataFrame, types: Sequence[str],
                    since: str, k: int = 15) -> DataFrame:
    own = by_state(policies.filter(F.col("policy_type").isin(*types)), customers, {
        "your_policies": ("sum", F.count(F.lit(1))), "_premium": ("sum", F.sum("premium"))})
    joined = own.join(floods_by_state(floods, customers, since), "state_id").join(states, "state_id")
    out = joined.select("state", "your_policies", ratio("_premium", "your_policies", 0).alias("your_avg_premium"),
                        "flood_claims", ratio("_damage", "flood_claims", 0).alias("avg_flood_payout"))
    flag = F.when(F.col("avg_flood_payout") > F.col("your_avg_premium"), "UNDERPRICED").otherwise("OK")
    return out.withColumn("flood_risk_flag", flag).orderBy(F.desc_nulls_last("avg_flood_payout"), "state").limit(k)


def pricing_segments(customers: DataFrame, policies: DataFrame, claims: DataFrame, alerts: DataFrame, disasters: DataFrame,
                     states: DataFrame, alerts_since: str, disasters_since: str) -> DataFrame:
    """Loss ratio and exposure per state and policy type, with a pricing status."""
    own = portfolio_by_state(customers, policies, claims, ["policy_type"])
    joined = (
        own.join(severe_alerts_by_state(alerts, customers, alerts_since), "state_id", "left")
        .join(disasters_by_state(disasters, customers, disasters_since), "state_id", "left").join(states, "state_id")
    )
    out = joined.select(
        "state", "policy_type", "policies", ratio("premium", "policies", 0).alias("avg_premium"), F.coalesce("claims", F.lit(0)).alias("claims"),
        percent("incurred", "premium", 1).alias("loss_ratio"), F.coalesce("disasters", F.lit(0)).alias("disasters"),
        F.coalesce("severe_alerts", F.lit(0)).alias("severe_alerts"))
    return out.withColumn("pricing_status", pricing_status("loss_ratio"))


def pricing_status(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    (under, a), (marginal, m), (adequate, d) = PRICING_BANDS
    return F.when(c > under, a).when(c > marginal, m).when(c > adequate, d).when(c.isNotNull(), "PROFITABLE")


def filter_segments(segments: DataFrame, states: Sequence[str] | None = None, policy_type: str | None = None,
                    statuses: Sequence[str] | None = None, min_loss_ratio: float = 0.0) -> DataFrame:
    """The filters a user picked; an empty choice filters nothing."""
    chosen = [
        F.col("state").isin(*states) if states else None,
        F.col("policy_type") == policy_type if policy_type else None,
        F.col("pricing_status").isin(*statuses) if statuses else None,
        F.col("loss_ratio") >= min_loss_ratio if min_loss_ratio > 0 else None,
    ]
    for c in chosen:
        if c is not None:
            segments = segments.filter(c)
    return segments


def place_claims(claims: DataFrame, policies: DataFrame, customers: DataFrame) -> DataFrame:
    """Claims per state, day and cause: reduced per policy and day before the joins."""
    daily = claims.groupBy("policy_id", "claim_date", "cause").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("a"))
    return (
        daily.join(policies.select("policy_id", "customer_id"), "policy_id").join(customers.select("customer_id", "state_id"), "customer_id")
        .groupBy("state_id", F.col("claim_date").alias("day"), "cause").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    )


def disaster_windows(disasters: DataFrame, customers: DataFrame, open_days: int = 30) -> DataFrame:
    """Disasters with state and a closed window; a missing end is declaration + 30 days."""
    end = F.coalesce("end_date", F.date_add("designated_date", open_days))
    return disasters.join(customers.select("customer_id", "state_id"), "customer_id").select(
        "disaster_id", "state_id", "begin_date", F.greatest(end, F.col("begin_date")).alias("end_date"))


def claims_per_disaster(placed: DataFrame, windows: DataFrame) -> DataFrame:
    """Claims inside each disaster's window: window days meet daily totals by equality."""
    daily = placed.groupBy("state_id", "day").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    hits = cover_days(windows, "begin_date", "end_date").join(daily, ["state_id", "day"])
    totals = hits.groupBy("disaster_id").agg(F.sum("n").alias("claims"), rounded(F.sum("a"), 2).alias("incurred"))
    return windows.join(totals, "disaster_id", "left").select(
        "disaster_id", "state_id", "begin_date", "end_date", F.coalesce("claims", F.lit(0)).alias("claims"), "incurred")


def share_near_events(placed: DataFrame, windows: DataFrame, before: int, after: int) -> DataFrame:
    """Per state: claims on a day within reach of at least one event."""
    reach = windows.select("state_id", F.date_sub("begin_date", before).alias("b"), F.date_add("end_date", after).alias("e"))
    days = cover_days(reach, "b", "e").select("state_id", "day").distinct().withColumn("near", F.lit(True))
    joined = placed.join(days, ["state_id", "day"], "left")
    near = F.sum(F.when(F.col("near"), F.col("n")).otherwise(0))
    return joined.groupBy("state_id").agg(F.sum("n").alias("claims"), near.alias("near_events"), percent(near, F.sum("n"), 2).alias("near_pct"))


def claims_vs_index(claims: DataFrame, index: DataFrame) -> DataFrame:
    """Monthly claim cost beside an index, and their correlation."""
    cost = claims.groupBy(month_of("claim_date").alias("month")).agg(F.sum("amount").cast("double").alias("cost"))
    return cost.join(index, "month").agg(
        F.count(F.lit(1)).alias("months"), rounded(F.corr("cost", "index_value"), 4).alias("correlation"),
        rounded(F.avg("cost"), 2).alias("mean_cost"), rounded(F.avg("index_value"), 2).alias("mean_index"))


def hazard_index(counts: DataFrame, weights: dict[str, float], levels: Sequence[tuple[float, str]], last: str) -> DataFrame:
    """Weighted hazard score of a place and its level."""
    score = sum((F.coalesce(F.col(c), F.lit(0)) * F.lit(w) for c, w in weights.items()), F.lit(0.0))
    out = counts.withColumn("hazard", rounded(score, 2))
    level = None
    for limit, label in levels:
        level = F.when(F.col("hazard") < limit, label) if level is None else level.when(F.col("hazard") < limit, label)
    return out.withColumn("hazard_level", level.otherwise(last))


def property_band(year_built: Column, roof_age: Column, flood_zone: Column) -> Column:
    """Ours: risk band from age, roof and flood zone."""
    points = F.when(year_built < 1960, 2).when(year_built < 1990, 1).otherwise(0) + F.when(roof_age > 15, 1).otherwise(0) \
        + F.when(flood_zone.isin("A", "V"), 2).otherwise(0)
    return F.when(points >= 4, "High").when(points >= 2, "Moderate").otherwise("Low")


def hazard_by_zip(alerts: DataFrame, losses: DataFrame, customers: DataFrame, policies: DataFrame, perils: dict[str, Column],
                  weights: dict[str, float], levels: Sequence[tuple[float, str]], last: str, years: float) -> DataFrame:
    """state_id, zip_code, policies, avg_premium, one column per peril, hazard, hazard_level, expected_annual_loss.

    ``perils`` are conditions on alerts. Everything is counted per customer before it meets the customer's ZIP, so an alert or
    loss feed is shuffled once, and only in sums. Hazard is the weighted number of alerts per customer of the ZIP; a ZIP
    without alerts has 0. The yearly loss is what the ZIP lost over the years of the feed.
    """
    seen = alerts.groupBy("customer_id").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(p) for p, c in perils.items()])
    lost = losses.groupBy("customer_id").agg(F.sum("building_damage").alias("_lost"))
    own = policies.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_policies"), F.sum("premium").alias("_premium"))
    per_customer = customers.select("customer_id", "state_id", "zip_code").join(seen, "customer_id", "left").join(lost, "customer_id", "left").join(own, "customer_id", "left")
    per_zip = per_customer.groupBy("state_id", "zip_code").agg(
        F.count(F.lit(1)).alias("customers"), *[F.coalesce(F.sum(p), F.lit(0)).alias(p) for p in perils],
        F.coalesce(F.sum("_policies"), F.lit(0)).alias("policies"), F.sum("_premium").alias("_premium"), F.sum("_lost").alias("_lost"))
    rated = hazard_index(per_zip.withColumns({f"_{p}": F.col(p) / F.col("customers") for p in perils}), {f"_{p}": w for p, w in weights.items()}, levels, last)
    return rated.select(
        "state_id", "zip_code", "customers", "policies", ratio("_premium", "policies", 2).alias("avg_premium"), *perils, "hazard", "hazard_level",
        rounded(F.coalesce(F.col("_lost").cast("double"), F.lit(0.0)) / F.lit(years), 2).alias("expected_annual_loss"))
