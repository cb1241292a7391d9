"""Monthly series: building, forecasting, back-testing, anomalies.

The model is a straight line plus the mean residual of each calendar month, fitted with
regression aggregates: one row per series and month goes in, and any number of series is
fitted in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.functions.dates import month_index, month_of
from covermetrics.functions.numbers import percent, ratio, rounded
from covermetrics.operators.relational import top_k_per_group

MIN_POINTS = 3
Z_95 = 1.96
ORIGIN = 2000 * 12  # month index 0 of the trend line: January 2000
# Ours: a month is anomalous when its residual exceeds this many residual deviations.
ANOMALY_Z = 2.0


def build_series(df: DataFrame, time: str, value: str | None, agg: str = "sum", by: str | None = None) -> DataFrame:
    """(series, month, value) with SUM, AVG or COUNT per month."""
    if agg == "count":
        measure = F.count(F.lit(1)).cast("double")
    elif agg == "avg":
        measure = ratio(F.sum(value), F.count(value), 4)
    else:
        measure = F.sum(value).cast("double")
    dated = df.filter(F.col(time).isNotNull())
    if by:
        return dated.groupBy(F.col(by).cast("string").alias("series"), month_of(time).alias("month")).agg(measure.alias("value"))
    # The one series' name is an aggregate: a plain literal would be folded out of the later
    # joins on it and turn them into nested loops.
    monthly = dated.groupBy(month_of(time).alias("month")).agg(F.max(F.lit("all")).alias("series"), measure.alias("value"))
    return monthly.select("series", "month", "value")


def _t(month: Column | str) -> Column:
    return (month_index(month) - F.lit(ORIGIN)).cast("double")


def fit(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line and residual deviation per series, and the calendar-month effects."""
    pts = series.select("series", "month", "value", _t("month").alias("t"), F.month("month").alias("moy"))
    enough = F.count(F.lit(1)) >= MIN_POINTS
    line = pts.groupBy("series").agg(
        F.when(enough, F.regr_slope("value", "t")).alias("slope"),
        F.when(enough, F.regr_intercept("value", "t")).alias("intercept"),
        F.max("month").alias("last_month"), F.count(F.lit(1)).alias("points"))
    resid = pts.join(line, "series").withColumn("r", F.col("value") - (F.col("intercept") + F.col("slope") * F.col("t")))
    season = resid.groupBy("series", "moy").agg(F.avg("r").alias("effect"))
    sigma = resid.join(season, ["series", "moy"]).groupBy("series").agg(F.stddev_samp(F.col("r") - F.col("effect")).alias("sigma"))
    return line.join(sigma, "series"), season


def _expected(month: Column | str) -> Column:
    return F.col("intercept") + F.col("slope") * _t(month) + F.coalesce("effect", F.lit(0.0))


def forecast(series: DataFrame, periods: int = 6) -> DataFrame:
    """Point forecast with 95 % bounds for the next ``periods`` months of each series."""
    line, season = fit(series)
    ahead = line.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(periods)))) \
        .withColumn("month", F.add_months("last_month", F.col("h"))).withColumn("moy", F.month("month"))
    out = ahead.join(season, ["series", "moy"], "left")
    point = _expected("month")
    return out.select("series", "month", rounded(point, 2).alias("forecast"),
                      rounded(point - F.col("sigma") * Z_95, 2).alias("lower_bound"), rounded(point + F.col("sigma") * Z_95, 2).alias("upper_bound"))


def history_plus_forecast(series: DataFrame, periods: int = 6) -> DataFrame:
    past = series.select("series", "month", rounded("value", 2).alias("value"), F.lit("Historical").alias("type"))
    ahead = forecast(series, periods).select("series", "month", F.col("forecast").alias("value"), F.lit("Forecast").alias("type"))
    return past.unionByName(ahead)


def forecast_vs_recent(series: DataFrame, periods: int = 6, recent: int = 6) -> DataFrame:
    """Mean forecast against the mean of the last months, in percent."""
    tail = top_k_per_group(series, ["series"], [F.desc("month")], recent).groupBy("series").agg(F.avg("value").alias("recent"))
    ahead = forecast(series, periods).groupBy("series").agg(F.avg("forecast").alias("ahead"))
    return ahead.join(tail, "series").select(
        "series", rounded("recent", 2).alias("recent_mean"), rounded("ahead", 2).alias("forecast_mean"),
        percent(F.col("ahead") - F.col("recent"), F.greatest(F.col("recent"), F.lit(1.0)), 1).alias("change_pct"))


def widest_interval(forecasts: DataFrame) -> DataFrame:
    """The forecast month with the widest bounds of each series."""
    width = F.col("upper_bound") - F.col("lower_bound")
    return forecasts.groupBy("series").agg(F.max_by(F.struct("month", "lower_bound", "upper_bound"), F.struct(rounded(width, 2), "month")).alias("w")) \
        .select("series", "w.month", "w.lower_bound", "w.upper_bound")


def predicted_loss_ratio(cost: DataFrame, premium: DataFrame, periods: int = 3) -> DataFrame:
    """Forecast cost over forecast premium with an alert level; no premium, no ratio."""
    c = forecast(cost, periods).select("month", F.col("forecast").alias("predicted_cost"))
    p = forecast(premium, periods).select("month", F.col("forecast").alias("predicted_premium"))
    out = c.join(p, "month", "left").withColumn("loss_ratio", percent("predicted_cost", "predicted_premium", 1))
    level = F.when(F.col("loss_ratio") > 70, "error").when(F.col("loss_ratio") > 50, "warning").when(F.col("loss_ratio").isNotNull(), "ok")
    return out.withColumn("level", level)


def backtest(series: DataFrame, months: int = 3) -> DataFrame:
    """Forecast the last months from the rest and compare."""
    ends = series.groupBy("series").agg(F.add_months(F.max("month"), -months).alias("cut"))
    parts = series.join(ends, "series")
    ahead = forecast(parts.filter(F.col("month") <= F.col("cut")).select("series", "month", "value"), months)
    actual = parts.filter(F.col("month") > F.col("cut")).select("series", "month", "value")
    return actual.join(ahead, ["series", "month"]).groupBy("series").agg(
        F.count(F.lit(1)).alias("months"),
        rounded(F.avg(F.abs(F.col("value") - F.col("forecast")) / F.nullif(F.col("value"), F.lit(0.0)) * 100), 2).alias("mape"),
        F.count_if(F.col("value").between(F.col("lower_bound"), F.col("upper_bound"))).alias("inside_bounds"))


def detect_anomalies(series: DataFrame, hold_out: int = 3) -> DataFrame:
    """Actual and expected value per month from the training months' model.

    Distance is the residual in training deviations; the percentile is its logistic
    approximation to the normal distribution (ours).
    """
    ends = series.groupBy("series").agg(F.add_months(F.max("month"), -hold_out).alias("cut"))
    train = series.join(ends, "series").filter(F.col("month") < F.col("cut")).select("series", "month", "value")
    line, season = fit(train)
    scored = series.withColumn("moy", F.month("month")).join(line, "series").join(season, ["series", "moy"], "left")
    distance = (F.col("value") - _expected("month")) / F.nullif(F.col("sigma"), F.lit(0.0))
    out = scored.select(
        "series", "month", rounded("value", 2).alias("actual"), rounded(_expected("month"), 2).alias("expected"),
        rounded(distance, 3).alias("distance"), rounded(F.lit(1.0) / (F.lit(1.0) + F.exp(distance * -1.702)), 3).alias("percentile"))
    return out.withColumn("is_anomaly", F.abs("distance") > ANOMALY_Z)
