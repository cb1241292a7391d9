"""Time-stamped activity: gaps and sessions per key, safe when one key has most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covermetrics.operators.relational import previous_in_key


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def gaps(df: DataFrame, key: str, at: str, tie: str, hours: int = 24) -> DataFrame:
    """Rows that follow more than ``hours`` hours of silence of their key."""
    seen = previous_in_key(df.select(key, at, tie), key, at, tie, [at])
    seconds = (_micros(at) - _micros(f"prev_{at}")) / F.lit(1e6)
    return seen.withColumn("gap_seconds", F.floor(seconds).cast("long")).filter(F.col("gap_seconds") > hours * 3600)


def transitions(df: DataFrame, key: str, at: str, tie: str, state: str) -> DataFrame:
    """Counts of state changes between neighbouring rows of a key."""
    seen = previous_in_key(df.select(key, at, tie, state), key, at, tie, [state])
    moved = seen.filter(F.col(f"prev_{state}").isNotNull() & (F.col(f"prev_{state}") != F.col(state)))
    return moved.groupBy(F.col(f"prev_{state}").alias("from_state"), F.col(state).alias("to_state")).agg(F.count(F.lit(1)).alias("changes"))


def sessions(df: DataFrame, key: str, at: str, tie: str, gap_minutes: int, slot: str = "day") -> DataFrame:
    """Sessions split by silence of more than ``gap_minutes``.

    Rows are numbered into pieces inside each (key, slot); only the pieces, which silences
    and slots bound in number, are then strung together per key.
    """
    seen = previous_in_key(df.select(key, at, tie), key, at, tie, [at], slot=slot)
    starts = F.col(f"prev_{at}").isNull() | (_micros(at) - _micros(f"prev_{at}") > gap_minutes * 60 * 1_000_000)
    flagged = seen.withColumn("_new", F.when(starts, 1).otherwise(0)).withColumn("_slot", F.date_trunc(slot, F.col(at)))
    inside = Window.partitionBy(key, "_slot").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    pieces = flagged.withColumn("_piece", F.sum("_new").over(inside)).groupBy(key, "_slot", "_piece").agg(
        F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("events"), F.max("_new").alias("_opens"))
    order = Window.partitionBy(key).orderBy("_slot", "_piece").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("_session", F.sum("_opens").over(order)).groupBy(key, "_session").agg(
        F.min("start").alias("session_start"), F.max("end").alias("session_end"), F.sum("events").alias("events")).drop("_session")
