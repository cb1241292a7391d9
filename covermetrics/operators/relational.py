"""Building blocks that keep their shape when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermetrics.session import scratch_path

# A group is hot when it holds more than 1/HOT_SHARE of all rows, so there are fewer
# than HOT_SHARE hot groups: a proven bound for broadcasting them.
HOT_SHARE = 1000


def attach_group_facts(df: DataFrame, facts: DataFrame, keys: Sequence[str], rows: str = "group_rows",
                       share: int = HOT_SHARE, total: Column | None = None) -> DataFrame:
    """Inner-join each row to the facts of its group without collecting a group anywhere.

    ``facts`` has one row per key and the group's row count in ``rows``. Rows of hot groups get their facts by broadcast
    (fewer than ``share`` fact rows) and are never shuffled; the others meet theirs in a shuffle, in groups small by
    definition. NULL is a group like any other. The rows are read once for each of the two parts, and once more to be
    counted unless ``total`` is given; the sum of ``rows`` over the facts keeps the bound on hot groups too.
    """
    keys = list(keys)
    names = [c for c in facts.columns if c not in keys]
    total = df.agg(F.count(F.lit(1))).scalar() if total is None else total
    is_hot = F.col(rows) * F.lit(share) > total
    named = facts.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    hot, cold = named.filter(is_hot), named.filter(~is_hot)
    same = all_of(*[F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    columns = [*df.columns, *names]
    warm = df.join(F.broadcast(hot), same).select(*columns)
    rest = df.join(F.broadcast(hot.select(*[f"_key_{k}" for k in keys])), same, "left_anti").join(cold, same).select(*columns)
    return warm.unionByName(rest)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                   columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the greatest by ``order``. An aggregate, so partial results are
    merged map-side and no group is sorted in one task."""
    keys = list(keys)
    columns = [c for c in (columns or df.columns) if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def not_in(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """SQL's NOT IN: no row passes if the values hold a NULL, all pass if there are none, a NULL key passes only then.

    An anti-join with the count of values and of NULLs beside it: unlike the null-aware anti-join it never has to
    broadcast the values.
    """
    counts = values.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(column).isNull()).alias("nulls"))).scalar()
    rest = df.join(values.select(column), column, "left_anti").select(*df.columns).withColumn("_c", counts)
    return rest.filter((F.col("_c.n") == 0) | ((F.col("_c.nulls") == 0) & F.col(column).isNotNull())).drop("_c")


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    rank: str = "rank") -> DataFrame:
    """k best rows per group. Spark keeps k rows per group and task before the shuffle
    (window group limit), so a hot group costs k rows per map task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Exact COUNT(*), COUNT(col), COUNT(DISTINCT col) by a two-step aggregate."""
    return df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("non_null"),
        F.count("_v").alias("distinct"),
    )


def number_in_order(df: DataFrame, order: Sequence[Column | str], name: str = "row_no",
                    rows_per_range: int = 1 << 20) -> DataFrame:
    """Number rows 1..n in the given order, which should leave no ties, without a window over all rows.

    The rows are written once, dealt to ranges by sampled bounds and sorted inside them; a row's number is its place in
    its range plus the counts of the ranges before. Ranges hold about ``rows_per_range`` rows or less however many rows
    there are, and only one count per range meets in one task.
    """
    spark = df.sparkSession
    rows, ranged = scratch_path(spark, "numbered-rows"), scratch_path(spark, "numbered-ranges")
    df.write.parquet(rows)
    staged = spark.read.schema(df.schema).parquet(rows)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-staged.count() // rows_per_range))
    dealt = staged.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt.select(F.struct(*staged.columns).alias("_row"), F.monotonically_increasing_id().alias("_at")).write.parquet(ranged)
    # The id holds the range above its 33 lowest bits and the place in the range below.
    placed = spark.read.parquet(ranged).select("_row", F.shiftright("_at", 33).alias("_range"),
                                               F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_range").select("_row.*", (F.col("_offset") + F.col("_place") + 1).alias(name))


def number_rows(df: DataFrame, key: str, name: str = "row_no") -> DataFrame:
    """Number rows 1..n in md5 order of a unique key."""
    return number_in_order(df, [F.md5(F.col(key).cast("string")), F.col(key)], name)


def round_robin_assign(items: DataFrame, item_key: str, slots: DataFrame, slot_key: str) -> DataFrame:
    """Deal items to slots in turn: item number modulo slot count meets slot number."""
    numbered = number_rows(items, item_key, name="_item")
    seats = number_rows(slots, slot_key, name="_slot")
    n_slots = slots.agg(F.count(F.lit(1))).scalar()
    dealt = numbered.withColumn("_slot", (F.col("_item") - 1) % n_slots + 1)
    return dealt.join(seats, "_slot").drop("_item", "_slot")


def previous_in_key(df: DataFrame, key: str, at: str, tie: str, columns: Sequence[str],
                    slot: str = "hour", prefix: str = "prev_") -> DataFrame:
    """LAG by key and time, with the key's rows spread over calendar slots.

    Inside a (key, slot) the built-in LAG is used; the first row of a slot takes the last
    row of the key's previous non-empty slot, from one summary row per (key, slot).
    """
    columns = list(columns)
    slotted = df.withColumn("_slot", F.date_trunc(slot, F.col(at)))
    payload = F.struct(*columns)
    inside = Window.partitionBy(key, "_slot").orderBy(at, tie)
    rows = slotted.withColumn("_prev", F.lag(payload).over(inside))
    last = slotted.groupBy(key, "_slot").agg(F.max_by(payload, F.struct(at, tie)).alias("_last"))
    carried = last.select(key, "_slot", F.lag("_last").over(Window.partitionBy(key).orderBy("_slot")).alias("_carry"))
    joined = rows.join(carried, [key, "_slot"])
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    return joined.select(*df.columns, *[prev[c].alias(f"{prefix}{c}") for c in columns])


def as_of_lookup(facts: DataFrame, key: Sequence[str], at: str, value: str, lag_months: int) -> DataFrame:
    """For each fact, the latest observation of its key at or before ``lag_months`` earlier.

    Facts and probes are laid on one time line per key and the last observation is carried
    forward, so nothing is paired up.
    """
    key = list(key)
    obs = facts.select(*key, F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.col(value).alias("_obs"),
                       F.lit(None).cast("date").alias(at), F.lit(None).cast(facts.schema[value].dataType).alias(value))
    probes = facts.select(*key, F.add_months(at, -lag_months).alias("_t"), F.lit(1).alias("_kind"),
                          F.lit(None).cast(facts.schema[value].dataType).alias("_obs"), at, value)
    w = Window.partitionBy(*key).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    line = obs.unionByName(probes).withColumn("earlier", F.last("_obs", ignorenulls=True).over(w))
    return line.filter(F.col("_kind") == 1).select(*key, at, value, "earlier")


def cover_days(intervals: DataFrame, begin: str, end: str, day: str = "day") -> DataFrame:
    """One row per interval and calendar day, turning an interval join into an equi-join."""
    return intervals.withColumn(day, F.explode(F.sequence(F.col(begin), F.col(end))))


def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions a caller did supply; TRUE if none."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out
