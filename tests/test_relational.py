import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from covermetrics.functions import dates, numbers, strings
from covermetrics.operators import activity, change
from covermetrics.operators import relational as rel


def hot_events(spark):
    """One key has a third of the rows."""
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 100 + 1).cast("int").alias("k"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 137 % 500000).cast("decimal(18,6)"))).alias("at"),
        (F.col("id") % 7).alias("state"))


def test_previous_in_key_equals_lag(spark):
    df = hot_events(spark)
    want = df.withColumn("prev_state", F.lag("state").over(Window.partitionBy("k").orderBy("at", "id")))
    got = rel.previous_in_key(df, "k", "at", "id", ["state"])
    key = ["id", "prev_state"]
    assert got.select(key).exceptAll(want.select(key)).count() == 0 and got.count() == 3000


@pytest.mark.parametrize("slot", ["hour", "day"])
def test_sessions_do_not_depend_on_slots(spark, slot):
    df = hot_events(spark)
    out = activity.sessions(df, "k", "at", "id", 30, slot=slot)
    assert out.agg(F.sum("events")).collect()[0][0] == 3000
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, activity.sessions(df, "k", "at", "id", 30, slot="month").collect()))


def test_attach_group_facts_keeps_hot_and_cold_rows(spark):
    df = hot_events(spark)
    facts = df.groupBy("k").agg(F.count(F.lit(1)).alias("group_rows"))
    out = rel.attach_group_facts(df, facts, ["k"], share=10)
    assert out.count() == 3000
    assert out.filter("k = 0").select("group_rows").distinct().collect()[0][0] == 1000


def test_attach_group_facts_keeps_null_groups_and_leaves_hot_rows_in_place(spark):
    df = hot_events(spark).withColumn("k", F.when(F.col("k") != 5, F.col("k")))
    facts = df.groupBy("k").agg(F.count(F.lit(1)).alias("group_rows"))
    out = rel.attach_group_facts(df, facts, ["k"], share=10)
    assert out.count() == 3000 and out.filter("k IS NULL").count() == out.filter("k IS NULL").select("group_rows").first()[0]
    known = spark.createDataFrame(facts.collect(), "k int, group_rows long")
    plan = rel.attach_group_facts(df, known, ["k"], share=10)._jdf.queryExecution().executedPlan().toString()
    warm = plan[plan.index("Union"):].split("\n   +- ")[0]  # the first of the union's two inputs
    assert "BroadcastHashJoin" in warm and "hashpartitioning(k" not in warm


def test_not_in_follows_sql(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    for values in ([(1,)], [(1,), (None,)], [], [(None,)]):
        right = spark.createDataFrame(values, "v int")
        left.createOrReplaceTempView("l_values")
        right.createOrReplaceTempView("r_values")
        want = spark.sql("SELECT v FROM l_values WHERE v NOT IN (SELECT v FROM r_values)").collect()
        assert sorted(map(str, rel.not_in(left, right, "v").collect())) == sorted(map(str, want))


def test_number_rows_is_dense_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "key")
    a = rel.number_rows(df, "key")
    assert a.agg(F.min("row_no"), F.max("row_no"), F.countDistinct("row_no")).collect()[0] == (1, 5000, 5000)
    b = rel.number_rows(df.repartition(7), "key")
    assert a.exceptAll(b).count() == 0


def test_number_in_order_counts_over_ranges(spark):
    df = spark.range(3000).selectExpr("id % 7 AS g", "id", "CAST(NULL AS STRING) AS empty")
    out = rel.number_in_order(df, [F.desc("g"), F.col("id")], rows_per_range=100)
    assert "Window" in out._jdf.queryExecution().executedPlan().toString()
    got = [(r.g, r.id) for r in out.orderBy("row_no").collect()]
    assert got == sorted(((i % 7, i) for i in range(3000)), key=lambda x: (-x[0], x[1]))
    assert [r.row_no for r in out.orderBy("row_no").collect()] == list(range(1, 3001))
    assert rel.number_in_order(df.limit(0), ["id"]).count() == 0


def test_ranges_grow_in_number_not_in_size(spark):
    def largest(rows):
        staged = rel.number_in_order(spark.range(rows), ["id"], rows_per_range=1000)
        paths = staged.inputFiles()
        return max(spark.read.parquet(p).count() for p in paths)
    assert largest(200_000) <= 2 * largest(20_000) <= 10_000


def test_round_robin_is_even(spark):
    items, slots = spark.range(10).withColumnRenamed("id", "i"), spark.range(3).withColumnRenamed("id", "s")
    counts = sorted(r["count"] for r in rel.round_robin_assign(items, "i", slots, "s").groupBy("s").count().collect())
    assert counts == [3, 3, 4]


def test_as_of_lookup(spark):
    rows = [("a", dt.date(2023, 1, 1), 1.0), ("a", dt.date(2023, 3, 1), 2.0), ("a", dt.date(2024, 2, 1), 5.0), ("b", dt.date(2024, 1, 1), 7.0)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    got = {(r.k, r.d): r.earlier for r in rel.as_of_lookup(df, ["k"], "d", "v", 12).collect()}
    assert got[("a", dt.date(2024, 2, 1))] == 1.0 and got[("b", dt.date(2024, 1, 1))] is None


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0])


def test_number_rules(spark):
    L = F.lit
    assert one(spark, numbers.rounded(L(1.005), 2), numbers.percent(L(1), L(0)), numbers.rounded(L(2.5), 0), numbers.rounded_score(L(1.234565), 5)) == (1.01, None, 3.0, 1.23457)
    assert one(spark, numbers.strict_least(L(1), L(None).cast("int")), numbers.strict_greatest(L(1), L(2))) == (None, 2)
    assert one(spark, numbers.array_position0(F.array(L("a"), L("b")), L("b")), numbers.array_position0(F.array(L("a")), L("z"))) == (1, None)
    assert one(spark, numbers.money_text_to_number(L(" $1,234.50 ")), numbers.money_text_to_number(L("n/a"))) == (1234.5, None)
    assert one(spark, numbers.short_currency(L(1234567)), numbers.short_currency(L(4321)), numbers.short_currency(L(12.4)), numbers.percent_text(L(12.34))) == ("$1.2M", "$4.3K", "$12", "12.3%")
    assert one(spark, numbers.hash_bucket(L("a"), 1 << 40)) == (214005177,)


def test_date_rules(spark):
    def d(s):
        return F.lit(s).cast("date")
    assert one(spark, dates.months_between_boundaries(d("2024-01-31"), d("2024-03-01"))) == (2,)
    assert one(spark, dates.hours_between_boundaries(F.lit("2024-01-01 10:59:00").cast("timestamp"), F.lit("2024-01-01 11:01:00").cast("timestamp"))) == (1,)
    assert one(spark, dates.fiscal_quarter_start(F.lit("2024-Q3")), dates.fiscal_quarter_text(d("2024-08-05"))) == (dt.date(2024, 7, 1), "2024-Q3")
    assert one(spark, dates.days_until(d("2024-01-01"), "2024-02-01"), dates.days_until(d("2024-02-11"), "2024-02-01")) == (0, 10)
    assert one(spark, dates.period_start("2024-05-20", "QTD"), dates.period_start("2024-05-20", "YTD")) == (dt.date(2024, 4, 1), dt.date(2024, 1, 1))


def test_string_rules(spark):
    L = F.lit
    assert one(spark, strings.strip_fence(L('```json\n{"a": 1}\n```')), strings.strip_fence(L(' {"a": 1} '))) == ('{"a": 1}', '{"a": 1}')
    assert one(spark, strings.cleaned(L(' "x" ')), strings.cleaned(L("null"), "d"), strings.cleaned(L(None).cast("string"))) == ("x", "d", None)
    assert one(spark, strings.edit_similarity(L("kitten"), L("sitting")), strings.token_jaccard(L("Red car"), L("red bus"))) == (0.5714, 0.3333)
    assert one(spark, strings.token_estimate(L(9))) == (3,)


# ---- table changes ------------------------------------------------------------------
def kv(spark, rows):
    return spark.createDataFrame(rows, "k int, v string, w string")


def test_upsert_updates_only_named_columns_and_repeats_safely(spark):
    old, new = kv(spark, [(1, "a", "x"), (2, "b", "y")]), kv(spark, [(2, "B", "Z"), (3, "c", "z"), (3, "d", "z")])
    once = change.upsert(old, new, ["k"], ["v"], ["v"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "d", "z")]
    twice = change.upsert(once, new, ["k"], ["v"], ["v"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_upsert_can_write_null(spark):
    old, new = kv(spark, [(1, "a", "x")]), kv(spark, [(1, None, "q")])
    assert change.upsert(old, new, ["k"], ["v"], ["w"]).collect()[0].v is None


def test_insert_new_and_replace_children(spark):
    old, new = kv(spark, [(1, "a", "x"), (2, "b", "y")]), kv(spark, [(2, "B", "Z"), (3, "c", "z")])
    assert sorted(r.k for r in change.insert_new(old, new, ["k"], ["v"]).collect()) == [1, 2, 3]
    assert sorted((r.k, r.v) for r in change.replace_children(old, new, "k").collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_remap_sees_earlier_steps(spark):
    assert one(spark, change.remap(F.lit("A"), [(["A"], "B"), (["B"], "C")])) == ("C",)


def test_ids_continue(spark):
    old = spark.createDataFrame([("V-00007", 1)], "vid string, k int")
    got = sorted(r.vid for r in change.allocate_ids(old, spark.range(3).withColumnRenamed("id", "k"), "vid", "V-", "k").collect())
    assert got == ["V-00008", "V-00009", "V-00010"]


def test_update_where_leaves_null_conditions_alone(spark):
    df = kv(spark, [(1, None, "x"), (2, "b", "y")])
    got = {r.k: r.w for r in change.update_where(df, F.col("v") == "b", {"w": F.lit("new")}).collect()}
    assert got == {1: "x", 2: "new"}
