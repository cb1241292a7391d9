"""Rule templates, planted faults, detectors."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from covermetrics.operators.quality import detect, profile
from covermetrics.operators.quality.rules import Rule, run_rules

SCHEMA = "id int, name string, score int, day date, amount decimal(12,2), paid decimal(12,2), due decimal(12,2), parent string, status string"
AS_OF = "2024-06-30"


@pytest.fixture(scope="module")
def table(spark):
    good = (1, "a@b.c", 50, dt.date(2024, 1, 1), D(10), D(4), D(14), "x", "Paid")
    bad = (2, "nope", 500, dt.date(2030, 1, 1), D(-1), D(4), D(99), "zz", "Odd")
    null = (3, None, None, None, None, None, None, None, None)
    return spark.createDataFrame([good, bad, null], SCHEMA)


CASES = [
    ("not_null", "name", {}, 1), ("matches", "name", {"like": "%@%.%"}, 1), ("in_range", "score", {"low": 0, "high": 100}, 1),
    ("length", "name", {"n": 5}, 1), ("date_range", "day", {"low": "2020-01-01", "high": "2025-01-01"}, 1), ("allowed", "status", {"values": ["Paid"]}, 1),
    ("not_future", "day", {}, 1), ("sign", "amount", {}, 1), ("compare", "due", {"op": ">=", "other": "amount", "factor": 1}, 0),
    ("compare", "amount", {"op": ">", "other": "paid"}, 1), ("implies", "status", {"when": "status = 'Odd'", "then": "amount > 0"}, 1),
    ("reconciles", "amount", {"minuend": "due", "subtrahend": "paid"}, 1), ("unique", "id", {}, 0), ("unique", "parent", {}, 1),
    ("references", "parent", {"parent": "parents", "parent_key": "p"}, 2), ("fresh", "day", {"days": 7}, 0),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_template(spark, table, i):
    template, column, args, failed = CASES[i]
    rule = Rule("R", "r", "t", column, "Validity", template, 100, "High", args)
    parents = spark.createDataFrame([("x",), ("y",)], "p string")
    r = run_rules([rule], {"t": table, "parents": parents}, {"t": "id"}, AS_OF).collect()[0]
    assert (r.total_records, r.failed_records) == (3, failed)
    assert r.status == ("Pass" if failed == 0 else "Fail")


def test_one_scan_serves_all_row_rules(spark, table):
    rules = [Rule(f"R{i}", t, "t", c, "Validity", t, 100, "High", a) for i, (t, c, a, _) in enumerate(CASES) if t not in ("unique", "references", "fresh")]
    out = run_rules(rules, {"t": table}, {"t": "id"}, AS_OF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    assert out.count() == len(rules)


def test_all_null_uniqueness_counts_rows(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",), ("a",)], "k string")
    r = run_rules([Rule("U", "u", "t", "k", "Uniqueness", "unique")], {"t": df}, {"t": "k"}, AS_OF).collect()[0]
    assert r.failed_records == 3  # COUNT(*) - COUNT(DISTINCT k)


def test_planted_faults_are_found_exactly(spark):
    df = spark.range(1000).select(
        "id", F.when(F.col("id") < 37, None).otherwise("a@b.c").alias("email"), F.when(F.col("id") % 100 == 5, 300).otherwise(30).alias("days"))
    got = {r.issue: r["rows"] for r in detect.issue_report({"c": (df, {"null_email": F.col("email").isNull(), "slow": F.col("days") > 200})}).collect()}
    assert got == {"null_email": 37, "slow": 10}


def test_duplicates_of_a_dominant_copy(spark):
    """A third of all rows share one content: every surplus copy appears once, never as a pair."""
    df = spark.range(3000).select("id", F.when(F.col("id") < 1000, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    out = detect.content_duplicates(df, ["text"], "id").collect()
    assert len(out) == 999 and {r.original for r in out} == {0} and {r.copies for r in out} == {1000}


def test_near_duplicates_need_similar_contact(spark):
    rows = [(1, "Ann", "1990", "ann@x.org"), (2, "Ann", "1990", "ann1@x.org"), (3, "Ann", "1990", "zzzzzzzzzzzz"), (4, "Bob", "1991", "b@x.org")]
    df = spark.createDataFrame(rows, "id int, name string, born string, email string")
    assert [(r.id, r.original) for r in detect.near_duplicate_entities(df, ["name", "born"], "id", "email").collect()] == [(2, 1)]


def test_outliers_and_constant_groups(spark):
    df = spark.createDataFrame([("a", i, 10.0) for i in range(50)] + [("b", 100 + i, float(i % 5)) for i in range(50)] + [("b", 999, 500.0)], "g string, id int, v double")
    assert [r.id for r in detect.outliers_by_z(df, ["g"], "v", ["id"], 3.0).collect()] == [999]
    iqr = {r.g: r.outliers for r in detect.outliers_by_iqr(df, ["g"], "v").collect()}
    assert iqr == {"a": 0, "b": 1}


def test_profile_exact_and_sketched(spark, table):
    exact = {r.column_name: (r.total, r.nulls, r.distinct_count) for r in profile.profile_columns(table, "t").collect()}
    sketch = {r.column_name: (r.total, r.nulls, r.distinct_count) for r in profile.profile_columns(table, "t", exact=False).collect()}
    assert exact == sketch and exact["name"] == (3, 1, 2)


def test_worst_status_by_severity(spark):
    df = spark.createDataFrame([("Warning",), ("Critical",), ("Healthy",)], "s string")
    assert df.agg(profile.worst_status("s").alias("w")).collect()[0].w == "Critical"
    assert df.agg(profile.worst_status("s", as_written=True).alias("w")).collect()[0].w == "Warning"


def test_schema_drift_events(spark):
    old = spark.createDataFrame([("t", "a", "int", True), ("t", "b", "string", True), ("t", "c", "int", True), ("t", "e", "int", True)],
                                "table_name string, column_name string, data_type string, nullable boolean")
    new = spark.createDataFrame([("t", "a", "bigint", True), ("t", "bb", "string", True), ("t", "d", "int", True), ("t", "e", "int", False)], old.schema)
    got = {r.column_name: r.event_type for r in profile.schema_drift(old, new, {"b": "bb"}).collect()}
    assert got == {"a": "TYPE_CHANGED", "bb": "COLUMN_RENAMED", "c": "COLUMN_DROPPED", "d": "COLUMN_ADDED", "e": "NULLABILITY_CHANGED"}


STANDARD_SCHEMAS = {
    "customers": "customer_id string, date_of_birth date, email string, phone string, state string, risk_tier string, credit_score int, segment string, customer_since date",
    "agents": "agent_id string, license_number string, region string, performance_rating decimal(3,2), active_policies_count int, status string",
    "policies": "policy_id string, customer_id string, agent_id string, policy_type string, coverage_tier string, effective_date date, expiration_date date, premium_amount decimal(12,2), "
                "coverage_amount decimal(14,2), underwriting_score decimal(5,2), created_at timestamp_ntz",
    "claims": "claim_id string, policy_id string, claim_amount decimal(12,2), approved_amount decimal(12,2), status string, fraud_score decimal(5,2), friction_score decimal(5,2), resolution_days int, closed_date date",
    "billing": "invoice_id string, invoice_date date, due_date date, amount_due decimal(12,2), amount_paid decimal(12,2), outstanding_balance decimal(12,2), late_fee decimal(8,2), payment_status string, payment_date date",
    "at_risk_policies": "risk_id string, policy_id string, risk_category string, churn_probability decimal(5,4), revenue_at_risk decimal(12,2), nps_score int, snapshot_date date",
}


def standard_tables(spark):
    d = dt.date(2024, 6, 1)
    rows = {
        "customers": [("C1", dt.date(1980, 1, 1), "a@b.c", "1", "TX", "Low", 700, "Standard", d), ("C2", dt.date(2020, 1, 1), None, "2", "Tex", "Odd", 900, "Standard", d)],
        "agents": [("A1", "L1", "West", D("4.5"), 3, "Active"), ("A2", "L1", "North", D("0.5"), -1, "Gone")],
        "policies": [("P1", "C1", "A1", "Auto", "Basic", d, dt.date(2025, 6, 1), D(100), D(5000), D(50), dt.datetime(2024, 6, 28)),
                     ("P2", "C9", "A9", "Boat", "Gold", d, d, D(0), D(0), D(101), dt.datetime(2024, 6, 1))],
        "claims": [("K1", "P1", D(10), D(5), "Closed", D(10), D(1), 5, d), ("K2", "P9", None, D(50), "Open", D(101), D(11), -1, d)],
        "billing": [("I1", d, d, D(10), D(10), D(0), D(0), "Paid", d), ("I2", d, dt.date(2024, 5, 1), D(10), D(20), D(5), D(1), "Paid", None)],
        "at_risk_policies": [("R1", "P1", "Churn", D("0.5"), D(10), 5, d), ("R1", "P9", "Other", D("1.5"), D(0), 200, dt.date(2030, 1, 1))],
    }
    return {t: spark.createDataFrame(r, STANDARD_SCHEMAS[t]) for t, r in rows.items()}


def test_the_fifty_standard_rules(spark):
    from covermetrics.operators.quality.standard import STANDARD_KEYS, STANDARD_RULES
    assert [r.rule_id for r in STANDARD_RULES] == [f"DQR-{i:03d}" for i in range(1, 51)]
    out = run_rules(STANDARD_RULES, standard_tables(spark), STANDARD_KEYS, AS_OF).collect()
    failed = {int(r.rule_id[4:]): r.failed_records for r in out}
    assert len(failed) == 50
    clean = {2, 3, 5, 9, 10, 16, 21, 25, 26, 28, 29, 33, 36, 38, 41}
    # 3, 28, 29: NULLs pass; 21: 0 >= 0 holds; 25: the newest row is recent; the others hold good values
    assert {i for i, n in failed.items() if n == 0} == clean
    assert all(n == 1 for i, n in failed.items() if i not in clean)


def test_type_profile_finds_the_narrowest_type(spark):
    rows = [("1", "2024-01-05", "true", "1.5", "x", 3, dt.date(2024, 1, 5)), ("2", "2024-01-06 10:00", "no", "2", None, 4, dt.date(2024, 1, 6)),
            ("3", "2024-13-06", "FALSE", "-.5", None, None, dt.date(2024, 1, 20)), ("n/a", "2024-01-07", "True", " 7. ", None, 5, dt.date(2024, 1, 1))]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f int, day date")
    got = {r.column_name: (r.value_type, r.type_consistency, r.age_days) for r in profile.type_profile(df, list("abcdef"), "day", "2024-01-31").collect()}
    assert got == {"a": ("integer", 75.0, 11), "b": ("timestamp", 75.0, 11), "c": ("boolean", 75.0, 11), "d": ("number", 100.0, 11), "e": ("text", 100.0, 26), "f": ("int", 100.0, 25)}


def test_health_loses_for_mixed_types_and_age(spark):
    df = spark.createDataFrame([(str(i) if i % 5 else "?", i, dt.date(2024, 1, 1)) for i in range(100)], "a string, b int, day date")
    fresh, stale = (profile.column_health_full(df, "t", ["a", "b"], ["b"], [], "day", day, 45).orderBy("column_name").collect() for day in ("2024-01-31", "2024-05-31"))
    assert [(r.health_score, r.is_stale, r.status) for r in fresh] == [(80.0, False, "Warning"), (100.0, False, "Healthy")]
    assert [(r.health_score, r.is_stale, r.status) for r in stale] == [(70.0, True, "Critical"), (90.0, True, "Healthy")]
    plan = profile.type_profile(df, ["a", "b"], "day", "2024-01-31")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1  # one pass


def test_default_changes(spark):
    df = spark.createDataFrame([], "a int, b string, c int")
    old = profile.with_default(profile.with_default(df, "a", "1"), "b", "'x'")
    new = profile.with_default(profile.with_default(old, "a", "2"), "b", None)
    drift = profile.schema_drift(profile.schema_rows(spark, {"t": old}), profile.schema_rows(spark, {"t": new}))
    assert sorted((r.column_name, r.event_type, r.old_value, r.new_value) for r in drift.collect()) == [("a", "DEFAULT_CHANGED", "1", "2"), ("b", "DEFAULT_CHANGED", "'x'", None)]


def test_declared_defaults_are_seen(spark):
    spark.sql("CREATE TABLE t_defaults (a INT DEFAULT 7, b STRING) USING parquet")
    try:
        rows = {r.column_name: r.default_value for r in profile.schema_rows(spark, {"t": spark.table("t_defaults")}).collect()}
        assert rows == {"a": "7", "b": None}
    finally:
        spark.sql("DROP TABLE t_defaults")


def test_table_sizes_come_from_the_listing(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "x.parquet"))
    spark.range(90).repartition(3).write.parquet(str(tmp_path / "y.parquet"))
    want = {t: [p.stat().st_size for p in (tmp_path / f"{t}.parquet").glob("part-*.parquet")] for t in "xy"}
    got = {r.table_name: (r.files, r.bytes) for r in profile.catalog_files(spark, str(tmp_path)).collect()}
    assert got == {t: (len(s), sum(s)) for t, s in want.items()}


def test_ten_faults_count_each_fault(spark):
    d = dt.date(2024, 1, 1)
    customers = spark.createDataFrame([(1, "a@x", "1", 9), (2, None, "2", 9), (3, None, None, 8)], "customer_id int, email string, phone string, household_id int")
    claims = spark.createDataFrame([("c1", 1, 300, 90, "Hail"), ("c1", 1, 10, 10, "Fire"), ("c2", 2, 10, 81, "Hurricane")], "claim_id string, adjuster_id int, resolution_days int, fraud_score int, cause string")
    agents = spark.createDataFrame([(1, 1.5), (2, 1.5), (3, 4.0)], "agent_id int, performance_rating double")
    policies = spark.createDataFrame([(1, 20000.0), (2, 10.0)], "policy_id int, premium double")
    snapshots = spark.createDataFrame([(d,), (dt.date(2024, 2, 20),)], "snapshot_date date")
    got = {r.issue: r.rows for r in detect.ten_faults(customers, claims, agents, policies, snapshots, "2024-02-28", ["household_id"], ["Hail", "Hurricane"], busy_from=1).collect()}
    assert got == {"null_emails": 2, "null_phones": 1, "extreme_resolution": 1, "high_fraud_score": 2, "storm_claims": 2, "busy_low_rated_agents": 1,
                   "stale_snapshots": 1, "premium_outliers": 1, "duplicate_customers": 1, "duplicate_claims": 1}


def test_error_ids_sample_each_rule(spark):
    from covermetrics.operators.quality.rules import error_ids
    df = spark.createDataFrame([(i, None if i < 30 else "x", 1 if i % 2 else i) for i in range(100)], "id int, a string, b int")
    parents = spark.createDataFrame([(i,) for i in range(0, 90)], "k int")
    rules = [Rule("N", "n", "t", "a", "Completeness", "not_null"), Rule("U", "u", "t", "b", "Uniqueness", "unique"),
             Rule("F", "f", "t", "b", "Consistency", "references", args={"parent": "p", "parent_key": "k"})]
    got = {}
    for r in error_ids(rules, {"t": df, "p": parents}, {"t": "id"}, AS_OF, 5).collect():
        got.setdefault(r.rule_id, []).append((r["rank"], int(r.failing_id)))
    assert len(got["N"]) == 5 and all(i < 30 for _, i in got["N"])
    assert got["U"] == [(1, 1)] and sorted(i for _, i in got["F"]) == [90, 92, 94, 96, 98]
    whole = error_ids(rules[:1], {"t": df}, {"t": "id"}, AS_OF, 1000)
    assert sorted(int(r.failing_id) for r in whole.collect()) == list(range(30))


def test_work_table_is_dropped_also_after_an_error(spark):
    from covermetrics.sources.tables import work_table
    with work_table(spark.range(5), "t_work") as work:
        assert work.count() == 5 and spark.catalog.tableExists("t_work")
    assert not spark.catalog.tableExists("t_work")
    with pytest.raises(RuntimeError), work_table(spark.range(5), "t_work"):
        raise RuntimeError("stop")
    assert not spark.catalog.tableExists("t_work")


def test_exact_profile_copies_no_row_for_each_column(spark):
    df = spark.createDataFrame([(1, "a", None), (1, None, 2.5), (None, "b", float("nan")), (1, "a", None)], "a int, b string, c double")
    found = profile.profile_columns(df, "t")
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.column_name, r.total, r.nulls, r.distinct_count) for r in found.collect()) == [("a", 4, 1, 1), ("b", 4, 1, 2), ("c", 4, 2, 2)]
    assert sorted(tuple(r) for r in profile.profile_columns(df.limit(0), "t").collect()) == [("t", c, 0, 0, 0) for c in "abc"]
