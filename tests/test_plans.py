"""The shape of plans: what must be pushed down, and what must not be shuffled or paired."""

from covermetrics.operators import portfolio
from covermetrics.plans.registry import Book, all_plans
from covermetrics.session import scratch_path
from covermetrics.sources.tables import write_bucketed

FOLDER = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_facts_join_without_a_shuffle(spark):
    b = Book(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("policies", "claims"):
            write_bucketed(b.role(name), f"t_{name}", ["policy_id"], 4, scratch_path(spark, f"bucketed-{name}"))
        joined = portfolio.with_claims(spark.table("t_policies"), spark.table("t_claims"))
        assert joined.count() == b.policies.count()
        assert "Exchange" not in physical(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("policies", "claims"):
            spark.sql(f"DROP TABLE IF EXISTS t_{name}")


def test_date_filter_and_columns_reach_the_scan(spark):
    plan = physical(all_plans()["claims_by_region_month"].build(Book(spark, FOLDER)))
    scan = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    assert "GreaterThanOrEqual(l_shipdate" in scan or "l_shipdate" in scan.split("DataFilters")[1]
    assert "l_tax" not in scan and "l_returnflag" not in scan


def test_scorecard_counts_before_it_joins(spark):
    plan = physical(all_plans()["geo_risk_scorecard"].build(Book(spark, FOLDER)))
    assert "partial_count" in plan and "CartesianProduct" not in plan


def test_cube_matrix_scans_the_facts_once(spark):
    from covermetrics.plans import semantic
    b = Book(spark, FOLDER)
    for domain, facts in (("Claims", "lineitem"), ("Policies", "orders"), ("Customers", "customer")):
        plan = physical(semantic.MODEL.grouped_once(semantic.tables(b), domain)[0])
        scans = [line for line in plan.splitlines() if "FileScan" in line and f"{facts}.parquet" in line]
        assert len(scans) == 1 and "Expand" in plan, domain
