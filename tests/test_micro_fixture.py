"""Hand-computed portfolio: four policies, four claims, with NULLs and a zero premium."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from covermetrics.operators import claims as cl
from covermetrics.operators import portfolio as pf
from covermetrics.operators import retention as rt


@pytest.fixture(scope="module")
def policies(spark):
    rows = [("P1", "C1", "Auto", dt.date(2024, 1, 10), D(100), D(20), "Active"), ("P2", "C1", "Home", dt.date(2024, 1, 20), D(200), D(50), "Active"),
            ("P3", "C2", "Auto", dt.date(2024, 2, 5), D(300), D(60), "Expired"), ("P4", "C3", "Home", dt.date(2024, 2, 15), D(0), D(0), "Cancelled")]
    return spark.createDataFrame(rows, "policy_id string, customer_id string, policy_type string, effective_date date, premium decimal(12,2), expense decimal(12,2), status string")


@pytest.fixture(scope="module")
def claims(spark):
    rows = [("K1", "P1", dt.date(2024, 1, 15), D(50), D(40), 85.0), ("K2", "P1", dt.date(2024, 3, 1), D(50), D(20), 10.0),
            ("K3", "P2", dt.date(2024, 2, 1), D(100), None, None), ("K4", "P3", dt.date(2024, 2, 20), D(30), D(30), 79.99)]
    return spark.createDataFrame(rows, "claim_id string, policy_id string, claim_date date, amount decimal(12,2), paid decimal(12,2), fraud_score double")


def one(df):
    return df.collect()[0]


def test_combined_ratio(policies, claims):
    r = one(pf.combined_ratio(policies, claims))
    assert (r.loss_ratio, r.expense_ratio, r.combined_ratio) == (15.0, 21.7, 36.7)


def test_fanout_counts_premium_per_claim(policies, claims):
    good = one(pf.loss_ratio_by(policies, claims, []))
    fan = one(pf.loss_ratio_by(policies, claims, [], fanout=True))
    assert (good.loss_ratio, fan.loss_ratio) == (38.3, 32.9)


def test_earned_factor(policies, claims):
    r = one(pf.portfolio_kpis(policies, claims, "2024-12-31"))
    assert (r.policies, r.written_premium, r.earned_premium, r.incurred_claims, r.loss_ratio) == (4, 600.0, 552.0, 230.0, 41.7)


def test_by_type_and_zero_premium(policies, claims):
    rows = {r.policy_type: r.loss_ratio for r in pf.loss_ratio_by(policies, claims, ["policy_type"]).collect()}
    assert rows == {"Auto": 32.5, "Home": 50.0}
    r = one(pf.combined_ratio(policies.filter("policy_id = 'P4'"), claims))
    assert r.loss_ratio is None and r.combined_ratio is None


def test_fraud_bands_with_null(claims):
    def bands(as_written):
        return {r.b: r["count"] for r in claims.groupBy(cl.fraud_band("fraud_score", as_written).alias("b")).count().collect()}
    assert bands(False) == {"80-100 (Critical)": 1, "60-80 (High)": 1, "0-20 (Low)": 1, "unknown": 1}
    assert bands(True) == {"80-100 (Critical)": 2, "60-80 (High)": 1, "0-20 (Low)": 1}


def test_same_month_claims(policies, claims):
    rows = {r.month.month: r.incurred_claims for r in pf.premium_vs_claims_trend(policies, claims, "2024-01-01").collect()}
    assert rows == {1: 50.0, 2: 30.0}


def test_shares_sum_to_100(policies):
    rows = pf.portfolio_mix(policies, ["Active", "Expired"]).collect()
    assert sum(r.share_pct for r in rows) == pytest.approx(100.0, abs=0.1)


def test_premium_survives_the_join(policies, claims):
    joined = pf.with_claims(policies, claims)
    assert one(joined.agg(F.sum("premium").alias("p"))).p == D(600)


def test_claim_window_reaches_both_slots(spark, policies, claims):
    history = spark.createDataFrame(
        [(1, "C1", "RISK_TIER", "Low", "High", dt.date(2024, 1, 15)), (2, "C1", "RISK_TIER", "Low", "High", dt.date(2024, 1, 14)),
         (3, "C1", "RISK_TIER", "Low", "High", dt.date(2024, 5, 30)), (4, "C1", "RISK_TIER", "Low", "High", dt.date(2024, 5, 31)),
         (5, "C9", "RISK_TIER", "Low", "High", dt.date(2024, 2, 1))],
        "history_id int, customer_id string, attribute_name string, old_value string, new_value string, change_date date")
    got = {r.history_id: r.after_claim for r in rt.changes_after_claim(history, policies, claims, days=90).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_nps(spark):
    s = spark.createDataFrame([(10, D("4.0")), (9, D("5.0")), (8, D("3.0")), (3, D("1.0")), (None, None)], "nps_rating int, satisfaction decimal(3,1)")
    r = one(rt.nps(s))
    assert (r.surveys, r.promoters, r.passives, r.detractors, r.nps, r.avg_satisfaction) == (5, 2, 1, 1, 20.0, 3.3)
