"""The standard rule set for the insurance tables (names as in FIXTURES.md)."""

from __future__ import annotations

from covermetrics.operators.quality.rules import Rule


def _r(number: int, table: str, topic: str, column: str, dimension: str, template: str, threshold: float, severity: str, **args) -> Rule:
    return Rule(f"DQR-{number:03d}", topic, table, column, dimension, template, threshold, severity, args)


C, V, U, T, K = "Completeness", "Validity", "Uniqueness", "Timeliness", "Consistency"

# The fifty rules with their thresholds and severities.
STANDARD_RULES = [
    _r(1, "customers", "customers_email_not_null", "email", C, "not_null", 95, "High"),
    _r(2, "customers", "customers_phone_not_null", "phone", C, "not_null", 90, "Medium"),
    _r(3, "customers", "customers_email_format", "email", V, "matches", 98, "High", like="%@%.%"),
    _r(4, "customers", "customers_credit_score_range", "credit_score", V, "in_range", 99, "Critical", low=300, high=850),
    _r(5, "customers", "customers_unique_id", "customer_id", U, "unique", 100, "Critical"),
    _r(6, "customers", "customers_state_valid", "state", V, "length", 99, "Medium", n=2),
    _r(7, "customers", "customers_dob_reasonable", "date_of_birth", V, "date_range", 99.5, "High", low="1940-01-01", high="2007-01-01"),
    _r(8, "customers", "customers_risk_tier_valid", "risk_tier", V, "allowed", 100, "Critical", values=["Low", "Medium", "High", "Critical"]),
    _r(9, "customers", "customers_segment_valid", "segment", V, "allowed", 100, "Critical", values=["Premium", "Standard", "Budget"]),
    _r(10, "customers", "customers_since_not_future", "customer_since", T, "not_future", 100, "High"),
    _r(11, "agents", "agents_unique_license", "license_number", U, "unique", 100, "Critical"),
    _r(12, "agents", "agents_performance_range", "performance_rating", V, "in_range", 100, "High", low=1, high=5),
    _r(13, "agents", "agents_region_valid", "region", V, "allowed", 100, "Medium", values=["Northeast", "Southeast", "Midwest", "West", "Southwest"]),
    _r(14, "agents", "agents_status_valid", "status", V, "allowed", 100, "Critical", values=["Active", "Inactive"]),
    _r(15, "agents", "agents_active_policies_positive", "active_policies_count", V, "sign", 100, "Medium", zero_ok=True),
    _r(16, "policies", "policies_unique_id", "policy_id", U, "unique", 100, "Critical"),
    _r(17, "policies", "policies_valid_customer", "customer_id", K, "references", 100, "Critical", parent="customers", parent_key="customer_id"),
    _r(18, "policies", "policies_valid_agent", "agent_id", K, "references", 100, "Critical", parent="agents", parent_key="agent_id"),
    _r(19, "policies", "policies_end_after_start", "expiration_date", V, "compare", 100, "Critical", op=">", other="effective_date"),
    _r(20, "policies", "policies_premium_positive", "premium_amount", V, "sign", 100, "Critical"),
    _r(21, "policies", "policies_coverage_exceeds_premium", "coverage_amount", V, "compare", 99, "High", op=">=", other="premium_amount", factor=12),
    _r(22, "policies", "policies_type_valid", "policy_type", V, "allowed", 100, "Critical", values=["Auto", "Home", "Life", "Health", "Commercial"]),
    _r(23, "policies", "policies_tier_valid", "coverage_tier", V, "allowed", 100, "High", values=["Basic", "Standard", "Premium", "Platinum"]),
    _r(24, "policies", "policies_underwriting_range", "underwriting_score", V, "in_range", 99, "Medium", low=0, high=100),
    _r(25, "policies", "policies_freshness", "created_at", T, "fresh", 100, "High", days=7),
    _r(26, "claims", "claims_unique_id", "claim_id", U, "unique", 100, "Critical"),
    _r(27, "claims", "claims_valid_policy", "policy_id", K, "references", 100, "Critical", parent="policies", parent_key="policy_id"),
    _r(28, "claims", "claims_amount_positive", "claim_amount", V, "sign", 100, "Critical"),
    _r(29, "claims", "claims_approved_le_claimed", "approved_amount", V, "compare", 99, "High", op="<=", other="claim_amount"),
    _r(30, "claims", "claims_fraud_score_range", "fraud_score", V, "in_range", 100, "High", low=0, high=100),
    _r(31, "claims", "claims_resolution_days_positive", "resolution_days", V, "sign", 100, "Medium", zero_ok=True),
    _r(32, "claims", "claims_friction_range", "friction_score", V, "in_range", 99.5, "Medium", low=0, high=10),
    _r(33, "claims", "claims_status_valid", "status", V, "allowed", 100, "Critical", values=["Open", "Under Review", "Approved", "Denied", "Closed"]),
    _r(34, "claims", "claims_closed_date_logic", "closed_date", K, "implies", 98, "Medium", when="closed_date IS NOT NULL", then="status IS NULL OR status NOT IN ('Open', 'Under Review')"),
    _r(35, "claims", "claims_not_null_amount", "claim_amount", C, "not_null", 100, "Critical"),
    _r(36, "billing", "billing_unique_invoice", "invoice_id", U, "unique", 100, "Critical"),
    _r(37, "billing", "billing_due_after_invoice", "due_date", V, "compare", 100, "High", op=">=", other="invoice_date"),
    _r(38, "billing", "billing_amount_positive", "amount_due", V, "sign", 100, "Critical"),
    _r(39, "billing", "billing_paid_not_exceed_due", "amount_paid", V, "compare", 99, "Medium", op="<=", other="amount_due", factor=1.1),
    _r(40, "billing", "billing_balance_consistency", "outstanding_balance", K, "reconciles", 98, "High", minuend="amount_due", subtrahend="amount_paid"),
    _r(41, "billing", "billing_status_valid", "payment_status", V, "allowed", 100, "Critical", values=["Paid", "Partial", "Overdue", "Pending"]),
    _r(42, "billing", "billing_payment_date_logic", "payment_date", K, "implies", 95, "Medium", when="payment_status = 'Paid'", then="payment_date IS NOT NULL"),
    _r(43, "billing", "billing_late_fee_logic", "late_fee", K, "implies", 98, "Low", when="late_fee > 0", then="payment_status IS NULL OR payment_status <> 'Paid'"),
    _r(44, "at_risk_policies", "atrisk_unique_id", "risk_id", U, "unique", 100, "Critical"),
    _r(45, "at_risk_policies", "atrisk_churn_range", "churn_probability", V, "in_range", 100, "Critical", low=0, high=1),
    _r(46, "at_risk_policies", "atrisk_revenue_positive", "revenue_at_risk", V, "sign", 100, "High"),
    _r(47, "at_risk_policies", "atrisk_nps_range", "nps_score", V, "in_range", 100, "Medium", low=-100, high=100),
    _r(48, "at_risk_policies", "atrisk_category_valid", "risk_category", V, "allowed", 100, "High", values=["Churn", "Payment Default", "Underinsured"]),
    _r(49, "at_risk_policies", "atrisk_valid_policy", "policy_id", K, "references", 100, "Critical", parent="policies", parent_key="policy_id"),
    _r(50, "at_risk_policies", "atrisk_snapshot_not_future", "snapshot_date", T, "not_future", 100, "High"),
]
STANDARD_KEYS = {"customers": "customer_id", "agents": "agent_id", "policies": "policy_id", "claims": "claim_id", "billing": "invoice_id", "at_risk_policies": "risk_id"}
