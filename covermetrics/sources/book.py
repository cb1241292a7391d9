"""Binding of the star-schema tables to insurance roles.

A role is a projection of one base table, written as portable SQL expressions, so
that a filter or column choice on the role reaches the parquet scan unchanged and
the same text can state the role to another SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Reference dates of the data set: last policy year, and the alert feed's end.
AS_OF = "2001-12-31"
ALERTS_AS_OF = "2024-01-31"


# Money marks: <c>…</c> is a stored double that already holds cents, <m>…</m> a computed
# one. Casting a double to decimal prints and reparses it; scaling through a long gives the
# same cents in less than half the time, so Spark gets the second form of each pair.
_MARKS = {
    "<c>": ("CAST(", "CAST(CAST(FLOOR(("), "</c>": (" AS DECIMAL(18,2))", ") * 100 + 0.5D) AS DECIMAL(15,0)) * 0.01BD AS DECIMAL(18,2))"),
    "<m>": ("CAST(CAST(", "CAST(CAST((FLOOR(("),
    "</m>": (" AS DECIMAL(38,6)) AS DECIMAL(18,2))", ") * 1000000 + 0.5D) + 5000) DIV 10000 AS DECIMAL(15,0)) * 0.01BD AS DECIMAL(18,2))"),
}


def _expand(expr: str, for_spark: bool) -> str:
    for mark, forms in _MARKS.items():
        expr = expr.replace(mark, forms[for_spark])
    return expr


def _cents(column: str) -> str:
    return f"<c>{column}</c>"


def _money(expr: str) -> str:
    """Never negative here: the half-cent is rounded up."""
    return f"<m>{expr}</m>"


_CLAIM_DATE = "CAST(l_shipdate AS DATE)"
_PAY = (
    "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'PastDue' "
    "WHEN l_returnflag = 'R' THEN 'Partial' "
    "WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'Pending' ELSE 'Paid' END"
)
# An event's calendar slot inside the policy years (the feed itself spans one month).
_SLOT = "DATE '1995-01-01' + CAST((event_id * 37) % 2500 AS INT)"
_TIERS = "CASE {k} WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END"

ROLES: dict[str, tuple[str, dict[str, str], str | None]] = {
    "states": ("nation", {
        "state_id": "n_nationkey",
        "state": "n_name",
        "region_id": "n_regionkey",
    }, None),
    "regions": ("region", {"region_id": "r_regionkey", "region": "r_name"}, None),
    "customers": ("customer", {
        "customer_id": "c_custkey",
        "full_name": "c_name",
        "state_id": "c_nationkey",
        "segment": "c_mktsegment",
        "balance": _cents("c_acctbal"),
        "credit_score": "CAST(FLOOR(300 + (c_acctbal + 1000) / 20) AS INT)",
        "risk_tier": "CASE WHEN c_acctbal < 0 THEN 'Critical' WHEN c_acctbal < 2500 THEN 'High' "
                     "WHEN c_acctbal < 6000 THEN 'Medium' ELSE 'Low' END",
        "email": "LOWER(REPLACE(c_name, '#', '.')) || '@' || LOWER(c_mktsegment) || '.example.com'",
        "phone": "'(555) ' || LPAD(CAST(c_custkey % 1000 AS VARCHAR(10)), 3, '0') || '-' || "
                 "LPAD(CAST((c_custkey * 7) % 10000 AS VARCHAR(10)), 4, '0')",
        "household_id": "c_nationkey * 100000 + c_custkey % 400",
    }, None),
    "agents": ("supplier", {
        "agent_id": "s_suppkey",
        "agent_name": "s_name",
        "state_id": "s_nationkey",
        "performance_rating": "CAST(CAST(1 + 4 * (s_acctbal + 1000) / 11000 AS DECIMAL(38,6)) AS DECIMAL(3,2))",
        "status": "CASE WHEN s_suppkey % 10 = 9 THEN 'Inactive' ELSE 'Active' END",
        "specialization": "CASE s_suppkey % 4 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Home' WHEN 2 THEN 'Life' ELSE 'Commercial' END",
        "commission_rate": "CAST(CAST((50 + s_suppkey % 100) / 1000 AS DECIMAL(38,6)) AS DECIMAL(4,3))",
        "hire_date": "DATE '1990-01-01' + CAST(s_suppkey % 1500 AS INT)",
        "application_date": "DATE '1990-01-01' + CAST(s_suppkey % 1500 - 5 - s_suppkey % 60 AS INT)",
    }, None),
    "products": ("part", {
        "part_id": "p_partkey",
        "product_name": "p_name",
        "carrier": "p_brand",
        "line": "p_type",
        "list_price": _cents("p_retailprice"),
        "size": "p_size",
    }, None),
    "policies": ("orders", {
        "policy_id": "o_orderkey",
        "customer_id": "o_custkey",
        "policy_type": "o_orderpriority",
        "line_of_business": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Commercial' ELSE 'Personal' END",
        "status": "CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'P' THEN 'Renewed' ELSE 'Cancelled' END",
        "effective_date": "CAST(o_orderdate AS DATE)",
        "expiration_date": "CAST(o_orderdate AS DATE) + 365",
        "bound_date": "CAST(o_orderdate AS DATE) - CAST(o_orderkey % 30 AS INT)",
        "premium": _cents("o_totalprice"),
        "expense": _money("o_totalprice * (12 + o_orderkey % 25) / 100"),
        "coverage": _cents("o_totalprice") + " * 20",
        "deductible": _money("o_totalprice * 0.05"),
        "underwriting_score": "CAST((o_orderkey * 7919) % 101 AS INT)",
    }, None),
    "claims": ("lineitem", {
        "claim_id": "CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(10))",
        "policy_id": "l_orderkey",
        "adjuster_id": "l_suppkey",
        "part_id": "l_partkey",
        "line_number": "l_linenumber",
        "claim_date": _CLAIM_DATE,
        "amount": _cents("l_extendedprice"),
        "paid": _money("l_extendedprice * (1 - l_discount)"),
        "reserve": _money("l_extendedprice * (l_discount + l_tax)"),
        "fraud_score": "l_quantity * 2",
        "cause": "CASE l_returnflag WHEN 'R' THEN 'Hail' WHEN 'A' THEN 'Collision' ELSE 'Water' END",
        "status": "CASE l_linestatus WHEN 'O' THEN 'Open' ELSE 'Closed' END",
        "resolution_days": "CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity * 5 AS INT) END",
        "friction_score": "CAST(l_discount * 100 AS DECIMAL(5,2))",
        "friction_reason": "CASE l_linenumber % 7 WHEN 1 THEN 'Documentation Delay' WHEN 2 THEN 'Adjuster Reassignment' "
                           "WHEN 3 THEN 'Dispute Resolution' WHEN 4 THEN 'Third Party Response' "
                           "WHEN 5 THEN 'System Error' WHEN 6 THEN 'Policy Verification' END",
        "litigation": "l_tax > 0.075",
    }, None),
    "invoices": ("lineitem", {
        "invoice_id": "CAST(l_orderkey AS VARCHAR(20)) || '/' || CAST(l_linenumber AS VARCHAR(10))",
        "policy_id": "l_orderkey",
        "line_number": "l_linenumber",
        "invoice_date": f"{_CLAIM_DATE} - 30",
        "due_date": _CLAIM_DATE,
        "payment_status": _PAY,
        "payment_method": "CASE l_linenumber % 4 WHEN 0 THEN 'ACH' WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'Check' END",
        "amount_due": _cents("l_extendedprice"),
        "amount_paid": _money(f"CASE {_PAY} WHEN 'Paid' THEN l_extendedprice WHEN 'Partial' "
                              "THEN l_extendedprice * (1 - l_discount) ELSE 0 END"),
        "outstanding": _money(f"CASE {_PAY} WHEN 'Paid' THEN 0 WHEN 'Partial' "
                              "THEN l_extendedprice * l_discount ELSE l_extendedprice END"),
        "late_fee": _money(f"CASE WHEN {_PAY} = 'PastDue' THEN l_extendedprice * 0.05 ELSE 0 END"),
        "payment_date": f"CASE WHEN {_PAY} = 'Paid' AND l_linenumber <> 7 THEN {_CLAIM_DATE} - 3 END",
    }, None),
    "alerts": ("events", {
        "alert_id": "event_id",
        "customer_id": "user_id",
        "reported_at": "ts",
        "event_type": "event_type",
        "severity": "CASE WHEN value >= 150 THEN 'Extreme' WHEN value >= 80 THEN 'Severe' "
                    "WHEN value >= 30 THEN 'Moderate' ELSE 'Minor' END",
        "value": _cents("value"),
        "props": "props",
    }, None),
    "disasters": ("events", {
        "disaster_id": "event_id",
        "customer_id": "user_id",
        "begin_date": _SLOT,
        "end_date": f"CASE WHEN event_id % 3 <> 0 THEN {_SLOT} + CAST(event_id % 21 AS INT) END",
        "designated_date": f"{_SLOT} + 2",
    }, "event_type = 'error' AND value >= 120"),
    "flood_losses": ("events", {
        "flood_claim_id": "event_id",
        "customer_id": "user_id",
        "loss_date": _SLOT,
        "building_damage": _cents("value") + " * 1000",
    }, "event_type = 'purchase'"),
    "attribute_history": ("events", {
        "history_id": "event_id",
        "customer_id": "user_id",
        "attribute_name": "CASE WHEN event_type = 'signup' THEN 'SEGMENT' ELSE 'RISK_TIER' END",
        "old_value": _TIERS.format(k="event_id % 4"),
        "new_value": _TIERS.format(k="(event_id * 5 + 1) % 4"),
        "change_date": _SLOT,
    }, None),
    "filings": ("documents", {
        "document_id": "doc_id",
        "content": "text",
        "language": "lang",
        "document_type": "source",
        "chars": "n_chars",
    }, None),
    "questions": ("benchmark", {"question_id": "item_id", "question": "text"}, None),
    "turns": ("conversations", {
        "conversation_id": "conv_id", "turn": "turn", "role": "role", "comment": "text",
    }, None),
    "ratings": ("labels", {
        "document_id": "doc_id",
        "nps_rating": "CAST(CASE WHEN quality = 1 AND toxic = 0 THEN 7 + doc_id % 4 "
                      "WHEN quality = 1 THEN 4 + doc_id % 5 ELSE doc_id % 7 END AS INT)",
        "satisfaction": "CAST(1 + quality * 2 + (1 - toxic) + (doc_id % 10) / 10 AS DECIMAL(3,1))",
    }, None),
    "vectors": ("embeddings", {"vector_id": "vec_id", "label": "label", "vector": "embedding"}, None),
}


class Book:
    """The tables of one data folder, by base name or by role."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def role(self, name: str) -> DataFrame:
        table, columns, where = ROLES[name]
        df = self.base(table)
        if where:
            df = df.filter(where)
        return df.selectExpr(*role_expressions(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in ROLES:
            return self.role(name)
        raise AttributeError(name)


def role_expressions(name: str) -> list[str]:
    return [f"{_expand(expr, for_spark=True)} AS {alias}" for alias, expr in ROLES[name][1].items()]


def role_sql(*names: str) -> str:
    """The roles as common table expressions for a plain SQL engine."""
    parts = []
    for name in names:
        table, columns, where = ROLES[name]
        cols = ", ".join(f"{_expand(expr, for_spark=False)} AS {alias}" for alias, expr in columns.items())
        parts.append(f"{name} AS (SELECT {cols} FROM {table}{' WHERE ' + where if where else ''})")
    return ", ".join(parts)
