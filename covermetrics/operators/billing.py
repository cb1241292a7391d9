"""Invoices: balances, delinquency, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.functions.dates import month_of
from covermetrics.functions.numbers import percent, ratio, rounded

# 'Overdue' was renamed 'PastDue' on the way; reports must see both spellings.
STATUS_SYNONYMS = {"Overdue": ("Overdue", "PastDue")}


def status_is(column: Column | str, *names: str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    spellings = [s for n in names for s in STATUS_SYNONYMS.get(n, (n,))]
    return c.isin(*spellings)


def billing_summary(invoices: DataFrame, by: str = "payment_status") -> DataFrame:
    return invoices.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("invoices"),
        rounded(F.sum("outstanding"), 2).alias("total_outstanding"),
        rounded(F.sum("late_fee"), 2).alias("total_late_fees"),
    )


def delinquency_by_month(invoices: DataFrame, months: int = 12) -> DataFrame:
    """Overdue share per invoice month, latest ``months`` months with invoices."""
    late = F.count_if(status_is("payment_status", "Overdue"))
    return (
        invoices.groupBy(month_of("invoice_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("invoices"), late.alias("overdue"), percent(late, F.count(F.lit(1)), 2).alias("overdue_pct"))
        .orderBy(F.desc("month")).limit(months)
    )


def outstanding_receivables(invoices: DataFrame) -> DataFrame:
    late = invoices.filter(status_is("payment_status", "Overdue"))
    return late.agg(
        F.count(F.lit(1)).alias("invoices"),
        rounded(F.sum("outstanding"), 2).alias("outstanding"),
        ratio(F.sum("outstanding"), F.count(F.lit(1)), 2).alias("mean_outstanding"),
    )


def payment_reconciliation(invoices: DataFrame, by: Sequence[str] = ("payment_status",), tolerance: float = 0.01) -> DataFrame:
    """Invoices whose balance is not due minus paid, and how much of the due was paid."""
    gap = F.abs(F.col("outstanding") - (F.col("amount_due") - F.col("amount_paid")))
    share = F.col("amount_paid") / F.nullif(F.col("amount_due"), F.lit(0).cast("decimal(18,2)"))
    pattern = F.when(share >= 1, "full").when(share > 0, "partial").otherwise("none")
    return invoices.groupBy(*by, pattern.alias("payment_pattern")).agg(
        F.count(F.lit(1)).alias("invoices"),
        F.count_if(gap > F.lit(tolerance).cast("decimal(18,2)")).alias("mismatched"),
        rounded(F.sum("amount_due"), 2).alias("due"),
        rounded(F.sum("amount_paid"), 2).alias("paid"),
    )
