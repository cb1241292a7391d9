"""Masked views and table entitlement by role."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from covermetrics.functions.masking import mask_credit, mask_email, mask_phone

# Schemas a persona may read.
ENTITLEMENTS: Mapping[str, Sequence[str]] = {
    "EXECUTIVE": ("analytics", "external", "documents", "quality"),
    "UNDERWRITER": ("analytics", "external", "documents"),
    "CLAIMS": ("analytics", "documents"),
    "DATA_STEWARD": ("quality",),
}


def masked_customers(customers: DataFrame, role: Column | str) -> DataFrame:
    return customers.withColumns({"email": mask_email("email", role), "phone": mask_phone("phone", role), "credit_score": mask_credit("credit_score", role)})


def entitlement_rows(spark: SparkSession, entitlements: Mapping[str, Sequence[str]] = ENTITLEMENTS) -> DataFrame:
    return spark.createDataFrame([(r, s) for r, schemas in entitlements.items() for s in schemas], "role string, schema_name string")


def visible_tables(catalog: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Catalog rows (with ``schema_name``) each role may see."""
    return catalog.join(entitlements, "schema_name").select("role", *catalog.columns)


__all__ = ["ENTITLEMENTS", "entitlement_rows", "masked_customers", "visible_tables"]
