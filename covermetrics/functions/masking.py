"""Role-dependent column masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from covermetrics.functions.numbers import as_col

# Roles that see each kind of column in clear.
CONTACT_ROLES = ("ACCOUNTADMIN", "EXECUTIVE")
CREDIT_ROLES = ("ACCOUNTADMIN", "EXECUTIVE", "UNDERWRITER")


def _unless(role: Column | str, allowed, clear: Column, hidden: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.when(role.isin(*allowed), clear).otherwise(hidden)


def mask_email(c: Column | str, role: Column | str) -> Column:
    c = as_col(c)
    return _unless(role, CONTACT_ROLES, c, F.regexp_replace(c, r"(^[^@]{2})[^@]*(@.*)", "$1****$2"))


def mask_phone(c: Column | str, role: Column | str) -> Column:
    c = as_col(c)
    return _unless(role, CONTACT_ROLES, c, F.concat(F.lit("(***) ***-"), F.right(c, F.lit(4))))


def mask_credit(c: Column | str, role: Column | str) -> Column:
    c = as_col(c)
    return _unless(role, CREDIT_ROLES, c, F.lit(None))
