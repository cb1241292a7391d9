from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from covermetrics.sources.book import ROLES, Book, role_sql

MODULES = ("portfolio", "claims", "servicing", "quality", "series", "geography",
           "external", "semantic", "texts", "changes", "constructs", "streams")


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[Book], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


_PLANS: dict[str, Plan] = {}


def plan(name: str, covers: str, sql: str | None = None, roles: str = ""):
    """Register a query. ``roles`` names the role CTEs the SQL text starts from."""
    def register(fn):
        text = sql
        if text is not None and roles:
            head = role_sql(*roles.split())
            body = text.strip()
            if body.upper().startswith("WITH RECURSIVE "):
                text = f"WITH RECURSIVE {head}, {body[15:]}"
            elif body.upper().startswith("WITH "):
                text = f"WITH {head}, {body[5:]}"
            else:
                text = f"WITH {head} {body}"
        if name in _PLANS:
            raise ValueError(f"duplicate query {name}")
        _PLANS[name] = Plan(name, fn, text, tuple(covers.split()))
        return fn
    return register


def all_plans() -> dict[str, Plan]:
    for module in MODULES:
        importlib.import_module(f"covermetrics.plans.{module}")
    return dict(_PLANS)


# SQL fragments with the rounding rule of covermetrics.functions.numbers.
def sql_round(expr: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,6)), {digits}) AS DOUBLE)"


def sql_ratio(num: str, den: str, digits: int = 4, scale: float = 1.0) -> str:
    return sql_round(f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0.0) * {float(scale)}", digits)


def sql_percent(num: str, den: str, digits: int = 1) -> str:
    return sql_ratio(num, den, digits, 100.0)


def sql_mean(expr: str, digits: int = 2) -> str:
    return sql_ratio(f"SUM({expr})", f"COUNT({expr})", digits)


__all__ = ["Book", "Plan", "ROLES", "all_plans", "plan", "sql_mean", "sql_percent", "sql_ratio", "sql_round"]
