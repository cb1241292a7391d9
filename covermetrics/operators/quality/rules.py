"""Declarative rules, run with one scan per table however many rules it has.

A rule counts failing rows. As in SQL, a comparison with NULL is not a failure, except
for ``not_null``, ``unique`` and ``references`` (a missing key matches no parent).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.functions.numbers import percent
from covermetrics.operators.relational import top_k_per_group


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    table: str
    column: str
    dimension: str
    template: str
    threshold: float = 100.0
    severity: str = "High"
    args: Mapping[str, object] = field(default_factory=dict)


def _not_null(r: Rule, as_of: str) -> Column:
    return F.col(r.column).isNull()


def _matches(r: Rule, as_of: str) -> Column:
    return ~F.col(r.column).like(r.args["like"])


def _in_range(r: Rule, as_of: str) -> Column:
    return ~F.col(r.column).between(r.args["low"], r.args["high"])


def _length(r: Rule, as_of: str) -> Column:
    return F.length(r.column) != r.args["n"]


def _date_range(r: Rule, as_of: str) -> Column:
    c = F.col(r.column).cast("date")
    return (c < F.lit(r.args["low"]).cast("date")) | (c > F.lit(r.args["high"]).cast("date"))


def _allowed(r: Rule, as_of: str) -> Column:
    return ~F.col(r.column).isin(*r.args["values"])


def _not_future(r: Rule, as_of: str) -> Column:
    return F.col(r.column).cast("date") > F.lit(as_of).cast("date")


def _sign(r: Rule, as_of: str) -> Column:
    return F.col(r.column) < 0 if r.args.get("zero_ok") else F.col(r.column) <= 0


_COMPARE = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def _compare(r: Rule, as_of: str) -> Column:
    other = F.col(r.args["other"])
    factor = r.args.get("factor")
    return ~_COMPARE[r.args["op"]](F.col(r.column), other * F.lit(factor) if factor is not None else other)


def _implies(r: Rule, as_of: str) -> Column:
    return F.expr(r.args["when"]) & ~F.coalesce(F.expr(r.args["then"]), F.lit(False))


def _reconciles(r: Rule, as_of: str) -> Column:
    gap = F.col(r.column) - (F.col(r.args["minuend"]) - F.col(r.args["subtrahend"]))
    return F.abs(gap) > F.lit(r.args.get("tolerance", 0.01))


ROW_TEMPLATES = {
    "not_null": _not_null, "matches": _matches, "in_range": _in_range, "length": _length, "date_range": _date_range,
    "allowed": _allowed, "not_future": _not_future, "sign": _sign, "compare": _compare, "implies": _implies,
    "reconciles": _reconciles,
}
TABLE_TEMPLATES = ("unique", "references", "fresh")


def run_rules(rules: Sequence[Rule], tables: Mapping[str, DataFrame], keys: Mapping[str, str], as_of: str,
              slice_by: Mapping[str, Column] | None = None) -> DataFrame:
    """One result row per rule, or per rule and ``slice_by[table]`` value (say, a month).

    ``keys`` names each table's id column; the least and greatest failing ids are the
    error sample.
    """
    slice_by = slice_by or {}
    parts: list[DataFrame] = []
    for table in dict.fromkeys(r.table for r in rules):
        mine = [r for r in rules if r.table == table]
        df = tables[table].withColumn("run_date", slice_by.get(table, F.lit(as_of).cast("date")))
        fused = [r for r in mine if r.template in ROW_TEMPLATES or r.template == "fresh"]
        if fused:
            parts.append(_run_fused(df, fused, keys[table], as_of))
        parts += [_run_unique(df, r) for r in mine if r.template == "unique"]
        parts += [_run_references(df, r, tables) for r in mine if r.template == "references"]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return _with_status(out)


def _about(r: Rule) -> list[Column]:
    return [F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.table).alias("target_table"),
            F.lit(r.dimension).alias("rule_type"), F.lit(r.severity).alias("severity"), F.lit(float(r.threshold)).alias("threshold"),
            F.lit(r.template == "fresh").alias("whole")]


ABOUT = ("rule_id", "rule_name", "target_table", "rule_type", "severity", "threshold", "whole")
COUNTS = ("run_date", "total_records", "failed_records", "error_sample")


def _run_fused(df: DataFrame, rules: Sequence[Rule], key: str, as_of: str) -> DataFrame:
    cells = []
    for r in rules:
        if r.template == "fresh":
            stale = F.max(F.col(r.column).cast("date")) < F.date_sub(F.lit(as_of).cast("date"), r.args["days"])
            failed, sample = F.when(stale, F.lit(1)).otherwise(F.lit(0)).cast("long"), F.array().cast("array<string>")
        else:
            bad = F.coalesce(ROW_TEMPLATES[r.template](r, as_of), F.lit(False))
            failed = F.count_if(bad)
            ids = F.when(bad, F.col(key))
            sample = F.array_distinct(F.array_compact(F.array(F.min(ids).cast("string"), F.max(ids).cast("string"))))
        cells.append(F.struct(*_about(r), failed.alias("failed_records"), sample.alias("error_sample")))
    return (
        df.groupBy("run_date").agg(F.count(F.lit(1)).alias("total_records"), F.array(*cells).alias("_cells"))
        .select("run_date", "total_records", F.explode("_cells").alias("_c"))
        .select(*[f"_c.{c}" for c in ABOUT], "run_date", "total_records", "_c.failed_records", "_c.error_sample")
    )


def _run_unique(df: DataFrame, r: Rule) -> DataFrame:
    """Surplus rows per value, first per value (map-side combined), then over values."""
    per_value = df.groupBy("run_date", F.col(r.column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = F.when((F.col("_n") > 1) & F.col("_v").isNotNull(), F.col("_v").cast("string"))
    return per_value.groupBy("run_date").agg(
        F.sum("_n").alias("total_records"), (F.sum("_n") - F.count("_v")).alias("failed_records"),
        F.array_distinct(F.array_compact(F.array(F.min(repeated), F.max(repeated)))).alias("error_sample"),
    ).select(*_about(r), *COUNTS)


def _run_references(df: DataFrame, r: Rule, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Child rows are counted per key before they meet the parent, so a hot key is one row."""
    per_key = df.groupBy("run_date", F.col(r.column).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    parent = tables[r.args["parent"]].select(F.col(r.args["parent_key"]).alias("_k")).distinct().withColumn("_found", F.lit(True))
    joined = per_key.join(parent, "_k", "left")
    orphan = F.when(F.col("_found").isNull(), F.col("_k").cast("string"))
    return joined.groupBy("run_date").agg(
        F.sum("_n").alias("total_records"),
        F.coalesce(F.sum(F.when(F.col("_found").isNull(), F.col("_n"))), F.lit(0)).alias("failed_records"),
        F.array_distinct(F.array_compact(F.array(F.min(orphan), F.max(orphan)))).alias("error_sample"),
    ).select(*_about(r), *COUNTS)


def error_ids(rules: Sequence[Rule], tables: Mapping[str, DataFrame], keys: Mapping[str, str], as_of: str, size: int = 20) -> DataFrame:
    """rule_id, failing_id, rank: up to ``size`` failing ids of each rule, in digest order, so a fair and stable sample.

    Row rules of a table share one scan, in which a row comes out once for each rule that it fails; ``size`` ids per rule and
    task survive it. A uniqueness rule names the repeated values, a reference rule the values without a parent; a freshness
    rule fails as a whole and names none.
    """
    parts = []
    for table in dict.fromkeys(r.table for r in rules):
        mine, df = [r for r in rules if r.table == table], tables[table]
        fused = [r for r in mine if r.template in ROW_TEMPLATES]
        if fused:
            failed = F.array_compact(F.array(*[F.when(F.coalesce(ROW_TEMPLATES[r.template](r, as_of), F.lit(False)), F.lit(r.rule_id)) for r in fused]))
            parts.append(df.select(F.explode(failed).alias("rule_id"), F.col(keys[table]).cast("string").alias("failing_id")))
        for r in mine:
            values = df.groupBy(F.col(r.column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter("_v IS NOT NULL") if r.template in ("unique", "references") else None
            if r.template == "unique":
                parts.append(values.filter("_n > 1").select(F.lit(r.rule_id).alias("rule_id"), F.col("_v").cast("string").alias("failing_id")))
            elif r.template == "references":
                parent = tables[r.args["parent"]].select(F.col(r.args["parent_key"]).alias("_v"))
                parts.append(values.join(parent, "_v", "left_anti").select(F.lit(r.rule_id).alias("rule_id"), F.col("_v").cast("string").alias("failing_id")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return top_k_per_group(out, ["rule_id"], [F.md5("failing_id"), F.col("failing_id")], size)


def _with_status(results: DataFrame) -> DataFrame:
    """Pass at or above the threshold; Warning within one point below it (ours); else Fail.

    A freshness rule fails as a whole: its single failure means 0 %, not one row's share.
    """
    passed = F.col("total_records") - F.col("failed_records")
    whole = F.when(F.col("failed_records") > 0, F.lit(0.0)).otherwise(F.lit(100.0))
    out = results.withColumns({"passed_records": passed, "pass_rate": F.when(F.col("whole"), whole).otherwise(percent(passed, "total_records", 2))})
    status = F.when(F.col("pass_rate") >= F.col("threshold"), "Pass").when(F.col("pass_rate") >= F.col("threshold") - 1, "Warning").otherwise("Fail")
    return out.select("rule_id", "rule_name", "run_date", "target_table", "rule_type", "severity", "total_records", "passed_records",
                      "failed_records", "pass_rate", status.alias("status"), "error_sample")


def rules_frame(spark, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.rule_id, r.name, r.table, r.column, r.dimension, r.template, float(r.threshold), r.severity, True) for r in rules]
    return spark.createDataFrame(
        rows, "rule_id string, rule_name string, target_table string, target_column string, rule_type string, "
              "template string, threshold double, severity string, is_active boolean")
