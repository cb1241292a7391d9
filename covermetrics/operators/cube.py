"""A small semantic layer: declare tables, joins and measures once, ask by name.

Joins run from a table to its parents (many to one), so a row never multiplies. Measures
on a child table are summed per join key before they meet the base table. Where the keys
allow, the base table is reduced per foreign key before a join to a parent.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermetrics.functions.numbers import ratio, rounded
from covermetrics.session import staged


@dataclass(frozen=True)
class Parent:
    """``child.child_key`` refers to the unique ``table.key``."""
    table: str
    child_key: str
    key: str


@dataclass(frozen=True)
class Perspective:
    label: str
    expr: str
    via: tuple[Parent, ...] = ()


@dataclass(frozen=True)
class Measure:
    """``kind``: count, sum, avg, min, max or count_distinct. ``child`` names a table whose
    rows refer to the base table by ``child_key``; its column is summed per key first."""
    kind: str
    column: str | None = None
    digits: int = 0
    child: str | None = None
    child_key: str | None = None


@dataclass(frozen=True)
class Domain:
    table: str
    perspectives: Mapping[str, Perspective]
    measures: Mapping[str, Measure]
    where: str | None = None


@dataclass(frozen=True)
class SemanticModel:
    domains: Mapping[str, Domain]
    verified: Mapping[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def query(self, tables: Callable[[str], DataFrame], domain: str, perspectives: Sequence[str],
              measures: Sequence[str], keep_null: bool = False) -> DataFrame:
        d = self.domains[domain]
        dims = [d.perspectives[p] for p in perspectives]
        wanted = {f"m{i}": d.measures[m] for i, m in enumerate(measures)}
        base = tables(d.table)
        if d.where:
            base = base.filter(d.where)
        base, wanted = _attach_children(base, wanted, tables)
        joins: list[Parent] = list(dict.fromkeys(j for p in dims for j in p.via))
        if joins and all(m.kind != "count_distinct" for m in wanted.values()):
            frame, final = _reduced(base, dims, joins, wanted)
        else:
            frame, final = base, {n: _direct(m) for n, m in wanted.items()}
        for j in joins:
            frame = _join(frame, tables(j.table), j)
        keys = [F.expr(p.expr).alias(f"d{i}") for i, p in enumerate(dims)]
        frame = frame.select("*", *keys)
        if not keep_null:
            for i in range(len(dims)):
                frame = frame.filter(F.col(f"d{i}").isNotNull())
        out = frame.groupBy(*[f"d{i}" for i in range(len(dims))]).agg(*[c.alias(n) for n, c in final.items()])
        return out.select(*[F.col(f"d{i}").alias(p.label) for i, p in enumerate(dims)],
                          *[F.col(f"m{i}").cast("double").alias(_name(m)) for i, m in enumerate(measures)])

    def explore(self, tables, domain: str, perspective: str, measure: str, top: int = 50) -> DataFrame:
        """Group by one perspective: label and value, largest first."""
        label = self.domains[domain].perspectives[perspective].label
        out = self.query(tables, domain, [perspective], [measure]).withColumnRenamed(_name(measure), "value")
        return out.orderBy(F.desc_nulls_last("value"), label).limit(top)

    def panel(self, tables, domain: str, perspective: str, measures: Sequence[str], top: int) -> DataFrame:
        label = self.domains[domain].perspectives[perspective].label
        out = self.query(tables, domain, [perspective], measures)
        return out.orderBy(F.desc_nulls_last(_name(measures[0])), label).limit(top)

    def cards(self, tables, domain: str, measures: Sequence[str]) -> DataFrame:
        return self.query(tables, domain, [], measures)

    def crosstab(self, tables, domain: str, rows: str, columns: str, measure: str, values: Sequence[object]) -> DataFrame:
        """Rows by columns, missing cells 0. ``values`` lists the column headings."""
        d = self.domains[domain]
        r, c = d.perspectives[rows].label, d.perspectives[columns].label
        cells = self.query(tables, domain, [rows, columns], [measure])
        return cells.groupBy(r).pivot(c, list(values)).agg(F.first(_name(measure))).fillna(0.0, subset=[str(v) for v in values])

    def correlate(self, tables, a: tuple[str, str, str], b: tuple[str, str, str]) -> DataFrame:
        """Two (domain, perspective, measure) aggregates side by side on a shared label, with
        their correlation over all labels."""
        left, right = (self.query(tables, d, [p], [m]) for d, p, m in (a, b))
        key = self.domains[a[0]].perspectives[a[1]].label
        other = self.domains[b[0]].perspectives[b[1]].label
        left = left.select(key, F.col(_name(a[2])).alias("value_a"))
        right = right.select(F.col(other).alias(key), F.col(_name(b[2])).alias("value_b"))
        both = left.join(right, key)
        return both.withColumn("correlation", rounded(both.agg(F.corr("value_a", "value_b")).scalar(), 4))

    def grouped_once(self, tables, domain: str) -> tuple[DataFrame, dict[str, int], dict[str, Column], list[str]]:
        """The base table reduced in one scan to every grouping that a perspective of the domain needs.

        A perspective needs the base columns that it shows and the foreign keys on its way to parents; perspectives that
        need the same share a grouping set. Returns the reduced rows, the grouping id of each perspective, the final
        aggregates over reduced rows, and the names of the measures that count distinct values.
        """
        d = self.domains[domain]
        base = tables(d.table)
        if d.where:
            base = base.filter(d.where)
        base, wanted = _attach_children(base, {f"m{i}": m for i, m in enumerate(d.measures.values())}, tables)
        distinct = [n for n, m in wanted.items() if m.kind == "count_distinct"]
        sets = {name: _needed(base, p) for name, p in d.perspectives.items()}
        parts, final = _parts({n: m for n, m in wanted.items() if n not in distinct})
        # A counted column is one more column of a set of its own, so that each of its values is there once.
        counted = {n: f"_v_{n}" for n in distinct}
        base = base.withColumns({v: F.col(wanted[n].column) for n, v in counted.items()}) if counted else base
        columns = list(dict.fromkeys([c for s in sets.values() for c in s] + list(counted.values())))
        wide = list(dict.fromkeys(tuple(s) for s in sets.values()))
        all_sets = [list(s) for s in wide] + [[*s, v] for s in wide for v in counted.values()]
        grouped = base.groupingSets([[F.col(c) for c in s] for s in all_sets], *[F.col(c) for c in columns]).agg(
            F.grouping_id().alias("_set"), *[c.alias(n) for n, c in (parts or {"_rows": F.count(F.lit(1))}).items()])
        final |= {n: F.countDistinct(v) for n, v in counted.items()}
        return grouped, {name: _set_id(columns, s) for name, s in sets.items()}, final, [counted[n] for n in distinct]

    def matrix(self, tables, domain: str) -> DataFrame:
        """Every perspective of a domain with every measure, in long form, from one scan of the base table."""
        d = self.domains[domain]
        grouped, ids, final, counted = self.grouped_once(tables, domain)
        stored = staged(grouped, "cube-groups")
        cols, out = [_name(m) for m in d.measures], None
        width = len([c for c in stored.columns if c in counted])
        for name, p in d.perspectives.items():
            # Sets with a counted column have one bit less; a perspective reads its own set and those.
            bits = [ids[name]] + [ids[name] - (1 << i) for i in range(width)]
            frame = stored.filter(F.col("_set").isin(bits))
            if width:  # sets with a counted column repeat the rows, so only the counts may read them
                frame = frame.withColumns({c: F.when(F.col("_set") == ids[name], F.col(c)) for c in stored.columns if _is_part(c)})
            for j in p.via:
                frame = _join(frame, tables(j.table), j)
            wide = frame.withColumn("label", F.expr(p.expr).cast("string")).filter("label IS NOT NULL").groupBy("label").agg(*[c.alias(n) for n, c in final.items()])
            one = wide.select(F.lit(name).alias("perspective"), "label", *[F.col(f"m{i}").cast("double").alias(c) for i, c in enumerate(cols)]) \
                .unpivot(["perspective", "label"], cols, "measure", "value")
            out = one if out is None else out.unionByName(one)
        return out


def _is_part(column: str) -> bool:
    return re.fullmatch(r"m\d+_[csnx]", column) is not None


def _needed(base: DataFrame, p: Perspective) -> list[str]:
    """Base columns that a perspective reads: its own, or the keys to its parents."""
    own = [j.child_key for j in p.via if j.child_key in base.columns]
    return list(dict.fromkeys(own + ([] if p.via else [c for c in base.columns if c in p.expr])))


def _set_id(columns: Sequence[str], members: Sequence[str]) -> int:
    """Spark's grouping id: a bit for each column, the first highest, set where the column is not in the set."""
    return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in members)


def _name(measure: str) -> str:
    return measure.lower().replace(" ", "_")


def _join(frame: DataFrame, parent: DataFrame, j: Parent) -> DataFrame:
    """Parents keep their own column names except those the frame already has."""
    cols = [c for c in parent.columns if c != j.key and c not in frame.columns]
    right = parent.select(F.col(j.key).alias("_pk"), *cols)
    return frame.join(right, F.col(j.child_key) == F.col("_pk")).drop("_pk")


def _attach_children(base: DataFrame, wanted: Mapping[str, Measure], tables) -> tuple[DataFrame, dict[str, Measure]]:
    out = dict(wanted)
    for n, m in wanted.items():
        if m.child:
            per_key = tables(m.child).groupBy(F.col(m.child_key).alias("_ck")).agg(F.sum(m.column).alias(f"_{n}"))
            base = base.join(per_key, F.col(m.child_key) == F.col("_ck"), "left").drop("_ck")
            out[n] = Measure(m.kind, f"_{n}", m.digits)
    return base, out


def _direct(m: Measure) -> Column:
    if m.kind == "count":
        return F.count(F.lit(1))
    if m.kind == "sum":
        return rounded(F.sum(m.column), m.digits)
    if m.kind == "avg":
        return ratio(F.sum(m.column), F.count(m.column), m.digits)
    if m.kind == "count_distinct":
        return F.countDistinct(m.column)
    return {"min": F.min, "max": F.max}[m.kind](m.column)


def _reduced(base: DataFrame, dims: Sequence[Perspective], joins: Sequence[Parent], wanted: Mapping[str, Measure]):
    """Partial aggregate per foreign key (and per base column the perspectives use)."""
    own = [j.child_key for j in joins if j.child_key in base.columns]
    used = [c for c in base.columns if any(c in p.expr for p in dims if not p.via)]
    parts, final = _parts(wanted)
    return base.groupBy(*dict.fromkeys(own + used)).agg(*[c.alias(n) for n, c in parts.items()]), final


def _parts(wanted: Mapping[str, Measure]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Partial aggregates of the measures, and the final ones over them."""
    parts, final = {}, {}
    for n, m in wanted.items():
        if m.kind == "count":
            parts[f"{n}_c"] = F.count(F.lit(1))
            final[n] = F.sum(f"{n}_c")
        elif m.kind == "sum":
            parts[f"{n}_s"] = F.sum(m.column)
            final[n] = rounded(F.sum(f"{n}_s"), m.digits)
        elif m.kind == "avg":
            parts[f"{n}_s"], parts[f"{n}_n"] = F.sum(m.column), F.count(m.column)
            final[n] = ratio(F.sum(f"{n}_s"), F.sum(f"{n}_n"), m.digits)
        else:
            fn = {"min": F.min, "max": F.max}[m.kind]
            parts[f"{n}_x"] = fn(m.column)
            final[n] = fn(f"{n}_x")
    return parts, final


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes per column, one pass, one row per column."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), rounded(F.avg(c), 4).alias("mean_value"),
                      rounded(F.stddev_samp(c), 4).alias("std"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
             for c in columns]
    return df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")
