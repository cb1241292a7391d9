"""Column profiles, column health, freshness, catalog and schema drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermetrics.functions.numbers import percent, rounded
from covermetrics.operators.relational import distinct_count

# Ours: status by health score.
HEALTHY_FROM, WARNING_FROM = 90.0, 75.0
DEFAULT = "CURRENT_DEFAULT"  # where Spark keeps a column's default in its metadata
STATUS_RANK = {"Healthy": 0, "Warning": 1, "Critical": 2}


def profile_columns(df: DataFrame, table: str, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Rows, nulls and distinct values per column.

    Exact counts read each column on its own and group its values, so that a row of the shuffle holds one value and no row
    is copied for every column; ``exact=False`` takes HyperLogLog counts from one scan, which shuffle a sketch per column
    and task however many values there are.
    """
    if exact:
        each = [distinct_count(df, c).select(
            F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.col("rows").alias("total"),
            (F.col("rows") - F.col("non_null")).alias("nulls"), F.col("distinct").alias("distinct_count")) for c in columns or df.columns]
        return reduce(DataFrame.unionByName, each)
    cells = [F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("total"),
                      (F.count(F.lit(1)) - F.count(c)).alias("nulls"), F.approx_count_distinct(F.col(c)).alias("distinct_count"))
             for c in columns or df.columns]
    return df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select(F.lit(table).alias("table_name"), "_c.*")


def outlier_counts(df: DataFrame, columns: Sequence[str], z: float = 3.0) -> DataFrame:
    """Values further than z sample deviations from the column mean: moments first, then one pass."""
    moments = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns])).scalar()
    flagged = df.select(*columns, moments.alias("_m"))
    cells = [F.struct(F.lit(c).alias("column_name"), F.count_if(
        F.abs(F.col(c) - F.col("_m")[c]["m"]) > F.col("_m")[c]["s"] * z).alias("outliers")) for c in columns]
    return flagged.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def column_health(df: DataFrame, table: str, columns: Sequence[str], numeric: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Null, duplicate and outlier rates with a health score.

    Ours: 100 less the null and outlier rates, less the duplicate rate for key columns.
    """
    prof = profile_columns(df, table, columns)
    out = prof.join(outlier_counts(df, numeric), "column_name", "left") if numeric else prof.withColumn("outliers", F.lit(None).cast("long"))
    non_null = F.col("total") - F.col("nulls")
    out = out.select(
        "table_name", "column_name", "distinct_count", percent("nulls", "total", 2).alias("null_rate"),
        percent(non_null - F.col("distinct_count"), non_null, 2).alias("duplicate_rate"),
        percent(F.coalesce("outliers", F.lit(0)), "total", 2).alias("outlier_rate"))
    dup = F.when(F.col("column_name").isin(*keys), F.col("duplicate_rate")).otherwise(0.0) if keys else F.lit(0.0)
    health = rounded(F.lit(100.0) - F.col("null_rate") - F.col("outlier_rate") - dup, 2)
    return out.withColumn("health_score", health).withColumn("status", health_status("health_score"))


def health_status(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= HEALTHY_FROM, "Healthy").when(c >= WARNING_FROM, "Warning").otherwise("Critical")


def worst_status(status: Column | str, as_written: bool = False) -> Column:
    """Worst by severity. The as-written form is the alphabetical maximum."""
    s = F.col(status) if isinstance(status, str) else status
    if as_written:
        return F.max(s)
    rank = F.when(s == "Critical", STATUS_RANK["Critical"]).when(s == "Warning", STATUS_RANK["Warning"]).otherwise(STATUS_RANK["Healthy"])
    return F.max_by(s, rank)


def unhealthiest_columns(health: DataFrame, k: int = 15) -> DataFrame:
    return health.groupBy("table_name").agg(
        F.min("health_score").alias("lowest_health"),
        F.min_by("column_name", F.struct("health_score", "column_name")).alias("weakest_column"),
        worst_status("status").alias("worst_status"),
    ).orderBy("lowest_health", "table_name").limit(k)


def freshness_report(sources: Mapping[str, tuple[DataFrame, str]], as_of: str, stale_after: int = 30) -> DataFrame:
    out = None
    for name, (df, column) in sources.items():
        one = df.agg(F.max(F.col(column).cast("date")).alias("latest"), F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("source"), "latest", "rows")
        out = one if out is None else out.unionByName(one)
    age = F.datediff(F.lit(as_of).cast("date"), F.col("latest"))
    return out.withColumn("age_days", age).withColumn("stale", F.coalesce(age > stale_after, F.lit(True)))


def catalog_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def catalog_files(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """table_name, files, bytes, newest: what the tables of a folder take up, from the listing of their files alone.

    A table is a file or a folder of part files; no file is opened.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    inside = F.regexp_extract("path", r"/([^/]+?)\.parquet(?:/.*)?$", 1)
    return listed.select(inside.alias("table_name"), "length", "modificationTime").groupBy("table_name").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))


def schema_rows(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column; the default is the one that CREATE TABLE, ALTER TABLE or ``with_default`` left in the schema."""
    rows = [(t, f.name, i, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get(DEFAULT))
            for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string, nullable boolean, default_value string")


def with_default(df: DataFrame, column: str, default: str | None) -> DataFrame:
    """The frame with a default stated for a column (or none), as SQL text in the schema, where Spark keeps it too."""
    known = {k: v for k, v in (df.schema[column].metadata or {}).items() if k not in (DEFAULT, "EXISTS_DEFAULT")}
    return df.withMetadata(column, known | ({} if default is None else {DEFAULT: default}))


def schema_drift(old: DataFrame, new: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Added, dropped, renamed and retyped columns, and those whose nullability or default changed, between two sets of schema
    rows. Several changes of one column make one row each."""
    if renames:
        table = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
        old = old.withColumn("was", F.col("column_name")).withColumn("column_name", F.coalesce(table[F.col("column_name")], "column_name"))
    else:
        old = old.withColumn("was", F.col("column_name"))
    old, new = (df if "default_value" in df.columns else df.withColumn("default_value", F.lit(None).cast("string")) for df in (old, new))
    a = old.select("table_name", "column_name", "was", F.col("data_type").alias("old_type"), F.col("nullable").alias("old_null"), F.col("default_value").alias("old_default"))
    b = new.select("table_name", "column_name", F.col("data_type").alias("new_type"), F.col("nullable").alias("new_null"), F.col("default_value").alias("new_default"))
    both = a.join(b, ["table_name", "column_name"], "full")
    stays = F.col("old_type").isNotNull() & F.col("new_type").isNotNull()

    def null_word(c: str) -> Column:
        return F.when(F.col(c), "NULLABLE").otherwise("NOT NULL")

    def change(condition: Column, event: str, was: Column, now: Column, severity: str) -> Column:
        return F.when(condition, F.struct(F.lit(event).alias("event_type"), was.alias("old_value"), now.alias("new_value"), F.lit(severity).alias("severity")))
    nothing = F.lit(None).cast("string")
    events = F.array_compact(F.array(
        change(F.col("old_type").isNull(), "COLUMN_ADDED", nothing, F.col("new_type"), "Low"),
        change(F.col("new_type").isNull(), "COLUMN_DROPPED", F.col("old_type"), nothing, "High"),
        change(stays & (F.col("was") != F.col("column_name")), "COLUMN_RENAMED", F.col("was"), F.col("column_name"), "Medium"),
        change(stays & (F.col("old_type") != F.col("new_type")), "TYPE_CHANGED", F.col("old_type"), F.col("new_type"), "Medium"),
        change(stays & (F.col("old_null") != F.col("new_null")), "NULLABILITY_CHANGED", null_word("old_null"), null_word("new_null"), "Low"),
        change(stays & ~F.col("old_default").eqNullSafe(F.col("new_default")), "DEFAULT_CHANGED", F.col("old_default"), F.col("new_default"), "Low")))
    return both.select("table_name", "column_name", F.explode(events).alias("_e")).select("table_name", "column_name", "_e.*")


# The shapes of a small lattice of types; every integer is a number too, every date a timestamp.
SHAPES = {"boolean": r"^(?i:true|false)$", "integer": r"^[+-]?[0-9]+$", "number": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$",
          "date": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$",
          "timestamp": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])([ T]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?)?$"}
# Ours: a column is of the narrowest type that so many percent of its values have.
TYPE_FROM = 75.0


def type_profile(df: DataFrame, columns: Sequence[str], stamp: str, as_of: str) -> DataFrame:
    """column_name, value_type, type_consistency, age_days of each column, from one aggregate over the table.

    Values of text columns are held against every shape of the lattice. The type is the narrowest that at least
    ``TYPE_FROM`` percent of the non-null values have, else text; its consistency is the percentage that has it. Typed
    columns are consistent by themselves. The age is that of the newest row, by the column ``stamp``, that has a value.
    """
    order = [*SHAPES]
    cells = []
    for c in columns:
        is_text = df.schema[c].dataType.typeName() == "string"
        shares = [(percent(F.count_if(F.trim(c).rlike(SHAPES[t])), F.count(c), 2) if is_text else F.lit(None).cast("double")).alias(t) for t in order]
        newest = F.max(F.when(F.col(c).isNotNull(), F.col(stamp).cast("date")))
        cells.append(F.struct(F.lit(c).alias("column_name"), F.lit(None if is_text else df.schema[c].dataType.simpleString()).alias("stated"),
                              *shares, F.datediff(F.lit(as_of).cast("date"), newest).alias("age_days")))
    rows = df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")
    has = {t: F.col(t) >= TYPE_FROM for t in order}
    found = F.coalesce(F.col("stated"), *[F.when(has[t], t) for t in order], F.lit("text"))
    share = F.coalesce(*[F.when(F.col("stated").isNull() & has[t], F.col(t)) for t in order], F.lit(100.0))
    return rows.select("column_name", found.alias("value_type"), share.alias("type_consistency"), "age_days")


def column_health_full(df: DataFrame, table: str, columns: Sequence[str], numeric: Sequence[str], keys: Sequence[str], stamp: str,
                       as_of: str, stale_after: int = 45) -> DataFrame:
    """Column health with type consistency and freshness.

    Ours: the score also loses what is missing from full type consistency, and ten points if no value is as new as
    ``stale_after`` days; a column without values is stale.
    """
    health = column_health(df, table, columns, numeric, keys).join(type_profile(df, columns, stamp, as_of), "column_name")
    stale = F.coalesce(F.col("age_days") > stale_after, F.lit(True))
    score = rounded(F.col("health_score") - (F.lit(100.0) - F.col("type_consistency")) - F.when(stale, 10.0).otherwise(0.0), 2)
    return health.withColumn("is_stale", stale).withColumn("health_score", score).withColumn("status", health_status("health_score")).select(
        *[c for c in health.columns if c not in ("status", "health_score")], "is_stale", "health_score", "status")
