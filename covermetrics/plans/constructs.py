"""Relational constructs and scalar functions, each over whole tables."""

import uuid

from pyspark.sql import functions as F

from covermetrics.functions import dates, numbers, strings
from covermetrics.operators.relational import not_in, number_rows, top_k_per_group
from covermetrics.plans.registry import plan, sql_mean, sql_percent, sql_round
from covermetrics.session import scratch_path, staged
from covermetrics.sources.tables import export_sample_csv, export_tables, work_table


@plan("string_functions", "F1 F2 F3 F4 F5 F6 F7 F9", roles="customers", sql="""
SELECT customer_id, LPAD(CAST(customer_id AS VARCHAR), 3, '0') AS padded, full_name || ' / ' || segment AS joined, SUBSTR(full_name, 1, 4) AS sub, LEFT(segment, 3) AS l, RIGHT(phone, 4) AS r,
REPLACE(full_name, '#', '-') AS replaced, UPPER(email) AS up, LOWER(segment) AS low, TRIM('  ' || segment || ' ') AS trimmed, LENGTH(full_name) AS len, POSITION('@' IN email) AS at_pos,
UPPER(SUBSTR(MD5(CAST(customer_id AS VARCHAR)), 1, 17)) AS vin FROM customers""")
def _(b):
    c = F.col
    return b.customers.select(
        "customer_id", F.lpad(c("customer_id").cast("string"), 3, "0").alias("padded"), F.concat("full_name", F.lit(" / "), "segment").alias("joined"),
        F.substring("full_name", 1, 4).alias("sub"), F.left("segment", F.lit(3)).alias("l"), F.right("phone", F.lit(4)).alias("r"),
        F.replace("full_name", F.lit("#"), F.lit("-")).alias("replaced"), F.upper("email").alias("up"), F.lower("segment").alias("low"),
        F.trim(F.concat(F.lit("  "), "segment", F.lit(" "))).alias("trimmed"), F.length("full_name").cast("long").alias("len"),
        F.locate("@", "email").cast("long").alias("at_pos"), F.upper(strings.short_id("", "customer_id", 17)).alias("vin"))


@plan("formatting_functions", "F11 F12 X7", roles="policies", sql=f"""
SELECT policy_id, CASE WHEN premium >= 1000000 THEN '$' || CAST(CAST({sql_round('CAST(premium AS DOUBLE) / 1000000', 1)} AS DECIMAL(38,1)) AS VARCHAR) || 'M'
 WHEN premium >= 1000 THEN '$' || CAST(CAST({sql_round('CAST(premium AS DOUBLE) / 1000', 1)} AS DECIMAL(38,1)) AS VARCHAR) || 'K' ELSE '$' || CAST(CAST(ROUND(premium, 0) AS BIGINT) AS VARCHAR) END AS short,
 CAST(CAST({sql_round('underwriting_score', 1)} AS DECIMAL(38,1)) AS VARCHAR) || '%' AS pct, CAST(premium AS DOUBLE) AS parsed FROM policies""")
def _(b):
    return b.policies.select("policy_id", numbers.short_currency("premium").alias("short"), numbers.percent_text("underwriting_score").alias("pct"),
                             numbers.money_text_to_number(F.concat(F.lit(" $"), F.format_number("premium", 2))).alias("parsed"))


@plan("date_functions", "F13 F14 F15 F16 F18 F19 F20", roles="policies", sql="""
SELECT policy_id, CAST(DATE_TRUNC('month', effective_date) AS DATE) AS m, CAST(DATE_TRUNC('quarter', effective_date) AS DATE) AS q,
CAST(effective_date + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(effective_date - INTERVAL 1 YEAR AS DATE) AS year_ago, CAST(effective_date + 7 AS DATE) AS week_later,
DATE_DIFF('day', bound_date, effective_date) AS days, DATE_DIFF('month', bound_date, expiration_date) AS months, DATE_DIFF('hour', CAST(bound_date AS TIMESTAMP), CAST(effective_date AS TIMESTAMP)) AS hours,
MAKE_DATE(YEAR(effective_date), 1, 1) AS year_start, YEAR(effective_date) AS y, YEAR(effective_date) || '-Q' || QUARTER(effective_date) AS fq FROM policies""")
def _(b):
    d = F.col("effective_date")
    return b.policies.select(
        "policy_id", dates.month_of(d).alias("m"), dates.quarter_of(d).alias("q"), F.add_months(d, 1).alias("next_month"), F.add_months(d, -12).alias("year_ago"),
        F.date_add(d, 7).alias("week_later"), F.datediff(d, "bound_date").cast("long").alias("days"),
        dates.months_between_boundaries("bound_date", "expiration_date").cast("long").alias("months"), dates.hours_between_boundaries("bound_date", d).alias("hours"),
        F.make_date(F.year(d), F.lit(1), F.lit(1)).alias("year_start"), F.year(d).cast("long").alias("y"), dates.fiscal_quarter_text(d).alias("fq"))


@plan("numeric_functions", "F21 F22 F24 F26 F23", roles="claims", sql="""
SELECT claim_id, line_number, CAST(amount AS DOUBLE) AS amount, CAST(FLOOR(amount / 1000) AS BIGINT) AS f, CAST(CEIL(amount / 1000) AS BIGINT) AS c, CAST(ABS(paid - amount) AS DOUBLE) AS a, MOD(policy_id, 7) AS m,
CASE WHEN resolution_days IS NOT NULL THEN LEAST(resolution_days, 100) END AS capped, CASE WHEN resolution_days IS NOT NULL THEN GREATEST(resolution_days, 100) END AS floored,
CAST('0x' || SUBSTR(MD5(CAST(policy_id AS VARCHAR) || 'b'), 1, 8) AS BIGINT) % 10 AS bucket, CAST(ROUND(amount, 0) AS BIGINT) AS whole FROM claims""")
def _(b):
    return b.claims.select(
        "claim_id", "line_number", F.col("amount").cast("double").alias("amount"), F.floor(F.col("amount") / 1000).cast("long").alias("f"), F.ceil(F.col("amount") / 1000).cast("long").alias("c"),
        F.abs(F.col("paid") - F.col("amount")).cast("double").alias("a"), (F.col("policy_id") % 7).alias("m"),
        numbers.strict_least("resolution_days", F.lit(100)).alias("capped"), numbers.strict_greatest("resolution_days", F.lit(100)).alias("floored"),
        numbers.hash_bucket("policy_id", 10, "b").alias("bucket"), F.round("amount", 0).cast("long").alias("whole"))


@plan("array_functions", "F28 F29 F30 F31 F32", roles="alerts", sql="""
WITH a AS (SELECT alert_id, ['Minor', 'Moderate', 'Severe', 'Extreme'] AS levels, severity, [[1, 2], [3, 4]] AS grid FROM alerts)
SELECT alert_id, levels[1 + alert_id % 5] AS picked, grid[2][1 + alert_id % 2] AS nested, NULLIF(LIST_POSITION(levels, severity), 0) - 1 AS position0,
NULLIF(LIST_POSITION(['Severe', 'Extreme'], severity), 0) - 1 AS missing, CASE severity WHEN 'Severe' THEN 2 WHEN 'Extreme' THEN 3 END AS mapped FROM a""")
def _(b):
    levels = F.array(*[F.lit(x) for x in ("Minor", "Moderate", "Severe", "Extreme")])
    grid = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))
    weights = F.create_map(F.lit("Severe"), F.lit(2), F.lit("Extreme"), F.lit(3))
    return b.alerts.select(
        "alert_id", F.get(levels, (F.col("alert_id") % 5).cast("int")).alias("picked"), F.get(F.get(grid, F.lit(1)), (F.col("alert_id") % 2).cast("int")).alias("nested"),
        numbers.array_position0(levels, F.col("severity")).cast("int").alias("position0"),
        numbers.array_position0(F.array(F.lit("Severe"), F.lit("Extreme")), F.col("severity")).cast("int").alias("missing"), weights[F.col("severity")].alias("mapped"))


@plan("flatten_array", "F31", roles="claims", sql="""
SELECT i AS pos, k AS measure, CAST(SUM(v) AS DOUBLE) AS total FROM (SELECT UNNEST([0, 1, 2]) AS i, UNNEST(['amount', 'paid', 'reserve']) AS k, UNNEST([amount, paid, reserve]) AS v FROM claims) GROUP BY 1, 2""")
def _(b):
    parts = F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in ("amount", "paid", "reserve")])
    return b.claims.select(F.posexplode(parts).alias("pos", "e")).groupBy("pos", F.col("e.k").alias("measure")).agg(F.sum("e.v").cast("double").alias("total"))


@plan("json_functions", "F33 F34 F35 F25", roles="alerts", sql="""
SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(JSON_EXTRACT_STRING(props, '$.k') AS BIGINT)) AS BIGINT) AS total, COUNT(*) FILTER (WHERE TRY_CAST(event_type AS INT) IS NULL) AS not_numbers FROM alerts GROUP BY 1""")
def _(b):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    k = F.try_variant_get(F.try_parse_json(strings.strip_fence(fenced)), "$.k", "bigint")
    return b.alerts.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.count_if(F.col("event_type").try_cast("int").isNull()).alias("not_numbers"))


@plan("predicates", "P5 P6 P7 P8 P9 P10 P11 P12", roles="customers claims", sql="""
SELECT 'between' AS predicate, COUNT(*) AS n FROM claims WHERE fraud_score BETWEEN 20 AND 40 UNION ALL SELECT 'not_between', COUNT(*) FROM claims WHERE fraud_score NOT BETWEEN 20 AND 40
UNION ALL SELECT 'in', COUNT(*) FROM claims WHERE cause IN ('Hail', 'Water') UNION ALL SELECT 'not_in', COUNT(*) FROM claims WHERE cause NOT IN ('Hail') UNION ALL SELECT 'is_null', COUNT(*) FROM claims WHERE friction_reason IS NULL
UNION ALL SELECT 'blank', COUNT(*) FROM claims WHERE TRIM(cause) <> '' UNION ALL SELECT 'like', COUNT(*) FROM claims WHERE friction_reason LIKE '%Delay' UNION ALL SELECT 'not_like', COUNT(*) FROM claims WHERE friction_reason NOT LIKE 'D%'
UNION ALL SELECT 'like_any', COUNT(*) FROM claims WHERE friction_reason LIKE 'D%' OR friction_reason LIKE '%Error' UNION ALL SELECT 'ilike', COUNT(*) FROM claims WHERE friction_reason ILIKE '%DELAY%'
UNION ALL SELECT 'compound', COUNT(*) FROM claims WHERE (cause = 'Hail' OR status = 'Open') AND claim_date >= DATE '2001-12-31' - 365 UNION ALL SELECT 'escaped_like', COUNT(*) FROM claims WHERE cause LIKE '%!_%' ESCAPE '!'""")
def _(b):
    c = F.col
    tests = {
        "between": c("fraud_score").between(20, 40), "not_between": ~c("fraud_score").between(20, 40), "in": c("cause").isin("Hail", "Water"), "not_in": ~c("cause").isin("Hail"),
        "is_null": c("friction_reason").isNull(), "blank": F.trim("cause") != "", "like": c("friction_reason").like("%Delay"), "not_like": ~c("friction_reason").like("D%"),
        "like_any": F.expr("friction_reason LIKE ANY ('D%', '%Error')"), "ilike": c("friction_reason").ilike("%DELAY%"),
        "compound": ((c("cause") == "Hail") | (c("status") == "Open")) & (c("claim_date") >= F.date_sub(F.lit("2001-12-31").cast("date"), 365)),
        "escaped_like": F.expr("cause LIKE '%!_%' ESCAPE '!'"),
    }
    return b.claims.agg(*[F.count_if(cond).alias(n) for n, cond in tests.items()]).unpivot([], list(tests), "predicate", "n")


@plan("date_spine", "S5 S6 J7 J9", roles="claims agents", sql="""
WITH d AS (SELECT CAST(UNNEST(GENERATE_SERIES(DATE '2000-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS DATE) AS month)
SELECT a.agent_id, d.month, COUNT(c.claim_id) AS claims FROM agents a CROSS JOIN d LEFT JOIN claims c ON c.adjuster_id = a.agent_id AND CAST(DATE_TRUNC('month', c.claim_date) AS DATE) = d.month GROUP BY 1, 2""")
def _(b):
    spine = F.sequence(F.lit("2000-01-01").cast("date"), F.lit("2000-12-01").cast("date"), F.expr("interval 1 month"))
    grid = b.agents.select("agent_id", F.explode(spine).alias("month"))
    counts = b.claims.groupBy(F.col("adjuster_id").alias("agent_id"), dates.month_of("claim_date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["agent_id", "month"], "left").select("agent_id", "month", F.coalesce("n", F.lit(0)).alias("claims"))


@plan("sql_view", "S2 S4 P3 P4 A3", roles="policies", sql=f"""
WITH label AS (SELECT * FROM (VALUES ('Active', 'on'), ('Renewed', 'on'), ('Cancelled', 'off')) AS t(status, state)), book AS (SELECT state, premium FROM policies JOIN label USING (status))
SELECT state AS "Book State", COUNT(*) AS policies, {sql_mean('premium', 2)} AS avg_premium FROM book GROUP BY 1""")
def _(b):
    b.policies.createOrReplaceTempView("covermetrics_policies")
    return b.spark.sql("""
        WITH label AS (SELECT * FROM VALUES ('Active', 'on'), ('Renewed', 'on'), ('Cancelled', 'off') AS t(status, state)),
             book AS (SELECT state, premium FROM covermetrics_policies JOIN label USING (status))
        SELECT state AS `Book State`, COUNT(*) AS policies,
               CAST(ROUND(CAST(CAST(SUM(premium) AS DOUBLE) / COUNT(premium) AS DECIMAL(38,6)), 2) AS DOUBLE) AS avg_premium
        FROM book GROUP BY 1""")


@plan("semi_anti_joins", "J13 J14 J15 J17", roles="policies claims customers", sql="""
SELECT 'with_claims' AS kind, COUNT(*) AS policies FROM policies WHERE policy_id IN (SELECT policy_id FROM claims) UNION ALL SELECT 'without_claims', COUNT(*) FROM policies p WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.policy_id = p.policy_id)
UNION ALL SELECT 'not_in_null_aware', COUNT(*) FROM policies WHERE policy_id NOT IN (SELECT CASE WHEN status = 'Open' THEN policy_id ELSE -1 END FROM claims)
UNION ALL SELECT 'not_in_with_null', COUNT(*) FROM policies WHERE policy_id NOT IN (SELECT CASE WHEN status = 'Open' THEN policy_id END FROM claims)
UNION ALL SELECT 'above_mean', COUNT(*) FROM policies WHERE CAST(premium AS DOUBLE) > (SELECT CAST(SUM(premium) AS DOUBLE) / COUNT(*) FROM policies)""")
def _(b):
    p, n = b.policies, F.count(F.lit(1)).alias("policies")
    claimed = b.claims.select("policy_id")
    average = p.agg(F.sum("premium").cast("double") / F.count(F.lit(1))).scalar()
    parts = {"with_claims": p.join(claimed, "policy_id", "left_semi"), "without_claims": p.join(claimed, "policy_id", "left_anti"),
             "not_in_null_aware": not_in(p, b.claims.filter(F.col("status") == "Open").select("policy_id"), "policy_id"),
             "not_in_with_null": not_in(p, b.claims.select(F.when(F.col("status") == "Open", F.col("policy_id")).alias("policy_id")), "policy_id"),
             "above_mean": p.filter(F.col("premium").cast("double") > average)}
    out = None
    for kind, df in parts.items():
        one = df.agg(n).select(F.lit(kind).alias("kind"), "policies")
        out = one if out is None else out.unionByName(one)
    return out


@plan("scalar_lookup", "J16 J8", roles="customers policies", sql=f"""
SELECT customer_id, (SELECT ARG_MAX(policy_type, {{'d': effective_date, 'p': policy_id}}) FROM policies p WHERE p.customer_id = c.customer_id) AS latest_type,
{sql_percent('credit_score', '(SELECT MAX(credit_score) FROM customers)', 2)} AS pct_of_best FROM customers c""")
def _(b):
    latest = b.policies.groupBy("customer_id").agg(F.max_by("policy_type", F.struct("effective_date", "policy_id")).alias("latest_type"))
    best = b.customers.agg(F.max("credit_score")).scalar()
    return b.customers.join(latest, "customer_id", "left").select("customer_id", "latest_type", numbers.percent(F.col("credit_score"), best, 2).alias("pct_of_best"))


@plan("distinct_aggregates", "A4 A5 A6 A12", roles="claims policies", sql="""
SELECT status, COUNT(*) AS n, COUNT(resolution_days) AS resolved, COUNT(DISTINCT adjuster_id) AS adjusters, COUNT(DISTINCT cause) AS causes, CAST(SUM(DISTINCT line_number) AS BIGINT) AS line_sum FROM claims GROUP BY 1""")
def _(b):
    # Few statuses: reduce to one row per status and distinct tuple first, then count.
    tuples = b.claims.groupBy("status", "adjuster_id", "cause", "line_number").agg(F.count(F.lit(1)).alias("n"), F.count("resolution_days").alias("r"))
    return tuples.groupBy("status").agg(
        F.sum("n").alias("n"), F.sum("r").alias("resolved"), F.countDistinct("adjuster_id").alias("adjusters"), F.countDistinct("cause").alias("causes"),
        F.sum_distinct("line_number").cast("long").alias("line_sum"))


@plan("having_clusters", "A13 A2", roles="claims", sql="SELECT adjuster_id, cause, COUNT(*) AS claims FROM claims GROUP BY 1, 2 HAVING COUNT(*) > 210")
def _(b):
    return b.claims.groupBy("adjuster_id", "cause").agg(F.count(F.lit(1)).alias("claims")).filter(F.col("claims") > 210)


@plan("global_row_numbers", "W1 W4 W5", roles="policies", sql="""
SELECT policy_id, ROW_NUMBER() OVER (ORDER BY MD5(CAST(policy_id AS VARCHAR)), policy_id) AS row_no, COUNT(*) OVER () AS total FROM policies""")
def _(b):
    total = b.policies.agg(F.count(F.lit(1))).scalar()
    return number_rows(b.policies.select("policy_id"), "policy_id").withColumn("total", total)


@plan("stable_sample", "L5 L6 W6 F23", roles="policies", sql="""
SELECT policy_id FROM policies WHERE CAST('0x' || SUBSTR(MD5(CAST(policy_id AS VARCHAR) || 's'), 1, 8) AS BIGINT) % 100 < 5 ORDER BY MD5(CAST(policy_id AS VARCHAR)) LIMIT 500""")
def _(b):
    """SAMPLE (5) with a cap, in hash order: the same rows on every run."""
    return b.policies.filter(numbers.hash_bucket("policy_id", 100, "s") < 5).orderBy(F.md5(F.col("policy_id").cast("string"))).limit(500).select("policy_id")


@plan("top_claim_per_policy_type", "L4 W2 L2", roles="claims policies", sql="""
WITH j AS (SELECT policy_type, claim_id, adjuster_id, CAST(amount AS DOUBLE) AS amount FROM claims JOIN policies USING (policy_id))
SELECT *, ROW_NUMBER() OVER (PARTITION BY policy_type ORDER BY amount DESC, claim_id, adjuster_id) AS rank FROM j QUALIFY rank <= 3""")
def _(b):
    joined = b.claims.select("policy_id", "claim_id", "adjuster_id", F.col("amount").cast("double").alias("amount")).join(b.policies.select("policy_id", "policy_type"), "policy_id").drop("policy_id")
    return top_k_per_group(joined, ["policy_type"], [F.desc("amount"), F.col("claim_id"), F.col("adjuster_id")], 3)


@plan("export_roundtrip", "S9 S10 S13 D8", roles="policies claims", sql="""
SELECT 'claims' AS table_name, COUNT(*) AS rows, CAST(SUM(amount) AS DOUBLE) AS money FROM claims UNION ALL SELECT 'policies', COUNT(*), CAST(SUM(premium) AS DOUBLE) FROM policies
UNION ALL SELECT 'sample', 50, (SELECT CAST(SUM(premium) AS DOUBLE) FROM (SELECT premium FROM policies ORDER BY policy_id LIMIT 50))""")
def _(b):
    root = scratch_path(b.spark, "export")
    paths = export_tables({"policies": b.policies, "claims": b.claims}, root)
    csv = export_sample_csv(b.policies.select("policy_id", "premium"), f"{root}/sample.csv", ["policy_id"])
    reads = {"policies": (b.spark.read.parquet(paths["policies"]), "premium"), "claims": (b.spark.read.parquet(paths["claims"]), "amount"),
             "sample": (b.spark.read.schema("policy_id long, premium decimal(18,2)").option("header", True).csv(csv), "premium")}
    out = None
    for name, (df, money) in reads.items():
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(money).cast("double").alias("money")).select(F.lit(name).alias("table_name"), "rows", "money")
        out = one if out is None else out.unionByName(one)
    return out


@plan("work_table", "S13 D8", roles="claims", sql="""
SELECT CAST(DATE_TRUNC('month', claim_date) AS DATE) AS month, COUNT(*) AS claims, CAST(SUM(amount) AS DOUBLE) AS amount FROM claims GROUP BY 1 HAVING COUNT(*) >= (SELECT COUNT(*) / 200 FROM claims)""")
def _(b):
    """A monthly series is kept as a table while it is used twice, and dropped before the result is read."""
    monthly = b.claims.groupBy(F.trunc("claim_date", "month").alias("month")).agg(F.count(F.lit(1)).alias("claims"), F.sum("amount").cast("double").alias("amount"))
    with work_table(monthly, f"work_{uuid.uuid4().hex}") as work:
        total = work.agg(F.sum("claims")).first()[0] or 0
        return staged(work.filter(F.col("claims") >= total / 200), "work-result")


@plan("generated_ids", "F10", roles="policies", sql="SELECT COUNT(*) AS rows, COUNT(*) AS ids, COUNT(*) AS well_formed, COUNT(DISTINCT policy_id) AS policies FROM policies")
def _(b):
    """Every row gets an id of its own; the rows are written once, as another run would draw other ids."""
    keyed = staged(b.policies.select("policy_id", F.expr("uuid()").alias("id")), "ids")
    shape = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return keyed.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.count_if(F.col("id").rlike(shape)).alias("well_formed"),
                     F.count_distinct("policy_id").alias("policies"))


@plan("unseen_files", "U4 S11", roles="filings", sql="""
SELECT document_type, COUNT(*) AS new_files FROM filings WHERE document_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1""")
def _(b):
    seen = b.ratings.select("document_id")
    return b.filings.join(seen, "document_id", "left_anti").groupBy("document_type").agg(F.count(F.lit(1)).alias("new_files"))
