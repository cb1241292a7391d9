"""Document, retrieval, intake, matching and feedback queries."""

from pyspark.sql import functions as F

from covermetrics.operators import documents as doc
from covermetrics.operators import feedback, intake, matching, search
from covermetrics.operators.vector_index import VectorIndex
from covermetrics.plans.registry import plan, sql_mean, sql_percent, sql_ratio, sql_round
from covermetrics.session import scratch_path
from covermetrics.sources.book import AS_OF

WORD = r"[\p{L}\p{N}]+"
DOC_WORDS = f"doc_words AS (SELECT document_id, language, document_type, UNNEST(REGEXP_EXTRACT_ALL(LOWER(content), '{WORD}')) AS term FROM filings)"
TURN_WORDS = f"turn_words AS (SELECT conversation_id, turn, UNNEST(REGEXP_EXTRACT_ALL(LOWER(comment), '{WORD}')) AS term FROM turns)"

WINDOWS = """windows AS (SELECT document_id, content, i AS chunk_index, LENGTH(content) AS n,
  CAST(LENGTH(content) * CASE i WHEN 1 THEN 0 WHEN 2 THEN 15 WHEN 3 THEN 30 WHEN 4 THEN 50 WHEN 5 THEN 70 ELSE 85 END // 100 AS INT) AS o
  FROM filings, (SELECT UNNEST(RANGE(1, 7)) AS i)),
chunks AS (SELECT document_id, CAST(chunk_index AS INT) AS chunk_index,
  SUBSTR(content, CASE WHEN chunk_index = 1 THEN 1 ELSE GREATEST(1, o) END, CASE WHEN chunk_index = 1 THEN LEAST(600, n) ELSE LEAST(600, n - o + 1) END) AS chunk_text,
  CAST(CEIL(CASE WHEN chunk_index = 1 THEN LEAST(600, n) ELSE LEAST(600, n - o + 1) END / 4.0) AS INT) AS token_count FROM windows)"""
FIXED = """fixed AS (SELECT document_id, k + 1 AS chunk_index, SUBSTR(content, k * 1800 + 1, 2000) AS chunk_text FROM (
  SELECT document_id, content, UNNEST(RANGE(0, 1 + CAST(CASE WHEN LENGTH(content) <= 2000 THEN 0 ELSE CEIL((LENGTH(content) - 2000) / 1800.0) END AS INT))) AS k FROM filings WHERE LENGTH(content) > 0))"""


@plan("chunk_windows", "R1 R3 T14", roles="filings", sql=f"WITH {WINDOWS} SELECT * FROM chunks")
def _(b):
    return doc.chunk_windows(b.filings)


@plan("chunk_fixed", "R2 R3", roles="filings", sql=f"""
WITH {FIXED} SELECT document_id, CAST(chunk_index AS INT) AS chunk_index, chunk_text, CAST(CEIL(LENGTH(chunk_text) / 4.0) AS INT) AS token_count FROM fixed""")
def _(b):
    return doc.chunk_fixed(b.filings)


@plan("keyword_search", "R4 P11 L7", roles="filings", sql=f"""
WITH {FIXED}, best AS (SELECT document_id, chunk_index, SUBSTR(chunk_text, 1, 1000) AS relevant_text FROM fixed WHERE chunk_text ILIKE '%ention%' AND chunk_text ILIKE '%re%' ORDER BY 1, 2 LIMIT 10)
SELECT document_id, CAST(chunk_index AS INT) AS chunk_index, relevant_text, language, document_type, chars FROM best JOIN filings USING (document_id)""")
def _(b):
    return doc.keyword_search(b.filings, doc.chunk_fixed(b.filings), "ention re")


@plan("clause_count", "R8 A8", roles="filings", sql="""
SELECT language, COUNT(*) AS documents, COUNT(*) FILTER (WHERE content ILIKE '%tion%') AS mentions_tion, COUNT(*) FILTER (WHERE content ILIKE '%license%') AS mentions_license FROM filings GROUP BY 1""")
def _(b):
    return doc.clause_count(b.filings, ["tion", "license"], "language")


@plan("document_stats", "R7", roles="filings", sql=f"""
WITH {WINDOWS} SELECT document_type, COUNT(DISTINCT document_id) AS documents, COUNT(*) AS chunks, {sql_ratio('SUM(token_count)', 'COUNT(*)', 0)} AS avg_tokens
FROM chunks JOIN (SELECT document_id, document_type FROM filings) USING (document_id) GROUP BY 1""")
def _(b):
    return doc.document_stats(b.filings, doc.chunk_windows(b.filings), "document_type")


@plan("document_stats_whole", "R7", roles="filings", sql=f"""
WITH {FIXED} SELECT document_type, COUNT(DISTINCT document_id) AS documents, COUNT(chunk_index) AS chunks, {sql_ratio('SUM(CEIL(LENGTH(chunk_text) / 4.0))', 'COUNT(chunk_index)', 0)} AS avg_tokens
FROM (SELECT document_id, document_type FROM filings) LEFT JOIN fixed USING (document_id) GROUP BY 1""")
def _(b):
    return doc.document_stats(b.filings, doc.chunk_fixed(b.filings), "document_type")


MODELS = "CASE WHEN language = 'en' THEN 'english-768' ELSE 'multilingual-1024' END"


@plan("chunk_previews", "R7 R2", roles="filings", sql=f"""
WITH {FIXED} SELECT 'CHK-' || document_id || '-' || LPAD(CAST(chunk_index AS VARCHAR), 4, '0') AS chunk_id, document_id, CAST(chunk_index AS INT) AS chunk_index, LEFT(chunk_text, 150) AS chunk_preview,
CAST(CEIL(LENGTH(chunk_text) / 4.0) AS INT) AS token_count, {MODELS} AS embedding_model FROM fixed JOIN filings USING (document_id)""")
def _(b):
    return doc.chunk_catalogue(doc.chunk_fixed(b.filings), b.filings, F.expr(MODELS))


@plan("embedding_stats", "R7", roles="filings", sql=f"""
WITH {FIXED} SELECT {MODELS} AS embedding_model, COUNT(*) AS chunks, COUNT(DISTINCT document_id) AS documents, {sql_mean('CAST(CEIL(LENGTH(chunk_text) / 4.0) AS INT)', 0)} AS avg_tokens
FROM fixed JOIN filings USING (document_id) GROUP BY 1""")
def _(b):
    return doc.embedding_stats(doc.chunk_catalogue(doc.chunk_fixed(b.filings), b.filings, F.expr(MODELS)))


@plan("document_previews", "R7 L7", roles="filings", sql="""
SELECT document_id, language, document_type, chars, LEFT(content, 200) AS content_preview FROM filings ORDER BY document_id LIMIT 10""")
def _(b):
    return doc.document_previews(b.filings)


@plan("bm25_topk", "R5", roles="filings questions", sql=f"""
WITH {DOC_WORDS}, q AS (SELECT DISTINCT question_id, UNNEST(REGEXP_EXTRACT_ALL(LOWER(question), '{WORD}')) AS term FROM questions),
dl AS (SELECT document_id, COUNT(*) AS dl FROM doc_words GROUP BY 1), st AS (SELECT CAST((SELECT COUNT(*) FROM filings) AS DOUBLE) AS n, CAST(SUM(dl) AS DOUBLE) AS total FROM dl),
tf AS (SELECT document_id, term, COUNT(*) AS tf FROM doc_words WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, LN(1 + (n - df + 0.5) / (df + 0.5)) AS idf, total / n AS avgdl FROM (SELECT term, CAST(COUNT(*) AS DOUBLE) AS df FROM tf GROUP BY 1), st),
s AS (SELECT question_id, document_id, {sql_round('SUM(idf * (tf * CAST(2.2 AS DOUBLE)) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl)))', 5)} AS score
FROM q JOIN w USING (term) JOIN tf USING (term) JOIN dl USING (document_id) GROUP BY 1, 2)
SELECT question_id, document_id, score, ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY score DESC, document_id) AS rank FROM s QUALIFY rank <= 5""")
def _(b):
    return search.ranked_search(b.filings, b.questions)


CHUNK_RANKS = f"""{FIXED}, cw AS (SELECT document_id, chunk_index, UNNEST(REGEXP_EXTRACT_ALL(LOWER(chunk_text), '{WORD}')) AS term FROM fixed),
q AS (SELECT DISTINCT question_id, UNNEST(REGEXP_EXTRACT_ALL(LOWER(question), '{WORD}')) AS term FROM questions),
dl AS (SELECT document_id, chunk_index, COUNT(*) AS dl FROM cw GROUP BY 1, 2), st AS (SELECT CAST((SELECT COUNT(*) FROM fixed) AS DOUBLE) AS n, CAST(SUM(dl) AS DOUBLE) AS total FROM dl),
tf AS (SELECT document_id, chunk_index, term, COUNT(*) AS tf FROM cw WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
w AS (SELECT term, LN(1 + (n - df + 0.5) / (df + 0.5)) AS idf, total / n AS avgdl FROM (SELECT term, CAST(COUNT(*) AS DOUBLE) AS df FROM tf GROUP BY 1), st),
s AS (SELECT question_id, document_id, chunk_index, {sql_round('SUM(idf * (tf * CAST(2.2 AS DOUBLE)) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl)))', 5)} AS score
FROM q JOIN w USING (term) JOIN tf USING (term) JOIN dl USING (document_id, chunk_index) GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY score DESC, document_id, chunk_index) AS rank FROM s QUALIFY rank <= 5)"""


@plan("chunk_search", "R5 R2", roles="filings questions", sql=f"""
WITH {CHUNK_RANKS}
SELECT question_id, r.document_id, CAST(r.chunk_index AS INT) AS chunk_index, score, rank, language, document_type FROM r JOIN filings USING (document_id)""")
def _(b):
    """Chunks, not whole documents, ranked; each with its document's attributes."""
    best = search.ranked_search(doc.chunk_fixed(b.filings), b.questions, key=["document_id", "chunk_index"], text="chunk_text")
    return best.join(b.filings.select("document_id", "language", "document_type"), "document_id")


@plan("vector_topk", "R6", roles="vectors", sql=f"""
WITH e AS (SELECT label, GENERATE_SUBSCRIPTS(vector, 1) AS i, CAST(UNNEST(vector) AS DOUBLE) AS x FROM vectors),
c AS (SELECT label AS query_id, LIST(m ORDER BY i) AS qv FROM (SELECT label, i, AVG(x) AS m FROM e GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT query_id, vector_id, {sql_round('LIST_COSINE_SIMILARITY(CAST(vector AS DOUBLE[]), qv)', 6)} AS score FROM vectors, c)
SELECT query_id, vector_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank FROM s QUALIFY rank <= 5""")
def _(b):
    parts = b.vectors.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One mean per label and dimension: the list below has the vector's fixed length.
    centre = parts.groupBy(F.col("label").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
    return doc.vector_search(b.vectors, centre.select("query_id", F.col("p.m").alias("query_vector")))


@plan("vector_neighbours", "R6", roles="vectors", sql=f"""
WITH u AS (SELECT vector_id, CAST(vector AS DOUBLE[]) AS v FROM vectors),
s AS (SELECT a.vector_id AS query_id, b.vector_id, {sql_round('LIST_COSINE_SIMILARITY(b.v, a.v)', 6)} AS score FROM u a, u b)
SELECT query_id, vector_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank FROM s QUALIFY rank <= 3""")
def _(b):
    """Every vector against all vectors, from a stored index of cells."""
    index = VectorIndex(scratch_path(b.spark, "vector-index")).build(b.vectors)
    return index.search(b.vectors.select(F.col("vector_id").alias("query_id"), F.col("vector").alias("query_vector")), 3)


@plan("retrieval_log_stats", "R9", roles="alerts", sql=f"""
WITH l AS (SELECT event_type AS source, CASE customer_id % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'executive' ELSE 'underwriter' END AS role,
CAST(reported_at AS DATE) AS day, CAST(value * 100 AS BIGINT) AS response_ms, CAST((alert_id % 1000) / 1000 AS DECIMAL(9,3)) AS relevance FROM alerts),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, role, day ORDER BY response_ms) AS i, COUNT(*) OVER (PARTITION BY source, role, day) AS n FROM l)
SELECT source, role, day, COUNT(*) AS queries, {sql_mean('response_ms', 1)} AS avg_ms, CAST(MAX(response_ms) FILTER (WHERE i = CEIL(n * 0.95)) AS DOUBLE) AS p95_ms, {sql_mean('relevance', 3)} AS avg_relevance
FROM r GROUP BY 1, 2, 3""")
def _(b):
    log = b.alerts.select(F.col("event_type").alias("source"),
                          F.when(F.col("customer_id") % 3 == 0, "agent").when(F.col("customer_id") % 3 == 1, "executive").otherwise("underwriter").alias("role"),
                          F.col("reported_at").cast("date").alias("day"), (F.col("value") * 100).cast("long").alias("response_ms"), ((F.col("alert_id") % 1000) / 1000).cast("decimal(9,3)").alias("relevance"))
    return doc.retrieval_log_stats(log, ["source", "role", "day"])


def policy_documents(b):
    return b.filings.select("document_id", "document_type", (F.col("document_id") * 3).alias("policy_id"),
                            F.date_add(F.lit("2000-01-01").cast("date"), (F.col("document_id") % 1000).cast("int")).alias("effective_date"))


@plan("document_master", "R16 J16", roles="filings policies customers", sql="""
WITH d AS (SELECT document_id, document_type, document_id * 3 AS policy_id, DATE '2000-01-01' + CAST(document_id % 1000 AS INT) AS effective_date FROM filings),
h AS (SELECT *, CAST('0x' || SUBSTR(MD5(document_id || 'ss'), 1, 8) AS BIGINT) AS ss, CAST('0x' || SUBSTR(MD5(document_id || 'ra'), 1, 8) AS BIGINT) AS ra,
      CAST('0x' || SUBSTR(MD5(document_id || 'fm'), 1, 8) AS BIGINT) AS fm FROM d)
SELECT document_id, h.policy_id, document_type, h.effective_date, CASE ss % 3 WHEN 0 THEN 'PolicyAdmin' WHEN 1 THEN 'DocGen' ELSE 'Legacy' END AS source_system,
  COALESCE(c.state_id, 4) AS filing_state_id, h.effective_date - CAST(30 + ra % 150 AS INT) AS approval_date,
  'FM-' || UPPER(LEFT(document_type, 3)) || '-' || LPAD(CAST(fm % 999 AS VARCHAR), 3, '0') AS form_number
FROM h LEFT JOIN policies p ON p.policy_id = h.policy_id LEFT JOIN customers c ON c.customer_id = p.customer_id""")
def _(b):
    placed = b.policies.join(b.customers.select("customer_id", "state_id"), "customer_id")
    return doc.document_master(policy_documents(b), placed, 4)


@plan("versioned_documents", "R17", roles="filings", sql="""
WITH v AS (SELECT document_id, document_type, language, CAST(document_id % 7 + 1 AS INT) AS version, DATE '2000-01-01' + CAST(document_id % 1000 AS INT) AS effective_date,
CASE WHEN document_id % 5 <> 0 THEN DATE '2000-01-01' + CAST(document_id % 1000 + 365 AS INT) END AS expiration_date FROM filings)
SELECT document_type, language, document_id, version FROM v WHERE effective_date <= DATE '2001-06-30' AND (expiration_date IS NULL OR expiration_date > DATE '2001-06-30')
QUALIFY ROW_NUMBER() OVER (PARTITION BY document_type, language ORDER BY version DESC, document_id DESC) = 1""")
def _(b):
    start = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("document_id") % 1000).cast("int"))
    versions = b.filings.select("document_id", "document_type", "language", (F.col("document_id") % 7 + 1).cast("int").alias("version"),
                                start.alias("effective_date"), F.when(F.col("document_id") % 5 != 0, F.date_add(start, 365)).alias("expiration_date"))
    ranked = versions.withColumn("order_key", F.struct("version", "document_id"))
    return doc.valid_at(ranked, "2001-06-30", ["document_type", "language"], "order_key").select("document_type", "language", "document_id", "version")


# ---- intake -------------------------------------------------------------------------
LINES = ("Dwelling", "Liability", "Wind Deductible", "All-Peril Deductible", "Building", "Contents", "Loss of Use")


def raw_policy_documents(b):
    """Extractor output per policy: JSON text with its coverages, some of it broken on purpose."""
    per_line = b.claims.groupBy("policy_id").agg(*[F.sum(F.when(F.col("line_number") == i, F.col("amount"))).alias(f"l{i}") for i in range(1, 8)])
    p = b.policies.join(per_line, "policy_id", "left").join(b.customers.select("customer_id", "full_name"), "customer_id")
    i = F.col("policy_id")
    cover = F.filter(F.array(*[
        F.when(F.col(f"l{n}").isNotNull(), F.struct(F.lit(name).alias("line"), F.concat(F.lit("$"), F.col(f"l{n}").cast("string")).alias("limit"),
                                                   F.lit(str(n * 250)).alias("deductible"))) for n, name in enumerate(LINES, 1)]), lambda c: c.isNotNull())
    body = F.to_json(F.struct(
        F.when(i % 89 != 0, F.concat(F.lit("POL-"), F.lpad(i.cast("string"), 8, "0"))).alias("policy_number"),
        F.concat(F.col("line_of_business"), F.lit(" Property")).alias("policy_type"),
        F.when(F.col("status") == "Cancelled", "Cancelled").alias("policy_status"), F.col("full_name").alias("named_insured"),
        F.col("effective_date").cast("string").alias("effective_date"), F.col("expiration_date").cast("string").alias("expiration_date"),
        F.concat(F.lit("$"), F.col("premium").cast("string")).alias("annual_premium"),
        F.when(i % 2 == 1, F.col("coverage").cast("string")).alias("coverage_amount"), cover.alias("coverages"),
        F.struct((F.lit(1930) + i % 90).cast("string").alias("year_built"), F.lit("Masonry").alias("construction_type"),
                 (F.lit(900) + i % 2000).cast("string").alias("square_footage")).alias("property"),
        F.when(i % 3 == 0, F.array(F.struct((i % 9).cast("string").alias("unit"), F.lit("2019 Sedan").alias("year_make_model"),
                                            F.concat(F.lit("$"), (i % 50000).cast("string")).alias("stated_value")))).alias("vehicles"),
        F.when(i % 4 == 0, F.array(F.struct(F.lit("Water Backup").alias("name"), F.lit("5,000").alias("limit")),
                                   F.struct(F.lit("Identity Theft").alias("name"), F.lit("n/a").alias("limit")))).alias("endorsements"),
        F.array(F.struct(F.lit("source").alias("field"), F.lit("scan").alias("value")), F.struct(F.lit(" ").alias("field"), F.lit("x").alias("value"))).alias("extra_metadata")))
    fenced = F.when(i % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    text = F.when(i % 97 == 0, F.lit("{not a document")).when(i % 83 == 0, F.lit("x")).otherwise(fenced)
    # As in the intake itself, a one-element explode keeps the text from being built per use.
    return p.select(F.concat(F.lit("file-"), i.cast("string"), F.lit(".pdf")).alias("file_name"), F.explode(F.array(text)).alias("extracted"))


def intake_of(b):
    return intake.intake_policies(raw_policy_documents(b), AS_OF)


GOOD = """good AS (SELECT *, 'POL-' || LPAD(CAST(policy_id AS VARCHAR), 8, '0') AS number, SUBSTR(MD5('POL-' || LPAD(CAST(policy_id AS VARCHAR), 8, '0')), 1, 12) AS tail
FROM policies WHERE policy_id % 97 <> 0 AND policy_id % 83 <> 0 AND policy_id % 89 <> 0),
lines AS (SELECT policy_id, line_number, CAST(SUM(amount) AS DOUBLE) AS amount FROM claims GROUP BY 1, 2)"""


@plan("intake_policies", "R10 R12 F11 F25 F34 F35", roles="policies claims", sql=f"""
WITH {GOOD}, l AS (SELECT policy_id, MAX(amount) FILTER (WHERE line_number = 1) AS dwelling, MAX(amount) FILTER (WHERE line_number = 5) AS building,
  MAX(amount) FILTER (WHERE line_number = 4) AS peril FROM lines GROUP BY 1)
SELECT number AS policy_id, 'CUST-PDF-' || tail AS customer_id, line_of_business || ' Property' AS policy_type,
 CASE WHEN line_of_business = 'Commercial' THEN 'Commercial Lines' ELSE 'Personal Lines' END AS line_of_business, effective_date, CAST(premium AS DOUBLE) AS premium,
 CASE WHEN policy_id % 2 = 1 THEN CAST(coverage AS DOUBLE) ELSE COALESCE(dwelling, building, CAST(0 AS DOUBLE)) END AS coverage,
 CASE WHEN peril IS NOT NULL THEN CAST(1000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS deductible,
 CASE WHEN status = 'Cancelled' THEN 'Cancelled' ELSE 'Active' END AS status, CASE WHEN status = 'Cancelled' THEN 'Cancelled' ELSE 'Auto-Renew' END AS renewal_status
FROM good LEFT JOIN l USING (policy_id)""")
def _(b):
    return intake_of(b).policies.drop("expiration_date", "cancellation_date", "cancellation_reason", "return_premium")


@plan("intake_customers", "R10", roles="policies customers", sql="""
SELECT 'CUST-PDF-' || SUBSTR(MD5('POL-' || LPAD(CAST(policy_id AS VARCHAR), 8, '0')), 1, 12) AS customer_id, full_name AS first_name, '' AS last_name, 700 AS credit_score, DATE '2001-12-31' AS customer_since
FROM policies JOIN customers USING (customer_id) WHERE policy_id % 97 <> 0 AND policy_id % 83 <> 0 AND policy_id % 89 <> 0""")
def _(b):
    return intake_of(b).customers.select("customer_id", "first_name", "last_name", "credit_score", "customer_since")


@plan("intake_coverages", "R10 F31 F36", roles="policies claims", sql=f"""
WITH {GOOD}, x AS (SELECT g.number, tail, line_number, amount, ROW_NUMBER() OVER (PARTITION BY policy_id ORDER BY line_number) AS o FROM good g JOIN lines USING (policy_id))
SELECT 'COV-' || tail || '-' || LPAD(CAST(o AS VARCHAR), 2, '0') AS child_id, number AS policy_id, amount AS coverage_limit, CAST(line_number * 250 AS DOUBLE) AS deductible_amount,
 ['Dwelling', 'Liability', 'Wind Deductible', 'All-Peril Deductible', 'Building', 'Contents', 'Loss of Use'][line_number] AS coverage_line, 'Flat' AS deductible_type FROM x""")
def _(b):
    return intake_of(b).coverages.drop("notes")


@plan("intake_vehicles", "R10 F36", roles="policies claims", sql=f"""
WITH {GOOD} SELECT 'VEH-' || tail || '-01' AS child_id, number AS policy_id, CAST(policy_id % 9 AS INT) AS unit_number, '2019 Sedan' AS year_make_model, CAST(policy_id % 50000 AS DOUBLE) AS stated_value FROM good WHERE policy_id % 3 = 0""")
def _(b):
    return intake_of(b).vehicles.drop("vin", "garaging_location")


@plan("intake_endorsements", "R10 F36", roles="policies claims", sql=f"""
WITH {GOOD} SELECT 'END-' || tail || '-01' AS child_id, number AS policy_id, 'Water Backup' AS endorsement_name, CAST(5000 AS DOUBLE) AS endorsement_limit FROM good WHERE policy_id % 4 = 0
UNION ALL SELECT 'END-' || tail || '-02', number, 'Identity Theft', CAST(0 AS DOUBLE) FROM good WHERE policy_id % 4 = 0""")
def _(b):
    return intake_of(b).endorsements.drop("description")


@plan("intake_metadata", "R10 F36", roles="policies claims", sql=f"""
WITH {GOOD} SELECT 'META-' || tail || '-01' AS child_id, number AS policy_id, 'source' AS field_name, 'scan' AS field_value, 'TEXT' AS field_type FROM good""")
def _(b):
    return intake_of(b).metadata


@plan("intake_property", "R10 E19", roles="policies claims", sql=f"""
WITH {GOOD} SELECT 'PROP-PDF-' || tail AS property_id, number AS policy_id, CAST(1930 + policy_id % 90 AS INT) AS year_built, 'Masonry' AS construction_type, CAST(900 + policy_id % 2000 AS INT) AS square_footage, 1 AS stories FROM good""")
def _(b):
    return intake_of(b).property.drop("roof_type", "protection_class", "replacement_cost")


@plan("intake_log", "R13 G3", roles="policies", sql="""
WITH l AS (SELECT DISTINCT l_orderkey AS policy_id FROM lineitem)
SELECT CASE WHEN p.policy_id % 97 = 0 THEN 'JSON_PARSE_FAILED' WHEN p.policy_id % 83 = 0 THEN 'PARSE_FAILED' WHEN p.policy_id % 89 = 0 THEN 'NO_POLICY_NUMBER' ELSE 'SUCCESS' END AS status,
COUNT(*) AS files, CAST(SUM(CASE WHEN p.policy_id % 97 = 0 OR p.policy_id % 83 = 0 OR p.policy_id % 89 = 0 THEN 0
 ELSE 4 + (l.policy_id IS NOT NULL)::INT + (p.policy_id % 3 = 0)::INT + (p.policy_id % 4 = 0)::INT END) AS BIGINT) AS tables_touched
FROM policies p LEFT JOIN l ON l.policy_id = p.policy_id GROUP BY 1""")
def _(b):
    return intake_of(b).log.groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.coalesce(F.size("tables_updated"), F.lit(0))).alias("tables_touched"))


@plan("intake_claims", "R11 F9", roles="claims", sql="""
SELECT 'CDOC-' || SUBSTR(MD5('claim-' || claim_id || '.pdf'), 1, 12) AS document_id, claim_id, CAST(policy_id AS VARCHAR) AS policy_id, claim_date AS date_of_loss,
       cause AS cause_of_loss, CAST(amount AS DOUBLE) AS damage_estimate, status FROM claims""")
def _(b):
    body = F.to_json(F.struct(F.lit("Claim Form").alias("document_type"), F.col("claim_id").alias("claim_number"), F.col("policy_id").cast("string").alias("policy_number"),
                              F.col("claim_date").cast("string").alias("date_of_loss"), F.col("cause").alias("cause_of_loss"),
                              F.format_number(F.col("amount"), 2).alias("damage_estimate"), F.col("status").alias("status")))
    raw = b.claims.select(F.concat(F.lit("claim-"), "claim_id", F.lit(".pdf")).alias("file_name"), body.alias("extracted"))
    return intake.intake_claims(raw).select("document_id", "claim_id", "policy_id", "date_of_loss", "cause_of_loss", "damage_estimate", "status")


# ---- matching -----------------------------------------------------------------------
@plan("product_match_hybrid", "R15", roles="products", sql=f"""
WITH a AS (SELECT product_name || ' ' || LOWER(line) AS name, {sql_ratio('SUM(list_price)', 'COUNT(*)', 2)} AS price FROM products WHERE line IN ('STANDARD', 'PROMO') GROUP BY 1),
b AS (SELECT product_name || ' ' || LOWER(line) AS match, {sql_ratio('SUM(list_price)', 'COUNT(*)', 2)} AS match_price FROM products WHERE line NOT IN ('STANDARD', 'PROMO') GROUP BY 1),
p AS (SELECT *, LIST_DISTINCT(STRING_SPLIT(name, ' ')) AS ta, LIST_DISTINCT(STRING_SPLIT(match, ' ')) AS tb FROM a, b),
s AS (SELECT *, {sql_round('1 - CAST(LEVENSHTEIN(name, match) AS DOUBLE) / GREATEST(LENGTH(name), LENGTH(match))', 4)} AS fuzzy,
 {sql_round('CAST(LEN(LIST_INTERSECT(ta, tb)) AS DOUBLE) / LEN(LIST_DISTINCT(LIST_CONCAT(ta, tb)))', 4)} AS words FROM p WHERE CAST(LEN(LIST_INTERSECT(ta, tb)) AS DOUBLE) / LEN(LIST_DISTINCT(LIST_CONCAT(ta, tb))) >= 0.3),
r AS (SELECT *, {sql_round("CASE WHEN name = match THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END * CAST(0.2 AS DOUBLE) + fuzzy * CAST(0.4 AS DOUBLE) + words * CAST(0.4 AS DOUBLE)", 4)} AS score FROM s)
SELECT a.name, r.match, r.score, r.fuzzy, r.words, {sql_percent('a.price - r.match_price', 'r.match_price')} AS price_delta_pct FROM a LEFT JOIN r ON r.name = a.name
QUALIFY ROW_NUMBER() OVER (PARTITION BY a.name ORDER BY r.score DESC, r.match) = 1""")
def _(b):
    named = b.products.withColumn("name", F.concat_ws(" ", "product_name", F.lower("line")))
    mine = F.col("line").isin("STANDARD", "PROMO")
    return matching.match_products(matching.catalogue(named.filter(mine), "name", "list_price"), matching.catalogue(named.filter(~mine), "name", "list_price"))


def _hash_sql(c, salt):
    return f"CAST('0x' || SUBSTR(MD5({c} || '{salt}'), 1, 8) AS BIGINT)"


@plan("product_match_semantic", "R15", roles="products", sql=f"""
WITH a AS (SELECT product_name || ' ' || LOWER(line) AS name, {sql_ratio('SUM(list_price)', 'COUNT(*)', 2)} AS price FROM products WHERE line IN ('STANDARD', 'PROMO') GROUP BY 1),
b AS (SELECT product_name || ' ' || LOWER(line) AS match, {sql_ratio('SUM(list_price)', 'COUNT(*)', 2)} AS match_price FROM products WHERE line NOT IN ('STANDARD', 'PROMO') GROUP BY 1),
n AS (SELECT name FROM a UNION SELECT match FROM b), w AS (SELECT name, UNNEST(LIST_DISTINCT(STRING_SPLIT(name, ' '))) AS w FROM n),
f AS (SELECT w, COUNT(*) AS df FROM w GROUP BY 1), t AS (SELECT x.w, y.w AS c, COUNT(*) AS k FROM w x JOIN w y ON x.name = y.name AND x.w <> y.w GROUP BY 1, 2),
v AS (SELECT w, {_hash_sql('c', 'dim')} % 64 AS dim, {sql_round(f"SUM({sql_round('LN(k + 1)', 6)} * CASE WHEN {_hash_sql('c', 'sign')} % 2 = 0 THEN 1 ELSE -1 END)", 6)} AS x FROM t GROUP BY 1, 2),
m AS (SELECT name, dim, SUM({sql_round('LN(1 + CAST((SELECT COUNT(*) FROM n) AS DOUBLE) / df)', 6)} * x) AS x FROM w JOIN f USING (w) JOIN v USING (w) GROUP BY 1, 2),
u AS (SELECT name, dim, x / SQRT(SUM(x * x) OVER (PARTITION BY name)) AS x FROM m),
c AS (SELECT p.name, q.name AS match, SUM(p.x * q.x) AS cosine FROM u p JOIN u q USING (dim) GROUP BY 1, 2),
p AS (SELECT *, LIST_DISTINCT(STRING_SPLIT(name, ' ')) AS ta, LIST_DISTINCT(STRING_SPLIT(match, ' ')) AS tb FROM a, b),
s AS (SELECT p.*, {sql_round('COALESCE(cosine, 0)', 4)} AS semantic, {sql_round('1 - CAST(LEVENSHTEIN(p.name, p.match) AS DOUBLE) / GREATEST(LENGTH(p.name), LENGTH(p.match))', 4)} AS fuzzy,
 {sql_round('CAST(LEN(LIST_INTERSECT(ta, tb)) AS DOUBLE) / LEN(LIST_DISTINCT(LIST_CONCAT(ta, tb)))', 4)} AS words FROM p LEFT JOIN c ON c.name = p.name AND c.match = p.match
 WHERE CAST(LEN(LIST_INTERSECT(ta, tb)) AS DOUBLE) / LEN(LIST_DISTINCT(LIST_CONCAT(ta, tb))) >= 0.3),
r AS (SELECT *, {sql_round("CASE WHEN name = match THEN 1 ELSE 0 END * CAST(0.1 AS DOUBLE) + fuzzy * CAST(0.3 AS DOUBLE) + words * CAST(0.3 AS DOUBLE) + semantic * CAST(0.3 AS DOUBLE)", 4)} AS score FROM s)
SELECT a.name, r.match, r.score, r.fuzzy, r.words, r.semantic, {sql_percent('a.price - r.match_price', 'r.match_price')} AS price_delta_pct FROM a LEFT JOIN r ON r.name = a.name
QUALIFY ROW_NUMBER() OVER (PARTITION BY a.name ORDER BY r.score DESC, r.match) = 1""")
def _(b):
    named = b.products.withColumn("name", F.concat_ws(" ", "product_name", F.lower("line")))
    mine = F.col("line").isin("STANDARD", "PROMO")
    return matching.match_products_semantic(matching.catalogue(named.filter(mine), "name", "list_price"), matching.catalogue(named.filter(~mine), "name", "list_price"))


ENDS_SQL = """f AS (SELECT customer_id, ARG_MIN(policy_id, {'d': effective_date, 'p': policy_id}) AS first_id, ARG_MAX(policy_id, {'d': effective_date, 'p': policy_id}) AS last_id FROM policies GROUP BY 1),
g AS (SELECT policy_id FROM policies WHERE policy_id % 97 <> 0 AND policy_id % 83 <> 0 AND policy_id % 89 <> 0)"""


def first_and_last(b, table):
    """Rows of an intake table for each customer's first and last policy."""
    ends = b.policies.groupBy("customer_id").agg(F.min_by("policy_id", F.struct("effective_date", "policy_id")).alias("first_id"),
                                                 F.max_by("policy_id", F.struct("effective_date", "policy_id")).alias("last_id"))
    number = lambda c: F.concat(F.lit("POL-"), F.lpad(F.col(c).cast("string"), 8, "0")).alias("policy_id")
    return [ends.select("customer_id", number(c)).join(table, "policy_id").drop("policy_id") for c in ("first_id", "last_id")]


@plan("compare_endorsements", "R14", roles="policies", sql=f"""
WITH {ENDS_SQL}, e AS (SELECT policy_id, name, amount FROM g, (VALUES ('Water Backup', 5000.0), ('Identity Theft', 0.0)) AS t(name, amount) WHERE policy_id % 4 = 0),
a AS (SELECT customer_id, name, amount FROM f JOIN e ON policy_id = first_id), z AS (SELECT customer_id, name, amount FROM f JOIN e ON policy_id = last_id)
SELECT COALESCE(a.customer_id, z.customer_id) AS customer_id, COALESCE(a.name, z.name) AS endorsement_name, CASE WHEN a.name IS NULL THEN 'only b' WHEN z.name IS NULL THEN 'only a' ELSE 'both' END AS held_by,
CAST(a.amount AS DOUBLE) AS limit_a, CAST(z.amount AS DOUBLE) AS limit_b FROM a FULL JOIN z ON a.customer_id = z.customer_id AND a.name = z.name""")
def _(b):
    return matching.compare_items(*first_and_last(b, intake_of(b).endorsements), ["customer_id"], "endorsement_name", "endorsement_limit")


@plan("compare_properties", "R14", roles="policies", sql=f"""
WITH {ENDS_SQL}, y AS (SELECT policy_id, CAST(1930 + policy_id % 90 AS VARCHAR) AS year_built, CAST(900 + policy_id % 2000 AS VARCHAR) AS square_footage, 'Masonry' AS construction_type FROM g),
l AS (SELECT 'a' AS side, customer_id, y.* FROM f JOIN y ON policy_id = first_id UNION ALL SELECT 'b', customer_id, y.* FROM f JOIN y ON policy_id = last_id),
u AS (UNPIVOT l ON year_built, square_footage, construction_type INTO NAME attribute VALUE v)
SELECT customer_id, attribute, MAX(v) FILTER (WHERE side = 'a') AS value_a, MAX(v) FILTER (WHERE side = 'b') AS value_b FROM u GROUP BY 1, 2 HAVING value_a IS DISTINCT FROM value_b""")
def _(b):
    return matching.compare_attributes(*first_and_last(b, intake_of(b).property), ["customer_id"], ["year_built", "square_footage", "construction_type"])


@plan("compare_orders", "R14", roles="policies claims", sql="""
WITH f AS (SELECT customer_id, ARG_MIN(policy_id, {'d': effective_date, 'p': policy_id}) AS first_id, ARG_MAX(policy_id, {'d': effective_date, 'p': policy_id}) AS last_id FROM policies GROUP BY 1),
l AS (SELECT policy_id, line_number, SUM(amount) AS amount FROM claims GROUP BY 1, 2),
a AS (SELECT customer_id, line_number, amount FROM f JOIN l ON l.policy_id = first_id), z AS (SELECT customer_id, line_number, amount FROM f JOIN l ON l.policy_id = last_id)
SELECT COALESCE(a.customer_id, z.customer_id) AS customer_id, COALESCE(a.line_number, z.line_number) AS line_number, a.customer_id IS NOT NULL AS in_a, z.customer_id IS NOT NULL AS in_b,
CAST(COALESCE(z.amount, 0) - COALESCE(a.amount, 0) AS DOUBLE) AS difference FROM a FULL JOIN z ON a.customer_id = z.customer_id AND a.line_number = z.line_number""")
def _(b):
    ends = b.policies.groupBy("customer_id").agg(F.min_by("policy_id", F.struct("effective_date", "policy_id")).alias("first_id"),
                                                 F.max_by("policy_id", F.struct("effective_date", "policy_id")).alias("last_id"))
    lines = b.claims.groupBy("policy_id", "line_number").agg(F.sum("amount").cast("decimal(18,2)").alias("amount"))
    first = ends.select("customer_id", F.col("first_id").alias("policy_id")).join(lines, "policy_id").drop("policy_id")
    last = ends.select("customer_id", F.col("last_id").alias("policy_id")).join(lines, "policy_id").drop("policy_id")
    return matching.compare_lines(first, last, ["customer_id"], "line_number", "amount")


# ---- feedback -----------------------------------------------------------------------
def rated_texts(b):
    return b.ratings.join(b.filings.select("document_id", "content"), "document_id").withColumn("liked", F.col("nps_rating") >= 9)


LEXICON = f"""{DOC_WORDS}, sides AS (SELECT COUNT(*) FILTER (WHERE nps_rating >= 9) AS p, COUNT(*) FILTER (WHERE nps_rating < 9) AS q FROM ratings),
lex AS (SELECT term, {sql_round('(a + 0.5) / (p + 1.0) - (b + 0.5) / (q + 1.0)', 6)} AS weight FROM (SELECT term, CAST(COUNT(DISTINCT r.document_id) FILTER (WHERE nps_rating >= 9) AS DOUBLE) AS a,
CAST(COUNT(DISTINCT r.document_id) FILTER (WHERE nps_rating < 9) AS DOUBLE) AS b FROM ratings r JOIN doc_words w ON w.document_id = r.document_id GROUP BY 1), sides WHERE a + b >= 5)"""


@plan("lexicon_sentiment", "X4 F33", roles="filings ratings turns", sql=f"""
WITH {LEXICON}, {TURN_WORDS}, s AS (SELECT conversation_id, turn, {sql_round('SUM(weight) / COUNT(*)', 4)} AS s FROM turn_words JOIN lex USING (term) GROUP BY 1, 2),
x AS (SELECT t.conversation_id, t.turn, COALESCE(s, 0.0) AS sentiment FROM turns t LEFT JOIN s ON s.conversation_id = t.conversation_id AND s.turn = t.turn)
SELECT *, CASE WHEN sentiment > 0.01 THEN 'Positive' WHEN sentiment < -0.01 THEN 'Negative' ELSE 'Neutral' END AS band FROM x""")
def _(b):
    lexicon = feedback.induced_lexicon(rated_texts(b), "document_id", "content", "liked", at_least=5)
    return feedback.sentiment(b.turns, lexicon, ["conversation_id", "turn"], "comment", cut=0.01)


TERMS = f"""{DOC_WORDS}, df AS (SELECT term, COUNT(DISTINCT document_id) AS df FROM doc_words GROUP BY 1 HAVING COUNT(DISTINCT document_id) >= 3),
tf AS (SELECT GROUPCOL, term, COUNT(*) AS tf FROM doc_words GROUP BY 1, 2),
best AS (SELECT GROUPCOL, term, tf, {sql_round('tf * LN(CAST((SELECT COUNT(*) FROM filings) AS DOUBLE) / df)', 4)} AS weight FROM tf JOIN df USING (term))"""


@plan("theme_classify", "X5", roles="filings turns", sql=f"""
WITH {TERMS.replace('GROUPCOL', 'language')}, kw AS (SELECT language AS theme, term, weight FROM best QUALIFY ROW_NUMBER() OVER (PARTITION BY language ORDER BY weight DESC, term) <= 40),
{TURN_WORDS}, s AS (SELECT conversation_id, turn, theme, {sql_round('SUM(weight)', 2)} AS s FROM turn_words JOIN kw USING (term) GROUP BY 1, 2, 3)
SELECT t.conversation_id, t.turn, theme FROM (SELECT DISTINCT conversation_id, turn FROM turns) t LEFT JOIN s ON s.conversation_id = t.conversation_id AND s.turn = t.turn
QUALIFY ROW_NUMBER() OVER (PARTITION BY t.conversation_id, t.turn ORDER BY s DESC, theme) = 1""")
def _(b):
    kw = feedback.group_terms(b.filings, "language", "document_id", "content", k=40, min_docs=3).select(F.col("language").alias("theme"), "term", "weight")
    return feedback.classify(b.turns, kw, ["conversation_id", "turn"], "comment").drop("strength")


@plan("nps_by_theme", "K39 X5", roles="filings ratings", sql=f"""
WITH {TERMS.replace('GROUPCOL', 'language')}, kw AS (SELECT language AS theme, term, weight FROM best QUALIFY ROW_NUMBER() OVER (PARTITION BY language ORDER BY weight DESC, term) <= 40),
s AS (SELECT document_id, theme, {sql_round('SUM(weight)', 2)} AS s FROM doc_words JOIN kw USING (term) GROUP BY 1, 2),
c AS (SELECT document_id, theme FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY s DESC, theme) = 1)
SELECT theme, COUNT(*) AS surveys, {sql_mean('nps_rating', 1)} AS avg_rating FROM ratings JOIN filings USING (document_id) LEFT JOIN c USING (document_id) GROUP BY 1""")
def _(b):
    from covermetrics.functions.numbers import mean
    kw = feedback.group_terms(b.filings, "language", "document_id", "content", k=40, min_docs=3).select(F.col("language").alias("theme"), "term", "weight")
    themes = feedback.classify(rated_texts(b), kw, ["document_id"], "content")
    return themes.join(b.ratings.select("document_id", "nps_rating"), "document_id").groupBy("theme").agg(
        F.count(F.lit(1)).alias("surveys"), mean("nps_rating", 1).alias("avg_rating"))


@plan("summary_terms", "X6", roles="filings", sql=f"""
WITH {TERMS.replace('GROUPCOL', 'document_type')} SELECT *, ROW_NUMBER() OVER (PARTITION BY document_type ORDER BY weight DESC, term) AS rank FROM best QUALIFY rank <= 5""")
def _(b):
    return feedback.group_terms(b.filings, "document_type", "document_id", "content", k=5, min_docs=3)


@plan("summary_sentences", "X6", roles="filings", sql=f"""
WITH {DOC_WORDS}, shares AS (SELECT document_type, term, COUNT(DISTINCT document_id) AS n FROM doc_words GROUP BY 1, 2),
l AS (SELECT document_type, document_id, REGEXP_SPLIT_TO_ARRAY(content, '[.!?]\\s+|\\n+') AS parts FROM filings),
s AS (SELECT * FROM (SELECT document_type, document_id, GENERATE_SUBSCRIPTS(parts, 1) - 1 AS pos, UNNEST(parts) AS sentence FROM l) WHERE LENGTH(sentence) >= 20),
w AS (SELECT DISTINCT document_type, document_id, pos, UNNEST(REGEXP_EXTRACT_ALL(LOWER(sentence), '{WORD}')) AS term FROM s),
c AS (SELECT document_type, document_id, pos, {sql_round('AVG(n)', 4)} AS score FROM w JOIN shares USING (document_type, term) GROUP BY 1, 2, 3)
SELECT document_type, document_id, CAST(pos AS INT) AS pos, score, sentence FROM c JOIN s USING (document_type, document_id, pos)
QUALIFY ROW_NUMBER() OVER (PARTITION BY document_type ORDER BY score DESC, document_id, pos) = 1""")
def _(b):
    return feedback.central_sentences(b.filings, "document_type", "document_id", "content", min_chars=20)
