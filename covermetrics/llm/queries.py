"""The registered queries of this subpackage and, where SQL can express them, their SQL texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermetrics.session import scratch_path
from covermetrics.llm import attention_lm, bag_minhash, byte_bpe, compression, decontamination, importance, line_chunks, line_crf, multiprobe, personal_data, substring_dedup, token_files, vector_codes

RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_MODEL = "word_bpe_49k.json"
C = F.col


def _read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*columns)


def op1_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents", "doc_id", "text")
    model = line_crf.fit(docs, _read(spark, folder, "labels", "doc_id", "quality"))
    scored = line_crf.score(docs, model)
    return scored.select("doc_id", line_crf.held_out(C("doc_id")).alias("held_out"), "score", (C("score") >= 0.3).cast("int").alias("predicted"))


def op2_suffix_automata(spark: SparkSession, folder: str) -> DataFrame:
    done = substring_dedup.remove_repeats(_read(spark, folder, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(C("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    done = compression.quality_rules(_read(spark, folder, "documents", "doc_id", "text"))
    return done.select("doc_id", "rules.*")


def op4_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return line_chunks.dedup_lines(_read(spark, folder, "documents", "doc_id", "text"))


LINE_CHUNKS_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, line, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next_i, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next_line
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
r AS (SELECT *, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, i) > 1 AS again FROM w WHERE next_i IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(i, next_i + 1)) AS i, true AS gone FROM r WHERE again)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL), '') AS text,
       count(*) AS n_lines, count(gone) AS n_removed
FROM l LEFT JOIN g USING (doc_id, i) GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""


def op5_bag_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return bag_minhash.near_duplicates(_read(spark, folder, "documents", "doc_id", "text"))


def op6_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = _read(spark, folder, "documents", "doc_id", "text")
    both = byte_bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(C("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_contextual_extraction(spark: SparkSession, folder: str) -> DataFrame:
    kinds = personal_data.KINDS
    found = personal_data.personal_spans(_read(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in kinds),
                        F.sha2(personal_data.listed(kinds).cast("binary"), 256).alias("base_sha256"),
                        personal_data.listed((*kinds, "found")).alias("spans"), F.size("found").cast("bigint").alias("n_found"))


def op8_repair_token_files(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path(WORD_MODEL), encoding="utf-8") as file:
        model = file.read()
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(_read(spark, folder, "documents", "doc_id", "text"), path, model)
    return token_files.read_token_files(spark, path).select(C("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_attention_lm(spark: SparkSession, folder: str) -> DataFrame:
    return attention_lm.score_texts(_read(spark, folder, "documents", "doc_id", "text"), public_tokenizers.path(RANKS))


def op10_automaton_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents", "doc_id", "text")
    found = decontamination.find_items(docs, _read(spark, folder, "benchmark", "item_id", "text"))
    n_hit = decontamination.n_covered(C("hits.words"))
    counted = found.select("doc_id", C("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), C("hits.items").alias("items"))
    return counted.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                          F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
                          decontamination.contaminated(C("n_hit"), C("n_words")).alias("contaminated"))


def op11_multiprobe_search(spark: SparkSession, folder: str) -> DataFrame:
    found = multiprobe.nearest(_read(spark, folder, "embeddings", "vec_id", "embedding"), C("id") % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op12_trie_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.encode_vectors(_read(spark, folder, "embeddings", "vec_id", "embedding", "label"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return vector_codes.with_group_errors(coded, "label").select(
        "row.vec_id", code.alias("code"), "error", C("group_error").alias("label_error"), F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


# Four rounds of nearest entries and floored means, spelled out; dot products of integers this small are exact in doubles.
_BOOK_ROUND = """
n{r} AS (SELECT p.no, p.pos, arg_min(b.entry, {{'d': {distance}, 'e': b.entry}}) AS entry FROM p JOIN b{r} b USING (pos) GROUP BY 1, 2),
s{r} AS (SELECT pos, entry, list(m ORDER BY d) AS v FROM (SELECT pos, entry, d, floor(sum(x) / count(*)) AS m
         FROM (SELECT pos, entry, unnest(v) AS x, unnest(range(len(v))) AS d FROM p JOIN n{r} USING (no, pos)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{next} AS (SELECT b.pos, b.entry, coalesce(s.v, b.v) AS v FROM b{r} b LEFT JOIN s{r} s USING (pos, entry)),"""
_DISTANCE = "list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, b.v) + list_dot_product(b.v, b.v)"
TRIE_CODES_SQL = """
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS no, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (SELECT no, pos, v[pos * len(v) // 4 + 1:(pos + 1) * len(v) // 4] AS v FROM k, range(4) AS r(pos)),
b0 AS (SELECT pos, no - 1 AS entry, v FROM p WHERE no <= 256),""" + "".join(
    _BOOK_ROUND.format(r=r, next=r + 1, distance=_DISTANCE) for r in range(4)) + f"""
f AS (SELECT p.no, p.pos, min({{'d': {_DISTANCE}, 'e': b.entry}}) AS best FROM p JOIN b4 b USING (pos) GROUP BY 1, 2),
c AS (SELECT no, string_agg(format('{{:02x}}', best.e), '' ORDER BY pos) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM f GROUP BY 1),
h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY pos, entry, d)) AS digest
      FROM (SELECT pos, entry, unnest(v) AS x, unnest(range(len(v))) AS d FROM b4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM k JOIN c USING (no), h
"""


def op13_overlapped_regex_resampling(spark: SparkSession, folder: str) -> DataFrame:
    weighed = importance.weigh(_read(spark, folder, "documents", "doc_id", "text"), _read(spark, folder, "benchmark", "text"))
    return importance.draw(weighed).select("row.doc_id", "n_features", "weight", "score", "rank")


# CRC-32 as its bytewise definition: the table from the reflected polynomial, then one step for each byte.
IMPORTANCE_SQL = """
WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
w AS (SELECT 'd' AS side, row_number() OVER () AS no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
      UNION ALL SELECT 'b', row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
g AS (SELECT side, no, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram FROM w),
k AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM g)),
c AS (SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h), 2), lambda i: CAST('0x' || h[i + 1:i + 2] AS BIGINT))), lambda x, y: xor(t[xor(x, y) % 256 + 1], x >> 8)), 4294967295) % 10000 AS bucket FROM k, steps),
f AS (SELECT side, no, bucket FROM g JOIN c USING (gram)),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM f GROUP BY 1),
a AS (SELECT count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM f),
v AS (SELECT bucket, CAST(floor(1000 * ln((n.t + 1)::DOUBLE * (a.s + 10000)::DOUBLE / ((n.s + 1)::DOUBLE * (a.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n, a),
m AS (SELECT no, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS gain FROM f JOIN v USING (bucket) WHERE side = 'd' GROUP BY 1),
d AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features,
             coalesce((gain - ((gain % n_features) + n_features) % n_features) // n_features, 0) AS weight,
             CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (no) WHERE side = 'd'),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () * 25 // 100 AS most FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= most THEN place END AS rank FROM r
"""


QUERIES = {f.__name__: f for f in (op1_line_crf, op2_suffix_automata, op3_compression_bands, op4_line_chunks, op5_bag_minhash, op6_tree_bpe, op7_contextual_extraction, op8_repair_token_files, op9_attention_lm, op10_automaton_decontamination, op11_multiprobe_search, op12_trie_codes, op13_overlapped_regex_resampling)}
SQL = {"op4_line_chunks": LINE_CHUNKS_SQL, "op12_trie_codes": TRIE_CODES_SQL, "op13_overlapped_regex_resampling": IMPORTANCE_SQL}
