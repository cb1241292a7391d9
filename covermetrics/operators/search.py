"""Ranked search over postings: computed for one call, or kept as an index of segments that grows with every batch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermetrics.functions.strings import tokens
from covermetrics.operators.documents import chunk_fixed
from covermetrics.operators.relational import attach_group_facts, top_k_per_group
from covermetrics.operators.topk import TopK
from covermetrics.session import scratch_path

# Standard ranking constants.
BM25_K1, BM25_B = 1.2, 0.75
# Postings that a scoring task should hold, questions that it scores them for, and cells of its matrix of scores.
WORD_SPLIT = 1_000_000
QUESTIONS = 1024
CELLS = 4_000_000
LEAST = -1e300  # below any score; cells without a shared word hold less
# Stands for the text itself among its words; words are never empty.
UNIT = ""
C = F.col


def postings(texts: DataFrame, key: Sequence[str], text: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, key, length, tf) of each word of each text, or only of the given terms, and one row of the term '' for each
    text. One scan; counts combine before the shuffle."""
    words = texts.select(*key, F.coalesce(tokens(text), F.array().cast("array<string>")).alias("_w")).select(
        *key, F.size("_w").alias("length"), F.explode(F.array_append("_w", F.lit(UNIT))).alias("term"))
    if terms is not None:
        mark = words.sparkSession.createDataFrame([(UNIT,)], "term string")
        words = words.join(terms.select("term").unionByName(mark).distinct(), "term", "left_semi")
    return words.groupBy("term", *key, "length").agg(F.count(F.lit(1)).alias("tf"))


def counted_words(words: pa.Array) -> pa.Array:
    """The distinct words of each list with their counts."""
    coded = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = max(len(coded.dictionary), 1)
    found, times = np.unique(row * size + code, return_counts=True)
    ends = np.searchsorted(found // size, np.arange(len(words) + 1))
    pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(found % size)), pa.array(times, pa.int64())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def row_postings(texts: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """`postings` of texts whose keys are unique: each row counts its own words, so nothing is shuffled."""
    words = F.coalesce(tokens(text), F.array().cast("array<string>"))
    count = F.arrow_udf(counted_words, "array<struct<term:string,tf:bigint>>")
    return texts.select(*key, words.alias("_w")).select(*key, F.size("_w").alias("length"), F.explode(count(F.array_append("_w", F.lit(UNIT)))).alias("_p")).select(
        "_p.term", *key, "length", "_p.tf")


def asked_words(questions: DataFrame, qkey: str, qtext: str) -> DataFrame:
    return questions.select(qkey, F.explode(F.array_distinct(tokens(qtext))).alias("term"))


def numbered(table: pa.Table, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct key, in the order of the keys with NULL first, and the number of each row's key."""
    code = np.zeros(table.num_rows, np.int64)
    for c in columns:
        place = pc.rank(table[c].combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
        code = np.unique(code * (table.num_rows + 1) + place.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)[1]
    return np.unique(code, return_index=True)[1], code


def summed(values: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct tuples of ``by``, sorted, each followed by the sum of its values."""
    order = np.lexsort(by[::-1])
    by = [b[order] for b in by]
    starts = np.flatnonzero(np.concatenate([[True], np.any([b[1:] != b[:-1] for b in by], axis=0)]))
    return *[b[starts] for b in by], np.add.reduceat(values[order], starts)


def best_of_slice(key: Sequence[str], qkey: str, k: int):
    """Scores the texts of a slice for a block of questions: word by word, parts are added where the texts that hold the word
    cross the questions that ask for it. k rows per question are returned."""
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [right.schema.field(qkey), *[left.schema.field(c) for c in key], pa.field("score", pa.float64())]
        words = pc.unique(right["term"])
        left = left.filter(pc.is_in(left["term"], value_set=words))
        if not left.num_rows or not right.num_rows:
            return pa.schema(names).empty_table()
        (text_row, text), (q_row, q) = numbered(left, key), numbered(right, [qkey])
        place = lambda t: pc.index_in(t["term"], value_set=words).to_numpy().astype(np.int64)
        qw, qs, times = summed(np.ones(len(q)), place(right), q)  # a question that comes twice counts twice
        asks = np.searchsorted(qw, np.arange(len(words) + 1))
        step = max(1, CELLS // len(q_row))
        run, w, text, part = summed(left["part"].to_numpy(), text // step, place(left), text)
        ends = np.flatnonzero(np.concatenate([(run[1:] != run[:-1]) | (w[1:] != w[:-1]), [True]])) + 1
        best, score, seen, start = TopK(len(q_row), k, LEAST), None, None, 0
        for end in ends:
            at = run[start] * step
            if score is None:
                score = np.zeros((min(step, len(text_row) - at), len(q_row)))
                seen = np.zeros(score.shape, bool)
            asked = slice(asks[w[start]], asks[w[start] + 1])
            cross = np.ix_(text[start:end] - at, qs[asked])
            score[cross] += part[start:end, None] * times[asked]
            seen[cross] = True
            if end == len(run) or run[end] != run[start]:
                # Half up at six digits, then at five, as `rounded` does.
                steps = np.floor((np.floor(score * 1e6 + 0.5) + 5) / 10)
                best.offer(np.where(seen, steps, -np.inf), np.arange(at, at + len(score)))
                score = None
            start = end
        found = [(j, i, s) for j in range(len(q_row)) if best.keys[j] is not None for i, s in zip(best.keys[j], best.scores[j])]
        qi, ti, steps = (np.array(x) for x in zip(*found))
        columns = [right[qkey].take(q_row[qi]), *[left[c].take(text_row[ti]) for c in key], pa.array(steps / 1e5)]
        return pa.table(columns, schema=pa.schema(names))
    return score


def rank(found: DataFrame, asked: DataFrame, n: Column, average: Column, key: Sequence[str], qkey: str, k: int,
         split: int = WORD_SPLIT) -> DataFrame:
    """BM25 top k per question from the stored postings of the asked words.

    A word's weight is ln(1 + (n - df + 0.5) / (df + 0.5)): common words weigh little, never nothing. Texts are dealt to
    slices of about `split` postings and questions to blocks; each slice meets each block in one task, which adds up the
    scores in a matrix of bounded size and hands back k rows per question. A text and question that share words are never a row.
    """
    df = C("df").cast("double")
    facts = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(
        "term", "df", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
    tf, length = C("tf").cast("double"), C("length")
    part = C("idf") * (tf * (BM25_K1 + 1)) / (tf + BM25_K1 * ((1 - BM25_B) + BM25_B * length / average))
    slices = F.greatest(F.ceil(found.agg(F.count(F.lit(1))).scalar() / split), F.lit(1)).cast("int")
    blocks = F.greatest(F.ceil(asked.select(qkey).distinct().agg(F.count(F.lit(1))).scalar() / QUESTIONS), F.lit(1)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    texts = attach_group_facts(found, facts, ["term"], rows="df").select(
        "term", *key, part.alias("part"), F.pmod(F.xxhash64(*key), slices).cast("int").alias("_slice"), spread(blocks).alias("_block"))
    asks = asked.select(qkey, "term", F.pmod(F.xxhash64(qkey), blocks).cast("int").alias("_block"), spread(slices).alias("_slice"))
    kinds = ", ".join([f"`{qkey}` {asked.schema[qkey].dataType.simpleString()}", *[f"`{c}` {found.schema[c].dataType.simpleString()}" for c in key], "score double"])
    meet = ["_slice", "_block"]
    best = texts.groupBy(*meet).cogroup(asks.groupBy(*meet)).applyInArrow(best_of_slice(key, qkey, k), kinds)
    return top_k_per_group(best, [qkey], [F.desc("score"), *[C(c) for c in key]], k)


def ranked_search(docs: DataFrame, questions: DataFrame, k: int = 5, key: str | Sequence[str] = "document_id", text: str = "content",
                  qkey: str = "question_id", qtext: str = "question", attributes: Sequence[str] = ()) -> DataFrame:
    """BM25 top k texts per question, over whole texts or chunks, with the wanted attributes of each.

    The texts are split into words once: the postings of the asked words and the lengths of all texts are written, and
    everything else reads those. For repeated searches keep a `SearchIndex`.
    """
    key = [key] if isinstance(key, str) else list(key)
    asked = asked_words(questions, qkey, qtext)
    path = scratch_path(docs.sparkSession, "postings")
    postings(docs, key, text, asked).withColumn("unit", (C("term") == UNIT).cast("int")).write.partitionBy("unit").parquet(path)
    stored = docs.sparkSession.read.parquet(path)
    n, average = unit_totals(stored.filter("unit = 1").agg(F.count(F.lit(1)).alias("units"), F.sum("length").alias("words")))
    best = rank(stored.filter("unit = 0").drop("unit"), asked, n, average, key, qkey, k)
    return best.join(docs.select(*key, *attributes), key) if attributes else best


def unit_totals(totals: DataFrame) -> tuple[Column, Column]:
    """Number of texts and their mean length, as doubles, from a row of units and words."""
    row = totals.select(C("units").cast("double").alias("n"), (C("words") / F.nullif(C("units"), F.lit(0))).alias("average")).first()
    return F.lit(row.n or 0.0), F.lit(row.average).cast("double")


@dataclass(frozen=True)
class SearchIndex:
    """An inverted index over the chunks of documents, kept as one segment per batch.

    ``chunks`` holds the texts, ``postings`` the words of each chunk in hash buckets of the word, ``documents`` the document ids
    in hash buckets with their totals, ``totals`` a row per segment, ``terms`` by how many documents a segment changes the use
    of a word, and ``replaced`` the documents that a later segment brought again. A search reads the buckets of the asked words and the totals, never a text. Of a document that comes again
    the newest segment counts; inside one batch the greatest text does. A batch that is replayed writes its segment anew.
    """

    root: str
    key: str = "document_id"
    key_type: str = "bigint"
    text: str = "content"
    size: int = 2000
    overlap: int = 200
    buckets: int = 64

    def _path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def _schema(self, table: str) -> str:
        key = f"{self.key} {self.key_type}"
        return {"chunks": f"{key}, chunk_index int, chunk_text string, token_count int, segment bigint",
                "postings": f"term string, {key}, chunk_index int, length int, tf bigint, segment bigint, bucket int",
                "documents": f"{key}, chunks bigint, words bigint, segment bigint, bucket int",
                "terms": "term string, documents bigint, segment bigint",
                "totals": "units bigint, words bigint, documents bigint, segment bigint",
                "replaced": f"{key}, old_segment bigint, chunks bigint, words bigint, segment bigint"}[table]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        try:
            return spark.read.schema(self._schema(name)).parquet(self._path(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self._schema(name))

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, name: str, segment: int, *by: str) -> DataFrame:
        path = f"{self._path(name)}/segment={segment}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        kept = [f for f in self._schema(name).split(", ") if not f.startswith("segment ")]
        return df.sparkSession.read.schema(", ".join(kept)).parquet(path)

    def add(self, docs: DataFrame, segment: int) -> None:
        """Write the documents as a segment, greater than all before it."""
        spark = docs.sparkSession
        rows = docs.select(C(self.key).cast(self.key_type).alias(self.key), C(self.text).alias(self.text))
        repeated = rows.groupBy(self.key).count().filter("count > 1").limit(1).count()
        single = rows.groupBy(self.key).agg(F.max(self.text).alias(self.text)) if repeated else rows
        chunks = self._write(chunk_fixed(single, self.size, self.overlap, self.key, self.text), "chunks", segment)
        found = row_postings(chunks, [self.key, "chunk_index"], "chunk_text").withColumn("bucket", self._bucket("term"))
        # A word's postings lie together and in order, so that a reader can skip the rest of the bucket.
        dealt = found.repartition("bucket").sortWithinPartitions("bucket", "term").select("term", self.key, "chunk_index", "length", "tf", "bucket")
        stored = self._write(dealt, "postings", segment, "bucket")
        # Documents without a chunk take part too: a later version of a document may be empty.
        per_document = stored.filter(C("term") == UNIT).groupBy(self.key).agg(F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("words"))
        counted = rows.select(self.key).distinct().join(per_document, self.key, "left").select(
            self.key, F.coalesce("chunks", F.lit(0).cast("bigint")).alias("chunks"), F.coalesce("words", F.lit(0).cast("bigint")).alias("words"), self._bucket(self.key).alias("bucket"))
        new = self._write(counted, "documents", segment, "bucket")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # `buckets` rows at most
        earlier = self.table(spark, "documents").filter((C("segment") < segment) & C("bucket").isin(touched))
        gone = self.table(spark, "replaced").filter(C("segment") < segment).select(self.key, C("old_segment").alias("segment"))
        live = earlier.join(gone, [self.key, "segment"], "left_anti").withColumnRenamed("segment", "old_segment")
        again = live.join(new.select(self.key), self.key, "left_semi").select(self.key, "old_segment", "chunks", "words")
        replaced = self._write(again, "replaced", segment)
        used = self._users(single, 1)
        if not replaced.isEmpty():
            used = used.unionByName(self._users(self._old_texts(replaced), -1)).groupBy("term").agg(F.sum("documents").alias("documents"))
        self._write(used, "terms", segment)
        plus = new.agg(F.sum("chunks").alias("units"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("documents"))
        minus = replaced.agg(F.sum(-C("chunks")).alias("units"), F.sum(-C("words")).alias("words"), (-F.count(F.lit(1))).alias("documents"))
        net = plus.unionByName(minus).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("units", "words", "documents")])
        self._write(net, "totals", segment)

    def _users(self, docs: DataFrame, sign: int) -> DataFrame:
        words = docs.select(F.explode(F.array_distinct(tokens(self.text))).alias("term"))
        return words.groupBy("term").agg((F.lit(sign) * F.count(F.lit(1))).alias("documents"))

    def _old_texts(self, replaced: DataFrame) -> DataFrame:
        """Whole texts of replaced documents, put together from their chunks."""
        old = self.table(replaced.sparkSession, "chunks").withColumnRenamed("segment", "old_segment").join(
            replaced.select(self.key, "old_segment"), [self.key, "old_segment"])
        parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda c: F.when(
            c["chunk_index"] == 1, c["chunk_text"]).otherwise(F.substring(c["chunk_text"], F.lit(self.overlap + 1), F.length(c["chunk_text"]))))
        return old.groupBy(self.key).agg(F.array_join(parts, "").alias(self.text))

    def terms(self, spark: SparkSession) -> DataFrame:
        """How many documents use each word."""
        return self.table(spark, "terms").groupBy("term").agg(F.sum("documents").alias("documents")).filter("documents > 0")

    def _live(self, df: DataFrame) -> DataFrame:
        gone = self.table(df.sparkSession, "replaced").select(self.key, C("old_segment").alias("segment"))
        return df.join(gone, [self.key, "segment"], "left_anti")

    def chunks(self, spark: SparkSession) -> DataFrame:
        """The chunks of all documents, each in its newest form."""
        return self._live(self.table(spark, "chunks")).drop("segment")

    def postings(self, spark: SparkSession) -> DataFrame:
        return self._live(self.table(spark, "postings").filter(C("term") != UNIT))

    def search(self, questions: DataFrame, k: int = 5, qkey: str = "question_id", qtext: str = "question") -> DataFrame:
        """BM25 top k chunks per question: qkey, document, chunk_index, score, rank."""
        spark = questions.sparkSession
        asked = asked_words(questions, qkey, qtext)
        buckets = [r.bucket for r in asked.select(self._bucket("term").alias("bucket")).distinct().collect()]  # `buckets` rows at most
        stored = self.postings(spark).filter(C("bucket").isin(buckets))
        found = stored.join(asked.select("term").distinct(), "term", "left_semi").select("term", self.key, "chunk_index", "length", "tf")
        n, average = unit_totals(self.table(spark, "totals").agg(F.sum("units").alias("units"), F.sum("words").alias("words")))
        return rank(found, asked, n, average, [self.key, "chunk_index"], qkey, k)

    def with_text(self, hits: DataFrame) -> DataFrame:
        """Adds the chunk texts to the rows of a search."""
        return hits.join(self.chunks(hits.sparkSession), [self.key, "chunk_index"])

    def compacted(self, spark: SparkSession, root: str) -> SearchIndex:
        """The same index as one segment under another root, without what was replaced. Searches go on meanwhile; later
        batches are added to the new root."""
        target = SearchIndex(root, self.key, self.key_type, self.text, self.size, self.overlap, self.buckets)
        last = self.table(spark, "totals").agg(F.max("segment")).scalar()
        segment = spark.range(1).select(last).first()[0] or 0
        target._write(self.chunks(spark).select(self.key, "chunk_index", "chunk_text", "token_count"), "chunks", segment)
        live = self._live(self.table(spark, "postings")).drop("segment")
        target._write(live.repartition("bucket").sortWithinPartitions("bucket", "term"), "postings", segment, "bucket")
        target._write(self._live(self.table(spark, "documents")).drop("segment"), "documents", segment, "bucket")
        target._write(spark.createDataFrame([], self._schema("replaced")).drop("segment"), "replaced", segment)
        target._write(self.terms(spark), "terms", segment)
        sums = self.table(spark, "totals").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("units", "words", "documents")])
        target._write(sums, "totals", segment)
        return target
