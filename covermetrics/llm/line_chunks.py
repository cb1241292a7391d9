"""Line dedup by content-defined chunks, in DataFrame functions only.

A hash rolls over the line hashes, two neighbouring lines at a time; lines without a word count as space between them. Two
lines belong together if their rolling hash occurs earlier in (id, text hash, line) order, and a chunk ends where that
stops or its earlier occurrence ends: boundaries depend on the lines themselves, so shifted, nested and partly repeated
passages are found whole, from two lines on. Chunks are cut out after their lines are compared, byte by byte, with
those of the earlier occurrence. The first occurrence of every line stays, so no line is lost from the corpus; a single
repeated line between different neighbours stays too.

Null text stays null; an empty text is one empty line and stays; a text whose lines all go becomes empty. Rows equal in id
and text are one occurrence and get the same result. Null ids sort first. Other columns pass through, a column that has the
name of a count is replaced; column names starting with `__` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermetrics.llm.rows import written

C = F.col
WORDED = "[^\\x20\\x09-\\x0D]"
HOT_SHARE = 1000  # windows with more than one in so many of all rows are joined by broadcast; there are fewer than that


def line_windows(keyed: DataFrame, text: str) -> DataFrame:
    """A row for each two neighbouring lines with words: document, number, line range (stop exclusive) and rolling hash."""
    lines = keyed.where(C(text).contains("\n")).select("__order", "__id", "__key", F.split(text, "\n").alias("__lines"))
    worded = F.filter(F.transform("__lines", lambda line, i: F.when(line.rlike(WORDED), F.struct(i.alias("at"), F.md5(line).alias("hash")))), lambda x: x.isNotNull())
    two = lambda n: F.struct(
        n.alias("no"), F.get("__worded", n)["at"].alias("start"), (F.get("__worded", n + 1)["at"] + 1).alias("stop"),
        F.unhex(F.md5(F.concat(F.get("__worded", n)["hash"], F.get("__worded", n + 1)["hash"]))).alias("rolling"))
    windows = lines.select("__order", "__id", "__key", worded.alias("__worded")).where(F.size("__worded") > 1) \
        .withColumn("__windows", F.transform(F.sequence(F.lit(0), F.size("__worded") - 2), two))
    # An outer explode: for the plain form the optimiser adds a filter that computes the array again.
    return windows.select("__order", "__id", "__key", F.explode_outer("__windows").alias("__w")).select("__order", "__id", "__key", "__w.*")


def repeated_chunks(windows: DataFrame) -> DataFrame:
    """Maximal runs of windows that all occur earlier, one after the other in one document: both line ranges of each."""
    place = F.struct(C("__order").alias("order"), C("__key").alias("key"), C("no").alias("no"), C("__id").alias("id"), C("start").alias("start"), C("stop").alias("stop"))
    firsts = written(windows.groupBy("rolling").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "repeated-lines")
    n_rows = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = firsts.where(C("n") * HOT_SHARE > n_rows)
    rest = windows.join(F.broadcast(hot.select("rolling")), "rolling", "left_anti").join(firsts.where(C("n") * HOT_SHARE <= n_rows), "rolling")
    again = windows.join(F.broadcast(hot), "rolling").unionByName(rest).where(~place.eqNullSafe(C("first")))
    run = ["__id", "__key", C("first.id").alias("__first_id"), C("first.key").alias("__first_key"), (C("no") - C("first.no")).alias("__shift")]
    steps = again.select(*run, "no", "start", "stop", C("first.start").alias("first_start"), C("first.stop").alias("first_stop")).distinct()
    same = ["__id", "__key", "__first_id", "__first_key", "__shift"]
    numbered = steps.withColumn("__run", C("no") - F.row_number().over(Window.partitionBy(*same).orderBy("no")))
    return numbered.groupBy(*same, "__run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_start").alias("first_start"), F.max("first_stop").alias("first_stop"))


def worded_bytes(lines: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.filter(F.slice(lines, start + 1, stop - start), lambda line: line.rlike(WORDED)), "\n")


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """The documents with repeated chunks cut out of the text, and the long columns `n_lines` and `n_removed`."""
    keyed = docs.withColumn("__order", C(doc_id)).withColumn("__key", F.xxhash64(doc_id, text)).withColumn("__id", F.coalesce(C(doc_id).cast("string"), F.lit("")))
    chunks = written(repeated_chunks(written(line_windows(keyed, text), "line-windows")), "line-chunks")
    # Only the first occurrences' bytes travel, to the documents that repeat them; these compare them with their own.
    first = ["__first_id", "__first_key"]
    wanted = chunks.groupBy(*first).agg(F.collect_set(F.struct("first_start", "first_stop")).alias("__wanted")).select(
        C("__first_id").alias("__id"), C("__first_key").alias("__key"), "__wanted")
    kept = keyed.select("__id", "__key", text).join(wanted, ["__id", "__key"]).dropDuplicates(["__id", "__key"]) \
        .select("__id", "__key", F.split(text, "\n").alias("__lines"), F.explode_outer("__wanted").alias("__w")) \
        .select(C("__id").alias("__first_id"), C("__key").alias("__first_key"), "__w.*", worded_bytes(C("__lines"), C("__w.first_start"), C("__w.first_stop")).alias("bytes"))
    lists = chunks.join(kept, [*first, "first_start", "first_stop"]).groupBy("__id", "__key").agg(F.collect_list(F.struct("start", "stop", "bytes")).alias("__chunks"))
    found = keyed.join(lists, ["__id", "__key"], "left")
    lines = F.split(C(text), "\n")
    equal = F.filter("__chunks", lambda c: worded_bytes(C("__lines"), c["start"], c["stop"]) == c["bytes"])
    gone = F.array_distinct(F.flatten(F.transform(equal, lambda c: F.sequence(c["start"], c["stop"] - 1))))
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), C("__gone")), lambda i: F.get(C("__lines"), i))
    return found.withColumn(n_lines, F.coalesce(F.size(lines), F.lit(0)).cast("bigint")) \
        .withColumn("__lines", F.when(C("__chunks").isNotNull(), lines)).withColumn("__gone", gone) \
        .withColumn(text, F.when(F.size("__gone") > 0, F.array_join(stays, "\n")).otherwise(C(text))) \
        .withColumn(n_removed, F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint")) \
        .select(*docs.columns, *(c for c in (n_lines, n_removed) if c not in docs.columns))
