"""Windows and sessions whose every row is accounted for: closed, open or late."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

C = F.col
SECOND = 1_000_000  # event times are kept in microseconds
LEDGER_KEYS = "start bigint, stop bigint, rows bigint, value decimal(38,2)"


@dataclass(frozen=True)
class Ledger:
    """Batch by batch, rows are counted into windows (or sessions) by key.

    The watermark is the greatest event time of all earlier batches less the lateness. A row whose window had ended by
    then is late (for sessions: a row from before it, so that no closed session can have grown) and goes to the table
    ``late`` with all its columns; the others are added to the open windows, and those that end by the new watermark move to
    ``closed``. ``open`` holds what is open after a batch: its size follows the
    windows still running, not history. A batch that is run again writes its own folders anew and reads only earlier ones.
    """

    root: str
    keys: Sequence[tuple[str, str]]  # name and type of the grouping columns
    lateness_s: int = 7200

    def _path(self, table: str, batch_id: int | None = None) -> str:
        path = f"{self.root.rstrip('/')}/{table}"
        return path if batch_id is None else f"{path}/batch={batch_id}"

    @property
    def _names(self) -> list[str]:
        return [k for k, _ in self.keys]

    @property
    def _schema(self) -> str:
        return ", ".join(f"{k} {t}" for k, t in self.keys) + ", " + LEDGER_KEYS

    def _read(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(self._path(table))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def marks(self, spark: SparkSession) -> DataFrame:
        """Watermark after each batch, and the rows and window rows that it brought."""
        return self._read(spark, "marks", "mark bigint, rows bigint, window_rows bigint, batch bigint")

    def _before(self, spark: SparkSession, batch_id: int) -> tuple[int | None, int | None]:
        last = self.marks(spark).filter(C("batch") < batch_id).agg(F.max("mark"), F.max("batch")).first()
        return last[0], last[1]

    def _commit(self, rows: DataFrame, deadline: str, merge, batch: DataFrame, batch_id: int) -> None:
        """``rows`` are the batch's rows with start and stop for each of their windows; late if the deadline has passed."""
        spark = batch.sparkSession
        mark, last = self._before(spark, batch_id)
        is_late = F.lit(False) if mark is None else C(deadline) <= mark
        rows = rows.persist()
        rows.filter(is_late).write.mode("overwrite").parquet(self._path("late", batch_id))
        fresh = rows.filter(~is_late).groupBy(*self._names, "start", "stop").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("value").cast("decimal(38,2)").alias("value"))
        opened = fresh if last is None else spark.read.schema(self._schema).parquet(self._path("open", last)).unionByName(fresh)
        merged = merge(opened).persist()
        newest = batch.agg(F.max(F.unix_micros("at"))).first()[0]
        now = max((m for m in (mark, None if newest is None else newest - self.lateness_s * SECOND) if m is not None), default=None)
        ended = F.lit(False) if now is None else C("stop") <= now
        merged.filter(ended).write.mode("overwrite").parquet(self._path("closed", batch_id))
        merged.filter(~ended).write.mode("overwrite").parquet(self._path("open", batch_id))
        done = batch.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(now).cast("bigint").alias("mark"), "rows", F.lit(rows.count()).cast("bigint").alias("window_rows"))
        done.write.mode("overwrite").parquet(self._path("marks", batch_id))
        merged.unpersist()
        rows.unpersist()

    def add_windows(self, batch: DataFrame, batch_id: int, length: str, slide: str) -> None:
        spans = batch.withColumn("_w", F.window("at", length, slide))
        rows = spans.withColumns({"start": F.unix_micros("_w.start"), "stop": F.unix_micros("_w.end")}).drop("_w")
        names = self._names
        self._commit(rows, "stop", lambda df: df.groupBy(*names, "start", "stop").agg(
            F.sum("rows").alias("rows"), F.sum("value").cast("decimal(38,2)").alias("value")), batch, batch_id)

    def add_sessions(self, batch: DataFrame, batch_id: int, gap_s: int) -> None:
        at = F.unix_micros("at")
        rows = batch.withColumns({"start": at, "stop": at + gap_s * SECOND})
        self._commit(rows, "start", self._joined_sessions, batch, batch_id)

    def _joined_sessions(self, df: DataFrame) -> DataFrame:
        """Overlapping sessions of a key become one."""
        w = Window.partitionBy(*self._names).orderBy("start", "stop")
        reached = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
        numbered = df.withColumn("_new", F.when(C("start") < reached, 0).otherwise(1)).withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*self._names, "_n").agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("rows").alias("rows"), F.sum("value").cast("decimal(38,2)").alias("value")).drop("_n")

    def closed(self, spark: SparkSession) -> DataFrame:
        return self._timed(self._read(spark, "closed", f"{self._schema}, batch bigint").drop("batch"))

    def open(self, spark: SparkSession) -> DataFrame:
        last = self.marks(spark).agg(F.max("batch")).first()[0]
        return self._timed(spark.createDataFrame([], self._schema) if last is None else spark.read.schema(self._schema).parquet(self._path("open", last)))

    def late(self, spark: SparkSession) -> DataFrame:
        """Late rows as they came, once for each window that they were too late for."""
        try:
            return self._timed(spark.read.parquet(self._path("late")))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self._timed(spark.createDataFrame([], self._schema))

    @staticmethod
    def _timed(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("start", "stop")})

    def account(self, spark: SparkSession) -> DataFrame:
        """state, key columns, windows, rows, value: closed, open and late add up to what came in."""
        def summed(df: DataFrame, state: str, rows) -> DataFrame:
            return df.groupBy(*self._names).agg(
                F.countDistinct("start", "stop").alias("windows"), rows.alias("rows"), F.sum("value").cast("double").alias("value")).select(
                F.lit(state).alias("state"), *self._names, "windows", "rows", "value")
        whole = F.coalesce(F.sum("rows"), F.lit(0))
        return summed(self.closed(spark), "closed", whole).unionByName(summed(self.open(spark), "open", whole)).unionByName(
            summed(self.late(spark), "late", F.count(F.lit(1))))


def timed(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("at", C("reported_at").cast("timestamp"))


def window_ledger(alerts: DataFrame, ledger: Ledger, checkpoint: str, length: str = "7 days", slide: str = "1 day") -> DataStreamWriter:
    """Severe alerts in sliding windows, with late rows and open windows on the books."""
    severe = timed(alerts.filter(C("severity").isin("Severe", "Extreme")))
    return severe.writeStream.foreachBatch(lambda batch, i: ledger.add_windows(batch, i, length, slide)).option("checkpointLocation", checkpoint)


def session_ledger(alerts: DataFrame, ledger: Ledger, checkpoint: str, gap_s: int = 6 * 3600) -> DataStreamWriter:
    """Sessions per customer, with late rows and open sessions on the books."""
    return timed(alerts).writeStream.foreachBatch(lambda batch, i: ledger.add_sessions(batch, i, gap_s)).option("checkpointLocation", checkpoint)
