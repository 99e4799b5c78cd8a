"""Structured Streaming forms of the batch jobs: change in, affected rows recomputed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardmill.functions import fixed
from cardmill.operators.lifecycle import final_deletes


def read_changes(spark: SparkSession, path: str, schema=None, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream, be it a folder of part files or a single file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    stream = spark.readStream.schema(schema if schema is not None else spark.read.parquet(path).schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    if folder:
        return stream.parquet(path)
    return stream.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def _run(changes: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    writer = changes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _store_version(rows: DataFrame, subjects: DataFrame, sink: str, batch_id: int) -> None:
    """One folder per batch: replaying a batch overwrites its own, so the result is the same however often it runs.

    ``subjects`` has the key and a stamp; of several versions of a subject the one of the latest stamp counts, of equal
    stamps the later batch.
    """
    version = F.lit(batch_id).cast("long")
    rows.withColumn("version", version).write.mode("overwrite").parquet(f"{sink}/rows/batch={batch_id}")
    subjects.withColumn("version", version).write.mode("overwrite").parquet(f"{sink}/subjects/batch={batch_id}")


def _newest(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    subjects = spark.read.parquet(f"{sink}/subjects")
    return subjects.groupBy(*keys).agg(
        F.max_by("version", F.struct("stamp", "version")).alias("version"), F.max("stamp").alias("stamp")
    )


def latest(spark: SparkSession, sink: str, key: str | list[str] = "subject_id") -> DataFrame:
    """The current rows: those of each subject's newest version. A subject with no rows left has none."""
    keys = [key] if isinstance(key, str) else key
    newest = _newest(spark, sink, keys).drop("stamp")
    return spark.read.parquet(f"{sink}/rows").drop("batch").join(newest, [*keys, "version"]).drop("version")


def final_delete_stream(
    events: DataFrame, key: str, sink: str, checkpoint: str, seconds: int = fixed.UNDO_SECONDS
) -> StreamingQuery:
    """Deletes that no restore of the subject undid in time; events are (event_id, ts, key, action delete | restore).

    Nothing is dropped for being late: events go to a log by day, and every batch settles anew the (subject, window-sized
    slot) pairs that its events can bear on. ``final_deletes_of`` reads what is final.
    """
    width = seconds * 1_000_000
    slot = F.floor(F.unix_micros("ts") / width)

    def day(slot_column) -> Column:
        return F.to_date(F.timestamp_micros((slot_column * width).cast("long")))

    def settle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = batch.filter(F.col("action").isin("delete", "restore")).select("event_id", "ts", key, "action")
        kept = kept.withColumn("slot", slot).withColumn("day", day(F.col("slot")))
        kept.write.mode("overwrite").partitionBy("day").parquet(f"{sink}/log/batch={batch_id}")
        log = spark.read.parquet(f"{sink}/log")
        own = log.filter(F.col("batch") == batch_id)
        # A restore bears on the deletes of its own slot and of the one before.
        bears = own.select(key, F.explode(F.when(F.col("action") == "delete", F.array("slot")).otherwise(F.array("slot", F.col("slot") - 1))).alias("slot"))
        touched = bears.distinct()
        near = touched.union(touched.withColumn("slot", F.col("slot") + 1)).distinct().withColumn("day", day(F.col("slot")))
        around = log.join(near, [key, "slot", "day"]).select("event_id", "ts", key, "action", "slot")
        deletes = around.filter("action = 'delete'").join(touched, [key, "slot"]).drop("slot")
        final = final_deletes(deletes, around.filter("action = 'restore'"), key, seconds)
        rows = final.select(F.col("event_id").alias("delete_id"), key, F.col("ts").alias("deleted_at"), slot.alias("slot"))
        _store_version(rows, touched.withColumn("stamp", F.lit(batch_id).cast("long")), sink, batch_id)

    return _run(events, settle, checkpoint)


def final_deletes_of(spark: SparkSession, key: str, sink: str, seconds: int = fixed.UNDO_SECONDS) -> DataFrame:
    """(delete_id, key, deleted_at) of the deletes whose window closed before the latest event; the rest is held back."""
    now = spark.read.parquet(f"{sink}/log").agg(F.max(F.unix_micros("ts")).alias("now")).first()["now"]
    closed = F.unix_micros("deleted_at") + seconds * 1_000_000 < F.lit(now)
    return latest(spark, sink, [key, "slot"]).filter(closed).select("delete_id", key, "deleted_at")
