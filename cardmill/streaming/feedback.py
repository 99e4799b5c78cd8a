"""Running trust: verdicts are counted as they come, in state that outlives the stream's restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardmill.functions.scoring import trust
from cardmill.sources.segments import Segments


def trust_store(spark: SparkSession, path: str, subject: str) -> Segments:
    return Segments(spark, path, {"trust": [subject]})


def trust_stream(feedback: DataFrame, subject: str, store: Segments, checkpoint: str) -> StreamingQuery:
    """Counts of (event_id, subject, verdict) per subject; each batch reads its own rows and the state of what they touch.

    The ids seen and the counts so far are operator state in the stream's checkpoint. Ids are dealt by themselves and counts
    are added up before they are dealt by subject, so a subject with very many verdicts fills no task. An id counts once
    however late it is repeated, and no event is too late to count. The changed subjects go to the store.
    """
    once = feedback.select("event_id", subject, "verdict").dropDuplicates(["event_id"])
    said = lambda verdict: F.sum((F.col("verdict") == verdict).cast("long"))
    counts = once.groupBy(subject).agg(said("useful").alias("useful"), said("not_relevant").alias("not_relevant"))

    def apply(changed: DataFrame, batch_id: int) -> None:
        store.commit("feedback", batch_id, {"trust": (changed.fillna(0, ["useful", "not_relevant"]), None)})
        store.compact()

    writer = counts.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def current_trust(store: Segments) -> DataFrame:
    """(subject, useful, not_relevant, trust) after the last batch."""
    return store.read("trust").withColumn("trust", trust(F.col("useful"), F.col("not_relevant")))
