"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Rows up to which a stored table may go whole to the driver and to every task of a join.
SENT_ROWS = 200_000


def build_session(app: str = "cardmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume: UTC, AQE with skew handling, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative jobs neither replan nor recompute their past rounds."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


#: For rows of megabytes. Parquet looks at the size of a page and of a row group after 100 rows at the earliest, so all large rows of a
#: task would be one page, held in memory whole by its writer and by every reader. With these a row is a page, 8 MB are a row group.
LARGE_ROWS = {f"parquet.{unit}.size.row.check.{bound}": "1" for unit in ("page", "block") for bound in ("min", "max")} | {
    "parquet.block.size": str(8 << 20)
}


def written(df: DataFrame, **options: str) -> DataFrame:
    """Stores a result that several later steps read in the shared folder and reads it back.

    Unlike a checkpoint the stored table has sizes and columns the optimizer can use.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/cardmill-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the table: both sides are dealt by key, none is sent whole.

    Without this a file of some megabytes would be broadcast, however many short rows it holds, and the driver builds
    the hash table of a broadcast: 70 bytes a row.
    """
    return side.hint("merge")


def as_side(stored: DataFrame) -> DataFrame:
    """A stored table as a side of a join, dealt by key if it has many rows."""
    return by_shuffle(stored) if stored.count() > SENT_ROWS else stored
