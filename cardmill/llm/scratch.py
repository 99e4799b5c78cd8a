"""Intermediate tables in the shared folder, deleted when a later one has taken their place."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cardmill.session import checkpoint_root


@dataclass
class Stored:
    """A table written once and read as often as needed; a lost executor costs no recomputation of it."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str, **options: str) -> Stored:
    spark: SparkSession = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)
