"""Reading and writing tables; no schema is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions.scoring import is_usable
from cardmill.sources.schemas import ALLOWED, LENGTHS, SCHEMAS


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One contact-memory table with its fixed schema; columns older files lack come out null."""
    return spark.read.schema(SCHEMAS[name]).option("mergeSchema", "true").parquet(f"{root}/{name}")


# Tables whose rows are expensive to process: long texts that meet regular expressions.
TEXT_TABLES = {"documents", "pages", "conversations"}


def read_input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; zone-less timestamps are read as instants so that every job sees one time type."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    if zoneless:
        df = df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out to all cores when a small file would leave text work to a few tasks.

    A table with at least one scan partition per core, as any large one has, is left as it is. Filters
    and column pruning still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def validity(name: str) -> Column:
    """True for rows whose closed-vocabulary and length-bounded columns hold legal values."""
    ok = F.lit(True)
    for (table, column), values in ALLOWED.items():
        if table == name:
            ok = ok & (F.col(column).isNull() | F.col(column).isin(values))
    for (table, column), (low, high) in LENGTHS.items():
        if table == name:
            ok = ok & F.length(column).between(low, high)
    return F.coalesce(ok, F.lit(False))


def read_token_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, token_id long, vector array<float>").parquet(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["ranking_weights"]).parquet(path)


def write_vectors(df: DataFrame, path: str, model: str) -> None:
    """Zero vectors are left out: they carry no signal."""
    rows = df.filter(is_usable(F.col("vector"))).select(
        "subject_id", "vector", F.size("vector").alias("dim"), F.lit(model).alias("model")
    )
    rows.write.mode("overwrite").partitionBy("model").parquet(path)
