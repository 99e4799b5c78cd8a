"""Evaluation documents: nested JSON results, labels keyed by image, report output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RESULT = (
    "struct<engine:string,durationMs:bigint,plainText:string,fields:map<string,string>,blockCount:bigint,failure:string>"
)
_RESULTS = f"cards array<struct<image:string,results:array<{_RESULT}>>>"
_LABELS = "map<string,struct<script:string,rawText:string,fields:map<string,string>>>"


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per (image, engine) run; a folder of result files is one dataset."""
    return (
        spark.read.schema(_RESULTS)
        .option("multiLine", True)
        .json(path)
        .select(F.explode("cards").alias("card"))
        .select("card.image", F.explode("card.results").alias("r"))
        .select(
            "image",
            "r.engine",
            F.col("r.durationMs").alias("duration_ms"),
            F.col("r.plainText").alias("plain_text"),
            "r.fields",
            F.col("r.blockCount").alias("block_count"),
            "r.failure",
        )
    )


def read_eval_labels(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", _LABELS)).alias("image", "label"))
        .select("image", "label.script", F.col("label.rawText").alias("raw_text"), "label.fields")
    )


def write_eval_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def format_report(report: DataFrame, fields: DataFrame) -> DataFrame:
    """The readable report, one text per engine; field lines are in key order."""
    line = F.format_string(
        "  %s  P=%.3f  R=%.3f  F1=%.3f  n=%d", "field_key", "precision", "recall", "f1", "support"
    )
    lines = (
        fields.filter(F.col("bucket") == "all")
        .groupBy("engine")
        .agg(F.array_sort(F.collect_list(F.struct("field_key", line.alias("line")))).alias("lines"))
        .select("engine", F.array_join(F.col("lines.line"), "\n").alias("lines"))
    )
    return report.join(lines, "engine", "left").select(
        "engine",
        F.concat_ws(
            "\n",
            F.format_string("Engine: %s", "engine"),
            F.format_string("Cards: %d", "cards"),
            F.format_string("Mean CER: %.3f", "mean_cer"),
            F.format_string("Total-failure rate: %.1f%%", F.col("failure_rate") * 100),
            F.format_string("Latency: mean %.0fms, p90 %.0fms", "mean_ms", "p90_ms"),
            F.lit(""),
            F.lit("Fields (all cards):"),
            F.col("lines"),
            F.format_string("  weighted F1: %.3f", "f1_all"),
            F.lit(""),
            F.format_string("Latin-only cards:  weighted F1 = %.3f", "f1_latin"),
            F.format_string("Bengali cards:     weighted F1 = %.3f", "f1_bengali"),
        ).alias("report"),
    )
