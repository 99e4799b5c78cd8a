"""Extraction quality: error rates, precision / recall / F1, latency, the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.functions.scoring import cer, ratio_or_zero
from cardmill.functions.text import collapse_space


def comparable(col: Column) -> Column:
    return F.nullif(F.lower(collapse_space(col)), F.lit(""))


def scored_cards(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Results that have a label, with their buckets: everything, and latin or bengali (mixed is bengali).

    An image has one label and many results, which are wide: a task holds its labels, results stream past unsorted.
    """
    wanted = labels.select(
        "image",
        F.coalesce(F.lower("script"), F.lit("latin")).alias("script"),
        F.col("raw_text").alias("want_text"),
        F.col("fields").alias("want"),
    )
    bucket = F.when(F.col("script") == "latin", "latin").otherwise("bengali")
    return results.join(wanted.hint("shuffle_hash"), "image").withColumn("buckets", F.array(F.lit("all"), bucket))


def unlabelled(results: DataFrame, labels: DataFrame) -> DataFrame:
    return results.select("image").distinct().join(labels.select("image"), "image", "left_anti")


def confusion(df: DataFrame, *group: str) -> DataFrame:
    """tp / fp / fn per group for (expected, actual); a wrong value is both a false alarm and a miss."""
    want, got = comparable(F.col("expected")), comparable(F.col("actual"))
    pairs = df.select(*group, want.alias("want"), got.alias("got")).filter(
        F.col("want").isNotNull() | F.col("got").isNotNull()
    )
    same = F.coalesce(F.col("want") == F.col("got"), F.lit(False))
    return pairs.groupBy(*group).agg(
        F.sum(same.cast("long")).alias("tp"),
        F.sum((F.col("got").isNotNull() & ~same).cast("long")).alias("fp"),
        F.sum((F.col("want").isNotNull() & ~same).cast("long")).alias("fn"),
    )


def prf(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", ratio_or_zero(tp, tp + fp))
        .withColumn("recall", ratio_or_zero(tp, tp + fn))
        .withColumn(
            "f1",
            ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
        .withColumn("support", tp + fn)
    )


def field_scores(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Per engine, bucket and field, over the union of expected and extracted keys."""
    empty = F.create_map().cast("map<string,string>")
    keys = F.array_union(F.map_keys("want"), F.map_keys("got"))
    pairs = (
        scored_cards(results, labels)
        .withColumn("want", F.coalesce("want", empty))
        .withColumn("got", F.coalesce("fields", empty))
        .select("engine", "buckets", "want", "got", F.explode(keys).alias("field_key"))
        .select(
            "engine",
            "buckets",
            "field_key",
            F.try_element_at("want", F.col("field_key")).alias("expected"),
            F.try_element_at("got", F.col("field_key")).alias("actual"),
        )
    )
    # Values are compared once; what falls in several buckets is added up from the counts.
    counts = confusion(pairs, "engine", "buckets", "field_key").withColumn("bucket", F.explode("buckets"))
    return prf(counts.groupBy("engine", "bucket", "field_key").agg(*[F.sum(n).alias(n) for n in ("tp", "fp", "fn")]))


def weighted_f1(scores: DataFrame, *group: str) -> DataFrame:
    return scores.groupBy(*group).agg(
        ratio_or_zero(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("support"),
    )


#: Groups up to this size are ordered whole; the sketch of larger ones is good to 1 / ACCURACY of their rows.
ORDERED_WHOLE, ACCURACY, MARGIN = 10_000, 10_000, 5e-4


def nearest_percentile(df: DataFrame, group: str, col: str, p: float = 0.9) -> DataFrame:
    """Value at sorted index round((n-1)*p), not interpolated, for any number of rows per group.

    Rows are first reduced to value counts. A quantile sketch with an error bound gives two values that the wanted one
    lies between, whatever the distribution; what is below them is only counted, and only what is between is ordered.
    """
    rows = df.filter(F.col(col).isNotNull())
    counts = rows.groupBy(group, col).agg(F.count("*").alias("n"))
    near = F.percentile_approx(col, [max(0.0, p - MARGIN), min(1.0, p + MARGIN)], ACCURACY)
    span = rows.groupBy(group).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), near.alias("near"), F.count("*").alias("total"))
    small = F.col("total") <= ORDERED_WHOLE
    bounded = span.select(
        group,
        F.when(small, F.col("lo")).otherwise(F.col("near")[0]).alias("lo"),
        F.when(small, F.col("hi")).otherwise(F.col("near")[1]).alias("hi"),
        F.floor((F.col("total") - 1) * F.lit(p) + 0.5).alias("wanted"),
    )
    placed = counts.join(bounded, group)
    below = placed.groupBy(group).agg(F.sum(F.when(F.col(col) < F.col("lo"), F.col("n")).otherwise(0)).alias("before"))
    inside = Window.partitionBy(group).orderBy(col)
    return (
        placed.filter(F.col(col).between(F.col("lo"), F.col("hi")))
        .join(below, group)
        .withColumn("until", F.col("before") + F.sum("n").over(inside))
        .filter((F.col("until") > F.col("wanted")) & (F.col("until") - F.col("n") <= F.col("wanted")))
        .select(group, F.col(col).cast("double").alias("percentile"))
    )


def engine_report(results: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per engine: cards, mean error rate (as published and over labelled texts only), latency, F1s."""
    error = F.when(F.col("want_text").isNotNull(), cer(F.col("want_text"), F.coalesce("plain_text", F.lit(""))))
    cards = scored_cards(results, labels).withColumn("duration", F.coalesce("duration_ms", F.lit(0)))
    summary = cards.withColumn("cer", error).groupBy("engine").agg(
        F.count("*").alias("cards"),
        F.avg(F.coalesce("cer", F.lit(0.0))).alias("mean_cer"),
        F.avg("cer").alias("mean_cer_labelled"),
        F.avg((F.coalesce("block_count", F.lit(0)) == 0).cast("double")).alias("failure_rate"),
        F.avg("duration").alias("mean_ms"),
    )
    p90 = nearest_percentile(cards, "engine", "duration", 0.9).withColumnRenamed("percentile", "p90_ms")
    f1 = (
        weighted_f1(field_scores(results, labels), "engine", "bucket")
        .groupBy("engine")
        .agg(
            *[
                F.coalesce(F.max(F.when(F.col("bucket") == b, F.col("weighted_f1"))), F.lit(0.0)).alias(f"f1_{b}")
                for b in ("all", "latin", "bengali")
            ]
        )
    )
    none = F.lit(0.0)
    return (
        summary.join(p90, "engine", "left")
        .join(f1, "engine", "left")
        .withColumns({f"f1_{b}": F.coalesce(f"f1_{b}", none) for b in ("all", "latin", "bengali")})
    )


def quality_gate(
    report: DataFrame, engine: str = fixed.GATE_ENGINE, threshold: float = fixed.GATE_THRESHOLD
) -> DataFrame:
    return report.filter(F.col("engine") == engine).select(
        "engine", F.col("f1_bengali").alias("score"), (F.col("f1_bengali") >= threshold).alias("passes")
    )


def predictions(fields: DataFrame) -> DataFrame:
    """(card_id, fields): canonical else shown value, first row per key."""
    shown = F.coalesce("normalized_value", "value")
    first = fields.groupBy("card_id", "field_key").agg(F.min_by(shown, "id").alias("value"))
    return first.groupBy("card_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_key", "value")))).alias("fields")
    )


def correction_rate(fields: DataFrame, *group: str) -> DataFrame:
    return fields.groupBy(*(group or ("field_key",))).agg(
        F.count("*").alias("fields"), F.avg(F.col("verified_by_user").cast("double")).alias("correction_rate")
    )


def attempt_report(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("engine").agg(
        F.count("*").alias("attempts"),
        *[
            F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("success", "partial", "failed")
        ],
        F.avg("duration_ms").alias("mean_ms"),
        F.sum("fields_found").alias("fields_found"),
    )


def rescan_outcomes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Improved means more fields than before; cards without any field count as zero."""
    b = before.groupBy("card_id").agg(F.count("*").alias("before"))
    a = after.groupBy("card_id").agg(F.count("*").alias("after"))
    zero = F.lit(0)
    return (
        b.join(a, "card_id", "full")
        .select("card_id", F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"))
        .withColumn("improved", F.col("after") > F.col("before"))
    )
