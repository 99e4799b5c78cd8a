"""Card and field tables: filters, projections, first-of-key picks, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.functions.text import blank_to_null


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def trash(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNotNull())


def attention_queue(cards: DataFrame) -> DataFrame:
    """Failed or partial live cards, oldest capture first."""
    waiting = live(cards).filter(F.col("extraction_status").isin(fixed.ATTENTION_STATUSES))
    return waiting.orderBy(F.asc("captured_at"), F.asc("id"))


def unmerged(people: DataFrame) -> DataFrame:
    return people.filter(F.col("merged_into_id").isNull())


def contains_ci(df: DataFrame, cols: Sequence[str], needle: str) -> DataFrame:
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.lower(c).contains(needle.strip().lower()), F.lit(False))
    return df.filter(hit)


def needs_a_look(issue: Column) -> Column:
    return F.coalesce(issue.isNotNull() & ~issue.isin(fixed.PROVENANCE_ISSUES), F.lit(False))


def provenance_label(issue: Column, verified: Column, source: Column) -> Column:
    return (
        F.when(needs_a_look(issue), "needs a look")
        .when(verified, "you confirmed")
        .when(issue == "digit_restored", "digit restored")
        .when(issue == "ocr_repaired", "OCR repaired")
        .when(source == "printed", "on the card")
        .when(source == "user", "you typed")
        .when(source == "aiInferred", "guess")
        .when(source == "outdated", "may be old")
        .when(source == "verified", "verified")
    )


def is_useful(fields: DataFrame) -> DataFrame:
    """Per card: a phone, an e-mail, or both a name and a company."""

    def has(key: str) -> Column:
        return F.max(F.col("field_key") == key)

    return fields.groupBy("card_id").agg(
        (has("phone") | has("email") | (has("person_name") & has("company"))).alias("is_useful")
    )


def first_of_key(df: DataFrame, group: str = "card_id", key: str = "field_key", order: str = "id") -> DataFrame:
    """One column per field key holding the first value in row order. One shuffle, no window."""
    return df.groupBy(group).agg(
        *[F.min_by(F.when(F.col(key) == k, F.col("value")), F.when(F.col(key) == k, F.col(order))).alias(k)
          for k in fixed.FIELD_KEYS]
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key: partial aggregation on both sides of the shuffle, so a hot key costs nothing."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def ordered_join(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, sep: str, name: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct(*order, F.col(col).alias("_text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(entries, lambda e: e["_text"]), sep).alias(name))


def display_path(thumb: Column, image: Column) -> Column:
    return F.coalesce(thumb, image)


def card_summaries(cards: DataFrame, fields: DataFrame, notes: DataFrame) -> DataFrame:
    """Live cards with title, subtitle and the first note body."""
    first = first_of_key(fields).select("card_id", "company", "person_name", "phone")
    note = (
        notes.filter(F.col("subject_type") == "card")
        .groupBy(F.col("subject_id").alias("card_id"))
        .agg(F.min_by(F.struct("body"), "id").alias("n"))
        .select("card_id", F.col("n.body").alias("note"))
    )
    return (
        live(cards)
        .withColumnRenamed("id", "card_id")
        .join(first, "card_id", "left")
        .join(note, "card_id", "left")
        .select(
            F.col("card_id").alias("subject_id"),
            F.coalesce("company", "person_name", "phone").alias("title"),
            F.coalesce("person_name", "phone").alias("subtitle"),
            "note",
            "captured_at",
        )
    )


def needs_indexing(cards: DataFrame, index: DataFrame) -> DataFrame:
    return live(cards).join(index.select(F.col("subject_id").alias("id")).distinct(), "id", "left_anti").select("id")


def needs_promotion(cards: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Live cards never linked, or owning an endpoint the current rules would not produce. Newest first."""
    stale = (
        endpoints.filter(F.col("source_card_id").isNotNull() & F.col("normalized_value").isNull())
        .select(F.col("source_card_id").alias("id"))
        .distinct()
        .withColumn("stale", F.lit(True))
    )
    due = F.col("person_id").isNull() & F.col("org_id").isNull()
    return (
        live(cards)
        .join(stale, "id", "left")
        .filter(due | F.col("stale").isNotNull())
        .drop("stale")
        .orderBy(F.desc("captured_at"), F.asc("id"))
    )


def unassigned_blocks(blocks: DataFrame, claimed: DataFrame) -> DataFrame:
    """Non-blank blocks no field claims; ``claimed`` is (card_id, order_index)."""
    return blocks.filter(blank_to_null(F.col("text")).isNotNull()).join(
        claimed.select("card_id", "order_index").distinct(), ["card_id", "order_index"], "left_anti"
    )


def identity_endpoints(fields: DataFrame) -> DataFrame:
    """Phone and e-mail fields with a canonical form: what may link two cards."""
    return fields.filter(
        (F.coalesce("value_kind", F.lit("text")) == "text")
        & F.col("normalized_value").isNotNull()
        & F.col("field_key").isin("phone", "email")
    )


def primary_branch(branches: DataFrame) -> DataFrame:
    """The branch to show per organization: primary first, then the oldest."""
    return branches.groupBy("org_id").agg(
        F.min_by("address", F.struct(~F.col("is_primary"), F.col("id"))).alias("address")
    )


def join_subject(df: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
    return df.join(other, ["subject_type", "subject_id"], how)
