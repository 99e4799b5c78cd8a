"""Batch upserts: index refresh, re-extraction, corrections, soft delete, purge."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.functions.text import blank_to_null
from cardmill.operators.contacts import validate_fields
from cardmill.operators.fields import is_useful


def remove_subjects(index: DataFrame, ids: DataFrame, key: str = "subject_id") -> DataFrame:
    return index.join(ids.select(key).distinct(), key, "left_anti")


def refresh_index(index: DataFrame, changed_rows: DataFrame, changed_ids: DataFrame, key: str = "subject_id") -> DataFrame:
    """Delete-then-insert for the changed subjects; running it twice changes nothing."""
    return remove_subjects(index, changed_ids, key).unionByName(changed_rows)


def upsert_extraction(fields: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh fields replace unverified ones of the same cards; a verified key is never doubled."""
    rescanned = fresh.select("card_id").distinct()
    verified = fields.filter("verified_by_user")
    untouched = fields.filter(~F.col("verified_by_user")).join(rescanned, "card_id", "left_anti")
    settled = verified.select("card_id", "field_key").distinct()
    return (
        verified.unionByName(untouched).unionByName(fresh.join(settled, ["card_id", "field_key"], "left_anti"))
    )


def apply_edits(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Latest edit per field wins: (field_id, at, seq, value, field_key, deleted).

    An edited field becomes the user's own, verified and revalidated under its new key and value.
    """
    last = edits.groupBy(F.col("field_id").alias("id")).agg(
        F.max_by(F.struct("value", "field_key", "deleted"), F.struct("at", "seq")).alias("edit")
    )
    joined = fields.join(last, "id", "left").filter(~F.coalesce(F.col("edit.deleted"), F.lit(False)))
    edited = F.col("edit").isNotNull()
    moved = joined.withColumn("value", F.coalesce("edit.value", "value")).withColumn(
        "field_key", F.coalesce("edit.field_key", "field_key")
    )
    checked = validate_fields(moved)
    return (
        checked.withColumn("normalized_value", F.when(edited, F.col("normalized")).otherwise(F.col("normalized_value")))
        .withColumn("validation_issue", F.when(edited, F.col("issue")).otherwise(F.col("validation_issue")))
        .withColumn("source", F.when(edited, F.lit("user")).otherwise(F.col("source")))
        .withColumn("verified_by_user", edited | F.col("verified_by_user"))
        .select(*fields.columns)
    )


def edit_interactions(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """The interaction log every correction leaves behind."""
    return edits.join(fields.select(F.col("id").alias("field_id"), "card_id"), "field_id").select(
        F.lit("card").alias("subject_type"),
        F.col("card_id").alias("subject_id"),
        F.lit("edited").alias("kind"),
        F.col("at").alias("occurred_at"),
    )


def release_blocks(blocks: DataFrame, fields: DataFrame) -> DataFrame:
    """Blocks whose field no longer exists go back to being offered; labels follow the field's key."""
    owners = fields.select(F.col("id").alias("field_id"), F.col("field_key").alias("assigned_field_key"))
    return blocks.drop("assigned_field_key").join(owners, "field_id", "left").withColumn(
        "field_id", F.when(F.col("assigned_field_key").isNotNull(), F.col("field_id"))
    )


def winning_value(fields: DataFrame) -> DataFrame:
    """One value per card and key: verified first, then the user's, then printed, then the rest; oldest row last."""
    rank = (
        F.when(F.col("verified_by_user"), 0)
        .when(F.col("source") == "verified", 1)
        .when(F.col("source") == "user", 2)
        .when(F.col("source") == "printed", 3)
        .when(F.col("source") == "aiInferred", 4)
        .otherwise(5)
    )
    return fields.groupBy("card_id", "field_key").agg(F.min_by("value", F.struct(rank, "id")).alias("value"))


def apply_tombstones(cards: DataFrame, log: DataFrame) -> DataFrame:
    """Latest of delete / restore per card sets or clears ``deleted_at``; log is (id, action, at)."""
    last = log.groupBy("id").agg(F.max_by(F.struct("action", "at"), F.struct("at", "action")).alias("last"))
    return (
        cards.join(last, "id", "left")
        .withColumn(
            "deleted_at",
            F.when(F.col("last.action") == "delete", F.col("last.at"))
            .when(F.col("last.action") == "restore", F.lit(None).cast("timestamp"))
            .otherwise(F.col("deleted_at")),
        )
        .drop("last")
        .select(*cards.columns)
    )


def purge(tables: Mapping[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Removes the cards from every table given with the column that names the card there."""
    doomed = ids.select("id").distinct()
    return {
        name: df.join(doomed.withColumnRenamed("id", key), key, "left_anti") for name, (df, key) in tables.items()
    }


@dataclass(frozen=True)
class Edge:
    """Rows of ``table`` name a row of ``parent`` in ``column``; with ``when`` only the rows that it holds for do.

    When the parent's row goes they go too, or only lose the name if ``sets_null``.
    """

    table: str
    column: str
    parent: str
    key: str = "id"
    when: str | None = None
    sets_null: bool = False


#: Fixed by the data model: what belongs to a card, and blocks that lose their field.
CARD_EDGES = (
    Edge("card_fields", "card_id", "cards"),
    Edge("contact_points", "source_card_id", "cards"),
    Edge("ocr_blocks", "card_id", "cards"),
    Edge("ocr_blocks", "field_id", "card_fields", sets_null=True),
    Edge("extraction_attempts", "card_id", "cards"),
    Edge("notes", "subject_id", "cards", when="subject_type = 'card'"),
    Edge("postings", "subject_id", "cards"),
    Edge("vectors", "subject_id", "cards"),
)


def purge_cascade(
    tables: Mapping[str, DataFrame], doomed: Mapping[str, DataFrame], edges: Iterable[Edge] = CARD_EDGES
) -> dict[str, DataFrame]:
    """The tables without the doomed rows ({table: keys as ``id``}) and all that hangs on them, one anti-join per edge.

    Edges run from a row to the one it names, over any number of steps but not in a circle (ValueError). Edges of tables
    that are not given are left out. A row that names nothing stays.
    """
    edges = [e for e in edges if e.table in tables and e.parent in tables]
    order = TopologicalSorter({name: {e.parent for e in edges if e.table == name} for name in tables})
    try:
        names = list(order.static_order())
    except CycleError as error:
        raise ValueError(f"tables depend on each other in a circle: {error.args[1]}") from error
    left: dict[str, DataFrame] = {}
    gone: dict[tuple[str, str], DataFrame] = {}
    for name in names:
        rows, keys = tables[name], {e.key for e in edges if e.parent == name}
        lost: dict[str, list[DataFrame]] = {key: [] for key in keys}

        def take(rows: DataFrame, column: str, named: DataFrame, when: str | None, lost=lost) -> DataFrame:
            named = named.select(named.columns[0]).dropna().distinct().toDF("_gone")
            names_it = F.col(column) == F.col("_gone")
            names_it = names_it & F.expr(when) if when else names_it
            for key, parts in lost.items():
                parts.append(rows.join(named, names_it, "left_semi").select(F.col(key).alias("id")))
            return rows.join(named, names_it, "left_anti")

        if name in doomed:
            rows = take(rows, "id", doomed[name], None)
        for e in edges:
            if e.table != name:
                continue
            named = gone[e.parent, e.key]
            if not e.sets_null:
                rows = take(rows, e.column, named, e.when)
                continue
            marked = rows.join(named.dropna().distinct().toDF("_gone"), F.col(e.column) == F.col("_gone"), "left")
            kept = F.when(F.col("_gone").isNull(), F.col(e.column)).alias(e.column)
            rows = marked.select(*[kept if c == e.column else F.col(c) for c in rows.columns])
        left[name] = rows
        for key, parts in lost.items():
            empty = tables[name].select(F.col(key).alias("id")).limit(0)
            for part in parts:
                empty = empty.unionByName(part)
            gone[name, key] = empty
    return left


def extraction_status(cards: DataFrame, fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """manual when the user filled an unreadable card, else failed / complete / partial; pending without a read."""
    useful = is_useful(fields)
    typed = fields.groupBy("card_id").agg(F.max(F.col("source") == "user").alias("typed"))
    read = blocks.groupBy("card_id").agg(
        F.sum(blank_to_null(F.col("text")).isNotNull().cast("long")).alias("read")
    )
    status = (
        F.when(F.coalesce("read", F.lit(0)) == 0, F.when(F.col("typed"), "manual").when(F.col("read").isNull(), "pending").otherwise("failed"))
        .when(F.col("is_useful"), "complete")
        .otherwise("partial")
    )
    return (
        cards.select(F.col("id").alias("card_id"))
        .join(useful, "card_id", "left")
        .join(typed, "card_id", "left")
        .join(read, "card_id", "left")
        .select("card_id", status.alias("extraction_status"))
    )


def final_deletes(
    deletes: DataFrame, restores: DataFrame, key: str = "subject_id", seconds: int = fixed.UNDO_SECONDS
) -> DataFrame:
    """Deletes with no restore of the same subject within the window.

    Restores are reduced to their first and last moment per (subject, window-sized slot). A restore
    inside [t, t + window] lies in the slot of t (then it is the slot's last one or earlier) or in the
    next slot (then the slot's first one already counts), so two equi-joins decide every delete and a
    subject with very many events is spread over its slots.
    """
    width = seconds * 1_000_000
    at = F.unix_micros("ts")
    slots = restores.groupBy(key, F.floor(at / width).alias("slot")).agg(
        F.min(at).alias("first"), F.max(at).alias("last")
    )
    same = slots.select(key, "slot", F.col("last").alias("last_here"))
    following = slots.select(key, (F.col("slot") - 1).alias("slot"), F.col("first").alias("first_next"))
    undone = F.coalesce(F.col("last_here") >= at, F.lit(False)) | F.coalesce(
        F.col("first_next") <= at + width, F.lit(False)
    )
    return (
        deletes.withColumn("slot", F.floor(at / width))
        .join(same, [key, "slot"], "left")
        .join(following, [key, "slot"], "left")
        .filter(~undone)
        .select(*deletes.columns)
    )
