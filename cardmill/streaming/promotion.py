"""New cards enter the identity graph batch by batch; what a batch changes is merged into stored tables by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardmill.operators.fields import live
from cardmill.operators.graph import Graph, promote_more
from cardmill.session import written
from cardmill.sources.segments import Segments

STREAM = "promotion"
#: Key of endpoints that no card asserts.
BY_HAND = -1

KEYS = {
    "people": ["id"], "organizations": ["id"], "roles": ["id"], "branches": ["id"], "cards": ["id"],
    "contact_points": ["card_key"], "overlaps": ["a_id", "b_id"], "batches": ["batch_id"],
}
EMPTY = {
    "people": "id long, display_name string, merged_into_id long",
    "organizations": "id long, name string, domain string",
    "roles": "id long, person_id long, org_id long, title string, is_current boolean",
    "branches": "id long, org_id long, address string, is_primary boolean",
    "contact_points": "owner_type string, owner_id long, kind string, value string, normalized_value string, label string, "
    "role_id long, source_card_id long, source string, ord long, field_id long",
    "cards": "id long, captured_at timestamp, deleted_at timestamp, person_id long, org_id long, role_id long",
    "overlaps": "a_id long, b_id long, score double",
}


def graph_store(spark: SparkSession, path: str) -> Segments:
    """The tables of a graph, and ``batches``: what each batch promoted, and the ids it gave."""
    return Segments(spark, path, KEYS)


def stored_graph(store: Segments) -> Graph:
    tables = {}
    for name, schema in EMPTY.items():
        tables[name] = store.read(name) if store.has(name) else store.spark.createDataFrame([], schema)
    tables["contact_points"] = tables["contact_points"].drop("card_key")
    return Graph(**tables)


def _delta(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, keys) of the keys whose rows are not the same before and after."""
    columns = new.columns

    def sums(df: DataFrame, side: str) -> DataFrame:
        digest = F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))
        return df.groupBy(*keys).agg(F.struct(digest.alias("sum"), F.count("*").alias("n")).alias(side))

    both = sums(old.select(*columns), "_old").join(sums(new, "_new"), keys, "full")
    touched = written(both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys))
    return new.join(touched, keys, "left_semi"), touched


def promote_batch(store: Segments, cards: DataFrame, fields: DataFrame, batch_id: int, settled: DataFrame | None = None) -> bool:
    """Promotes one batch of cards (id, captured_at, deleted_at), newest capture first; False if it was applied before.

    ``fields`` holds the fields of these cards at least. Ids go on from the largest stored one, so a batch that died before
    its commit gives the same ids when it runs again. Cards that are deleted are known, but stay without links. The graph,
    the ledger row and the number of the batch become visible together.
    """
    if batch_id <= store.applied(STREAM):
        return False
    before = stored_graph(store)
    arrived = written(
        cards.dropna(subset=["id"])
        .groupBy("id")
        .agg(F.max_by(F.struct("captured_at", "deleted_at"), F.struct("captured_at", "deleted_at")).alias("c"))
        .select("id", "c.*")
    )
    links = before.cards.select("id", "person_id", "org_id", "role_id")
    merged = before.cards.join(arrived, "id", "left_anti").unionByName(arrived.join(links, "id", "left"))
    due = live(arrived).select("id", "captured_at")
    own = written(fields.join(due.select(F.col("id").alias("card_id")), "card_id", "left_semi"))
    grown = promote_more(before.with_(cards=merged), due, own, settled)
    changes, first = {}, {}
    for name, new in grown.tables().items():
        old = getattr(before, name)
        if name == "contact_points":
            key = F.coalesce("source_card_id", F.lit(BY_HAND).cast("long"))
            old, new = old.withColumn("card_key", key), new.withColumn("card_key", key)
        columns = old.columns
        changes[name] = _delta(old, written(new.select(*columns)), KEYS[name])
    for name in ("people", "organizations"):
        founded = changes[name][0].select("id").join(getattr(before, name).select("id"), "id", "left_anti")
        first[name] = founded.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).first()
    ids = [r for r in first.values() if r["n"]]
    ledger = store.spark.createDataFrame(
        [(batch_id, due.count(), sum(r["n"] for r in ids), min((r["a"] for r in ids), default=None), max((r["b"] for r in ids), default=None))],
        "batch_id long, promoted long, founded long, first_id long, last_id long",
    )
    return store.commit(STREAM, batch_id, {**changes, "batches": (ledger, None)})


def promotion_stream(cards: DataFrame, fields: DataFrame, store: Segments, checkpoint: str) -> StreamingQuery:
    """Cards as a stream, their fields as a table that is there when a card arrives."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        promote_batch(store, batch, fields, batch_id)
        store.compact()

    writer = cards.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
