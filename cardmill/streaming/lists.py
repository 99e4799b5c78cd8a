"""People and organization lists kept up to date: a change of a card adds its difference to stored counts and maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardmill.operators.fields import live, primary_branch
from cardmill.session import written
from cardmill.sources.segments import Segments

CARD_COLUMNS = ["id", "captured_at", "deleted_at", "person_id", "org_id", "stamp"]
STREAM = "cards"


def list_store(spark: SparkSession, path: str) -> Segments:
    """cards by id · people_seen and orgs_seen by owner · org_people, the live cards of each person in each organization."""
    return Segments(
        spark, path, {"cards": ["id"], "people_seen": ["id"], "orgs_seen": ["id"], "org_people": ["org_id", "person_id"]}
    )


def _stored(store: Segments, table: str, keys: DataFrame, schema: str) -> DataFrame:
    return store.read(table, keys) if store.has(table) else store.spark.createDataFrame([], schema)


def _kept(new: DataFrame, old: DataFrame) -> DataFrame:
    """The newest change of each card, unless an even newer one is stored already."""
    newest = new.groupBy("id").agg(F.max_by(F.struct(*CARD_COLUMNS[1:]), F.struct("stamp", "captured_at")).alias("c"))
    known = old.select("id", F.col("stamp").alias("_stamp"))
    rows = newest.select("id", "c.*").join(known, "id", "left")
    return rows.filter(F.col("_stamp").isNull() | (F.col("stamp") >= F.col("_stamp"))).drop("_stamp")


def _seen(store: Segments, table: str, owner: str, moves: DataFrame, cards_now: DataFrame, more: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows, touched keys): card count and last capture of the owners that ``moves`` bears on.

    A capture that goes may have been the last one; only then the owner's cards are looked at again.
    """
    added, removed = F.when(F.col("sign") > 0, F.col("captured_at")), F.when(F.col("sign") < 0, F.col("captured_at"))
    delta = moves.filter(F.col(owner).isNotNull()).groupBy(F.col(owner).alias("id")).agg(
        F.sum("sign").alias("_n"), F.max(added).alias("_added"), F.max(removed).alias("_removed")
    )
    schema = "id long, card_count long, last_seen timestamp" + (", people_count long" if more is not None else "")
    joined = delta.join(_stored(store, table, delta, schema), "id", "left")
    if more is not None:
        joined = joined.join(more, "id", "left").withColumn(
            "people_count", F.coalesce("people_count", F.lit(0)) + F.coalesce("_people", F.lit(0))
        )
    covered = F.coalesce(F.col("_added") >= F.col("last_seen"), F.lit(False))
    joined = written(
        joined.withColumn("card_count", F.coalesce("card_count", F.lit(0)) + F.col("_n"))
        .withColumn("_unsure", F.coalesce(F.col("_removed") >= F.col("last_seen"), F.lit(False)) & ~covered)
        .withColumn("last_seen", F.greatest("last_seen", "_added"))
    )
    unsure = joined.filter("_unsure AND card_count > 0").select("id")
    if not unsure.isEmpty():
        again = live(cards_now).join(unsure.withColumnRenamed("id", owner), owner, "left_semi")
        again = again.groupBy(F.col(owner).alias("id")).agg(F.max("captured_at").alias("_again"))
        joined = joined.join(again, "id", "left").withColumn(
            "last_seen", F.when(F.col("_unsure"), F.col("_again")).otherwise(F.col("last_seen"))
        )
    columns = ["id", "card_count", "last_seen"] + (["people_count"] if more is not None else [])
    return joined.filter("card_count > 0").select(*columns), joined.select("id")


def apply_card_changes(store: Segments, changes: DataFrame, batch_id: int) -> bool:
    """One batch of card versions (id, captured_at, deleted_at, person_id, org_id, stamp); of a card the latest stamp counts.

    Only the touched cards, their owners before and after, and their pairs of organization and person are read and
    written. False if the batch was applied before.
    """
    if batch_id <= store.applied(STREAM):
        return False
    changes = changes.select(*CARD_COLUMNS).dropna(subset=["id", "stamp"])
    schema = "id long, captured_at timestamp, deleted_at timestamp, person_id long, org_id long, stamp long"
    before = written(_stored(store, "cards", changes, schema))
    after = written(_kept(changes, before))
    signed = lambda df, sign: live(df).select("person_id", "org_id", "captured_at", F.lit(sign).cast("long").alias("sign"))
    moves = written(signed(before.join(after, "id", "left_semi"), -1).unionByName(signed(after, 1)))
    cards_now = after if not store.has("cards") else store.read("cards").join(after, "id", "left_anti").unionByName(after)

    pair = ["org_id", "person_id"]
    delta = moves.dropna(subset=pair).groupBy(*pair).agg(F.sum("sign").alias("_n"))
    pairs = written(
        delta.join(_stored(store, "org_people", delta, "org_id long, person_id long, n long"), pair, "left")
        .withColumn("_old", F.coalesce("n", F.lit(0)))
        .withColumn("n", F.col("_old") + F.col("_n"))
    )
    came = (F.col("n") > 0).cast("long") - (F.col("_old") > 0).cast("long")
    people = pairs.groupBy(F.col("org_id").alias("id")).agg(F.sum(came).alias("_people"))
    return store.commit(
        STREAM,
        batch_id,
        {
            "cards": (after, None),
            "people_seen": _seen(store, "people_seen", "person_id", moves, cards_now, None),
            "orgs_seen": _seen(store, "orgs_seen", "org_id", moves, cards_now, people),
            "org_people": (pairs.filter("n > 0").select(*pair, "n"), pairs.select(*pair)),
        },
    )


def lists_stream(changes: DataFrame, store: Segments, checkpoint: str) -> StreamingQuery:
    """Applies a stream of card versions batch by batch; a replayed batch changes nothing."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_card_changes(store, batch, batch_id)
        store.compact()

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def kept_people_list(store: Segments, people: DataFrame) -> DataFrame:
    """``people_list`` from the stored counts."""
    seen = store.read("people_seen")
    return (
        people.filter(F.col("merged_into_id").isNull())
        .join(seen, "id", "left")
        .select("id", "display_name", F.coalesce("card_count", F.lit(0)).alias("card_count"), "last_seen")
        .orderBy(F.desc_nulls_last("last_seen"), F.desc("id"))
    )


def kept_org_list(store: Segments, orgs: DataFrame, branches: DataFrame) -> DataFrame:
    """``org_list`` from the stored counts."""
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        orgs.join(store.read("orgs_seen"), "id", "left")
        .join(primary_branch(branches).withColumnRenamed("org_id", "id"), "id", "left")
        .select("id", "name", F.coalesce("address", "domain").alias("subtitle"), count("card_count"), count("people_count"), "last_seen")
        .orderBy(F.desc_nulls_last("last_seen"), F.desc("id"))
    )
