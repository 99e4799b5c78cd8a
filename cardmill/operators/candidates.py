"""Duplicate candidates: pairs of people proposed once, ruled on by a user, and shown by page with both halves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.operators.fields import live
from cardmill.operators.graph import person_subtitles, settled_pairs
from cardmill.operators.ordering import global_position
from cardmill.operators.resolve import SAME_NAME_SCORE, SHARED_CONTACT_SCORE

#: The states of a candidate, and the signals of the two kinds of proposals.
PENDING, LINKED, REJECTED = "pending", "linked", "rejected"
SAME_NAME, SHARED_CONTACTS = "same name", "shared contacts"
SCHEMA = "id long, a_id long, b_id long, score double, signals_json string, status string"


def shared_contact_proposals(overlaps: DataFrame) -> DataFrame:
    """Proposals from pairs of people found by one card's endpoints."""
    return overlaps.select("a_id", "b_id", F.lit(SHARED_CONTACT_SCORE).alias("score"), F.array(F.lit(SHARED_CONTACTS)).alias("signals"))


def same_name_proposals(pairs: DataFrame) -> DataFrame:
    """Proposals from a page of same-name pairs, or from the pairs of given people: never all pairs of a common name."""
    return pairs.select("a_id", "b_id", F.lit(SAME_NAME_SCORE).alias("score"), F.array(F.lit(SAME_NAME)).alias("signals"))


def propose(candidates: DataFrame, proposals: DataFrame) -> DataFrame:
    """Candidates with the proposals (a_id, b_id, score, signals) that were never made before.

    A pair is one pair whichever half comes first; nobody is a candidate with themselves. A pair that is there stays as it
    is whatever its state: neither its score changes nor does a ruling come up again. Of several new proposals of a pair
    the one of the lowest score counts, since names are proposed when a person appears and contacts later. New pairs are
    numbered after all others, by their halves.
    """
    lo, hi = F.least("a_id", "b_id"), F.greatest("a_id", "b_id")
    new = (
        proposals.filter(F.col("a_id") != F.col("b_id"))
        .groupBy(lo.alias("a_id"), hi.alias("b_id"))
        .agg(F.min_by(F.struct("score", F.to_json("signals").alias("signals_json")), F.struct("score", F.to_json("signals"))).alias("p"))
    )
    merged = candidates.join(new, ["a_id", "b_id"], "full")
    fresh = merged.filter(F.col("id").isNull()).select("a_id", "b_id", "p.score", "p.signals_json")
    top = candidates.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).select("top").scalar()
    numbered = global_position(fresh, [F.asc("a_id"), F.asc("b_id")], "place").withColumn("id", F.col("place") + 1 + top)
    return candidates.unionByName(numbered.select("id", "a_id", "b_id", "score", "signals_json", F.lit(PENDING).alias("status")))


def settle(candidates: DataFrame, rulings: DataFrame) -> DataFrame:
    """States after a log of (seq, action merge | separate | unmerge, survivor_id, loser_id).

    The last merge or separate of a pair decides; taking a merge back leaves the pair settled. Rulings on pairs that were
    never proposed leave no candidate.
    """
    ruled = settled_pairs(rulings).select("a_id", "b_id", F.col("status").alias("_ruled"))
    return candidates.join(ruled, ["a_id", "b_id"], "left").select(
        "id", "a_id", "b_id", "score", "signals_json", F.coalesce("_ruled", "status").alias("status")
    )


def without_gone(candidates: DataFrame, people: DataFrame) -> DataFrame:
    """Candidates both halves of which still exist."""
    ids = people.select("id")
    for half in ("a_id", "b_id"):
        candidates = candidates.join(ids.withColumnRenamed("id", half), half, "left_semi")
    return candidates.select("id", "a_id", "b_id", "score", "signals_json", "status")


def pending_page(
    candidates: DataFrame, people: DataFrame, cards: DataFrame, roles: DataFrame, orgs: DataFrame, points: DataFrame,
    offset: int = 0, limit: int = 100,
) -> DataFrame:
    """(position, id, score, signals_json, and id, name, card count and subtitle of either half), best score first.

    Pairs with a half that is gone or merged away are no question any more. Only the people of the page are summed up.
    """
    standing = people.filter(F.col("merged_into_id").isNull()).select("id")
    asked = candidates.filter(F.col("status") == PENDING)
    for half in ("a_id", "b_id"):
        asked = asked.join(standing.withColumnRenamed("id", half), half, "left_semi")
    placed = global_position(asked, [F.desc("score"), F.asc("id")], "position")
    page = placed.filter((F.col("position") >= offset) & (F.col("position") < offset + limit))
    shown = page.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct()
    own = people.join(shown, "id", "left_semi")
    merged = people.join(shown.withColumnRenamed("id", "merged_into_id"), "merged_into_id", "left_semi").select(*people.columns)
    counts = live(cards).join(shown.withColumnRenamed("id", "person_id"), "person_id", "left_semi")
    counts = counts.groupBy(F.col("person_id").alias("id")).agg(F.countDistinct(F.col("id")).alias("n"))
    subtitles = person_subtitles(own.unionByName(merged), roles, orgs, points)
    about = own.join(counts, "id", "left").join(subtitles, "id", "left")

    def half(side: str) -> DataFrame:
        return about.select(
            F.col("id").alias(f"{side}_id"),
            F.col("display_name").alias(f"{side}_name"),
            F.coalesce("n", F.lit(0)).alias(f"{side}_cards"),
            F.col("subtitle").alias(f"{side}_subtitle"),
        )

    rows = page.select("position", "id", "score", "signals_json", "a_id", "b_id")
    return rows.join(half("a"), "a_id").join(half("b"), "b_id")
