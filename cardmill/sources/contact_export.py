"""Contact files: one vCard text per person or organization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.functions.text import trim
from cardmill.functions.vcard import safe_file_name, vcard
from cardmill.operators.fields import keep_first
from cardmill.operators.graph import Graph, distinct_endpoints

_ENDPOINTS = "array<struct<kind:string,value:string,label:string>>"


def _texts(df: DataFrame, kind: str) -> DataFrame:
    return df.select(
        F.lit(kind).alias("owner_type"),
        "id",
        safe_file_name(F.col("name")).alias("file_name"),
        vcard(
            *[F.col(c) for c in ("name", "organization", "title", "address", "website", "note")],
            F.coalesce("endpoints", F.array().cast(_ENDPOINTS)),
        ).alias("vcard"),
    )


def person_cards(graph: Graph) -> DataFrame:
    """Listed people: first role for organization and title, each endpoint once with its first role's label."""
    survivors = graph.people.select(
        F.col("id").alias("person_id"), F.coalesce("merged_into_id", "id").alias("survivor_id")
    )
    jobs = (
        graph.roles.withColumnRenamed("id", "role_id")
        .join(survivors, "person_id")
        .join(graph.organizations.select(F.col("id").alias("org_id"), F.col("name").alias("org_name")), "org_id")
        .select("survivor_id", "role_id", "org_name", "title", "is_current")
    )
    first_job = jobs.groupBy("survivor_id").agg(
        F.min_by(F.struct("org_name", "title"), F.struct(~F.col("is_current"), F.col("role_id"))).alias("job")
    )
    points = (
        graph.contact_points.filter(F.col("owner_type") == "person")
        .withColumnRenamed("owner_id", "person_id")
        .join(survivors, "person_id")
        .join(jobs.select("role_id", "org_name", "is_current"), "role_id", "left")
        .select(
            "survivor_id",
            "kind",
            "value",
            F.coalesce("normalized_value", trim(F.col("value"))).alias("identity"),
            F.coalesce("label", "org_name").alias("label"),
            # Endpoints of roles come first in role order, loose ones after them.
            F.col("org_name").isNull().alias("loose"),
            (~F.coalesce("is_current", F.lit(False))).alias("past"),
            F.coalesce("role_id", F.lit(0)).alias("role"),
            "ord",
            "field_id",
        )
    )
    order = ["loose", "past", "role", "ord", "field_id"]
    endpoints = (
        keep_first(points, ["survivor_id", "kind", "identity"], order)
        .groupBy("survivor_id")
        .agg(F.array_sort(F.collect_list(F.struct(*order, "kind", "value", "label"))).alias("e"))
        .select("survivor_id", F.transform("e", lambda e: F.struct(e["kind"], e["value"], e["label"])).cast(_ENDPOINTS).alias("endpoints"))
    )
    none = F.lit(None).cast("string")
    note = F.col("relationship") if "relationship" in graph.people.columns else none
    people = graph.people.filter(F.col("merged_into_id").isNull()).select(
        F.col("id").alias("survivor_id"), F.col("display_name").alias("name"), note.alias("note")
    )
    return _texts(
        people.join(first_job, "survivor_id", "left")
        .join(endpoints, "survivor_id", "left")
        .select(
            F.col("survivor_id").alias("id"), "name", F.col("job.org_name").alias("organization"),
            F.col("job.title").alias("title"), none.alias("address"), none.alias("website"), "note", "endpoints",
        ),
        "person",
    )


def organization_cards(graph: Graph) -> DataFrame:
    own = graph.contact_points.filter(F.col("owner_type") == "organization").withColumnRenamed("owner_id", "id")
    endpoints = (
        distinct_endpoints(own.select("id", "ord", "field_id", "kind", "value", "normalized_value", "label"), "id")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "field_id", "kind", "value", "label"))).alias("e"))
        .select("id", F.transform("e", lambda e: F.struct(e["kind"], e["value"], e["label"])).cast(_ENDPOINTS).alias("endpoints"))
    )
    branch = graph.branches.groupBy(F.col("org_id").alias("id")).agg(
        F.min_by("address", F.struct(~F.col("is_primary"), F.col("id"))).alias("address")
    )
    none = F.lit(None).cast("string")
    return _texts(
        graph.organizations.join(endpoints, "id", "left")
        .join(branch, "id", "left")
        .select(
            "id", "name", F.col("name").alias("organization"), none.alias("title"), "address",
            F.col("domain").alias("website"), none.alias("note"), "endpoints",
        ),
        "organization",
    )


def write_contact_cards(cards: DataFrame, path: str) -> None:
    """Text files of concatenated contacts; each contact already ends with its line break."""
    cards.select(F.regexp_replace("vcard", "\r\n$", "").alias("value")).write.mode("overwrite").option(
        "lineSep", "\r\n"
    ).text(path)
