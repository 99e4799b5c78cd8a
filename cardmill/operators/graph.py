"""The identity graph as tables: build, review decisions, clean-up, lists and details."""

from __future__ import annotations

from dataclasses import dataclass, fields as dataclass_fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.functions.text import blank_to_null, person_key, trim
from cardmill.operators.fields import identity_endpoints, keep_first, live, primary_branch
from cardmill.operators.ordering import global_position, position_in_group
from cardmill.operators.overlap import shared_counts
from cardmill.operators.resolve import (
    SHARED_CONTACT_SCORE,
    card_facts,
    endpoint_keys,
    name_creations,
    resolve_orgs,
    resolve_people,
)
from cardmill.session import by_shuffle, cut_lineage, written


@dataclass(frozen=True)
class Graph:
    """people(id, display_name, merged_into_id) · organizations(id, name, domain) · roles(id, person_id,
    org_id, title, is_current) · branches(id, org_id, address, is_primary) · contact_points(owner_type,
    owner_id, kind, value, normalized_value, label, role_id, source_card_id, source, ord, field_id) ·
    cards(id, captured_at, deleted_at, person_id, org_id, role_id) · overlaps(a_id, b_id, score)."""

    people: DataFrame
    organizations: DataFrame
    roles: DataFrame
    branches: DataFrame
    contact_points: DataFrame
    cards: DataFrame
    overlaps: DataFrame

    def with_(self, **tables: DataFrame) -> "Graph":
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in dataclass_fields(self)}


def build_roles(links: DataFrame) -> DataFrame:
    """One role per (person, organization); the first title said stays. Id = first card's turn."""
    return (
        links.filter(F.col("person_id").isNotNull() & F.col("org_id").isNotNull())
        .groupBy("person_id", "org_id")
        .agg(
            F.min("ord").alias("id"),
            F.min_by("designation", F.when(F.col("designation").isNotNull(), F.col("ord"))).alias("title"),
        )
        .select("id", "person_id", "org_id", "title", F.lit(True).alias("is_current"))
    )


def build_branches(links: DataFrame) -> DataFrame:
    """One branch per (organization, address without case); the organization's first is its primary."""
    rows = (
        links.filter(F.col("org_id").isNotNull() & F.col("address").isNotNull())
        .groupBy("org_id", F.lower(trim(F.col("address"))).alias("flat"))
        .agg(F.min("ord").alias("id"), F.min_by(trim(F.col("address")), "ord").alias("address"))
    )
    first = rows.groupBy("org_id").agg(F.min("id").alias("first_id"))
    return rows.join(first, "org_id").select(
        "id", "org_id", "address", (F.col("id") == F.col("first_id")).alias("is_primary")
    )


def build_endpoints(links: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per endpoint a card asserts: the person's if there is one, else the organization's."""
    asserted = identity_endpoints(fields).select(
        "card_id",
        F.col("id").alias("field_id"),
        F.col("field_key").alias("kind"),
        trim(F.col("value")).alias("value"),
        "normalized_value",
        "source",
    )
    owned = links.filter(F.col("person_id").isNotNull() | F.col("org_id").isNotNull())
    return asserted.join(by_shuffle(owned), "card_id").select(
        F.when(F.col("person_id").isNotNull(), "person").otherwise("organization").alias("owner_type"),
        F.coalesce("person_id", "org_id").alias("owner_id"),
        "kind",
        "value",
        "normalized_value",
        F.lit(None).cast("string").alias("label"),
        "role_id",
        F.col("card_id").alias("source_card_id"),
        "source",
        "ord",
        "field_id",
    )


def promote_all(cards: DataFrame, fields: DataFrame) -> Graph:
    """Fresh graph of all live cards, promoted in id order. Entity ids are the founding card's id."""
    active = live(cards).select("id", "captured_at", "deleted_at")
    # Facts and links feed every table of the graph: stored once.
    facts = written(
        card_facts(fields)
        .filter(~F.col("is_empty"))
        .join(by_shuffle(active.select(F.col("id").alias("card_id"))), "card_id", "left_semi")
        .withColumn("ord", F.col("card_id"))
    )
    orgs, domains = resolve_orgs(facts.select("card_id", "ord", "company", "domain"))
    people, overlaps = resolve_people(facts.select("card_id", "ord", "name"), endpoint_keys(fields))
    links = (
        facts.join(by_shuffle(orgs.select("card_id", "org_id")), "card_id", "left")
        .join(by_shuffle(people.select("card_id", "person_id")), "card_id", "left")
    )
    roles = build_roles(links)
    links = written(
        links.join(by_shuffle(roles.select(F.col("id").alias("role_id"), "person_id", "org_id")), ["person_id", "org_id"], "left")
    )
    founders = by_shuffle(facts.select(F.col("ord").alias("id"), "name", F.coalesce("company", "domain").alias("company")))
    return Graph(
        people=founders.join(people.filter("founded").select(F.col("person_id").alias("id")), "id").select(
            "id", F.col("name").alias("display_name"), F.lit(None).cast("long").alias("merged_into_id")
        ),
        organizations=founders.join(orgs.filter("founded").select(F.col("org_id").alias("id")), "id")
        .join(by_shuffle(domains.withColumnRenamed("org_id", "id")), "id", "left")
        .select("id", F.col("company").alias("name"), "domain"),
        roles=roles,
        branches=build_branches(links),
        contact_points=build_endpoints(links, fields),
        cards=active.join(
            by_shuffle(links.select(F.col("card_id").alias("id"), "person_id", "org_id", "role_id")), "id", "left"
        ),
        overlaps=_not_proposed_by_name(overlaps, facts).withColumn("score", F.lit(SHARED_CONTACT_SCORE)),
    )


def _not_proposed_by_name(overlaps: DataFrame, facts: DataFrame) -> DataFrame:
    """People of the same name were proposed when the later one was created; that proposal stays."""
    names = facts.select("ord", person_key(F.col("name")).alias("name_key"))
    a = names.select(F.col("ord").alias("a_id"), F.col("name_key").alias("a_key"))
    b = names.select(F.col("ord").alias("b_id"), F.col("name_key").alias("b_key"))
    joined = overlaps.join(by_shuffle(a), "a_id", "left").join(by_shuffle(b), "b_id", "left")
    return joined.filter(~F.coalesce(F.col("a_key") == F.col("b_key"), F.lit(False))).select("a_id", "b_id")


def promote_more(graph: Graph, due: DataFrame, fields: DataFrame, settled: DataFrame | None = None) -> Graph:
    """(Re-)promotes the ``due`` cards (id, captured_at) into a graph, newest capture first.

    Each card's old endpoints go on its turn; merges, links and people without a say in it stay. New
    entities are numbered after all existing ones, in promotion order.
    """
    queue = global_position(due.select(F.col("id").alias("card_id"), "captured_at"), [F.desc("captured_at"), F.asc("card_id")], "ord")
    base = max(
        df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for df in (graph.people, graph.organizations, graph.roles, graph.branches)
    ) + 1
    queued = queue.select("card_id", "ord").join(
        by_shuffle(graph.cards.select(F.col("id").alias("card_id"), F.col("person_id").alias("linked"))), "card_id", "left"
    )
    facts = written(card_facts(fields).filter(~F.col("is_empty")).join(by_shuffle(queued), "card_id"))
    points = graph.contact_points
    if "is_active" in points.columns:  # an endpoint that was taken out of use identifies nobody
        points = points.filter(F.coalesce(F.col("is_active").cast("boolean"), F.lit(True)))
    standing = points.filter((F.col("owner_type") == "person") & F.col("normalized_value").isNotNull()).select(
        F.col("normalized_value").alias("key"), F.col("owner_id").alias("person_id"), F.col("source_card_id").alias("card_id"))
    orgs, domains = resolve_orgs(
        facts.select("card_id", "ord", "company", "domain"),
        graph.organizations.select(F.col("id").alias("org_id"), "name", "domain"),
        base,
    )
    people, overlaps = resolve_people(
        facts.select("card_id", "ord", "name", "linked"), endpoint_keys(fields), standing,
        graph.people.select(F.col("id").alias("person_id"), F.coalesce("merged_into_id", "id").alias("survivor_id")), base,
    )
    links = written(
        facts.join(by_shuffle(orgs.select("card_id", "org_id")), "card_id", "left").join(
            by_shuffle(people.select("card_id", "person_id")), "card_id", "left"
        )
    )
    # Existing roles and branches come before any new one of the same identity; ids continue after them.
    said = links.withColumn("ord", F.col("ord") + base)
    known_roles = graph.roles.select("person_id", "org_id", F.col("id").alias("ord"), F.col("title").alias("designation"))
    current = graph.roles.select("id", "is_current")
    roles = written(
        build_roles(known_roles.unionByName(said.select("person_id", "org_id", "ord", "designation")))
        .drop("is_current")
        .join(current, "id", "left")
        .withColumn("is_current", F.coalesce("is_current", F.lit(True)))
    )
    known_branches = graph.branches.select("org_id", "address", F.col("id").alias("ord"), "is_primary")
    grown = build_branches(known_branches.drop("is_primary").unionByName(said.select("org_id", "address", "ord")))
    links = written(links.join(by_shuffle(roles.select(F.col("id").alias("role_id"), "person_id", "org_id")), ["person_id", "org_id"], "left"))
    turn = queue.select(F.col("card_id").alias("source_card_id")).distinct()
    old_points = graph.contact_points.join(turn, "source_card_id", "left_anti").select(*graph.contact_points.columns)
    founders = by_shuffle(facts.select((F.col("ord") + base).alias("id"), "name", F.coalesce("company", "domain").alias("company")))
    new_people = founders.join(people.filter("founded").select(F.col("person_id").alias("id")), "id").select(
        "id", F.col("name").alias("display_name"), F.lit(None).cast("long").alias("merged_into_id")
    )
    # A person without a name takes that of the first card that finds it; a name that stands is never replaced.
    given = links.filter(blank_to_null(F.col("name")).isNotNull() & F.col("person_id").isNotNull()).groupBy(F.col("person_id").alias("id"))
    given = given.agg(F.min_by("name", "ord").alias("_name"))
    old_people = graph.people.join(given, "id", "left").select(
        "id", F.coalesce(blank_to_null(F.col("display_name")), "_name", "display_name").alias("display_name"), "merged_into_id"
    )
    filled = domains.select(F.col("org_id").alias("id"), F.col("domain").alias("_domain"))
    old_orgs = graph.organizations.join(filled, "id", "left").withColumn("domain", F.coalesce("domain", "_domain")).drop("_domain")
    new_orgs = (
        founders.join(orgs.filter("founded").select(F.col("org_id").alias("id")), "id")
        .join(filled, "id", "left")
        .select("id", F.col("company").alias("name"), F.col("_domain").alias("domain"))
    )
    moved = queue.select(F.col("card_id").alias("id"), F.lit(True).alias("_due")).join(
        links.select(F.col("card_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("person_id", "org_id", "role_id")]), "id", "left"
    )
    cards = graph.cards.join(moved, "id", "left").select(
        *[
            F.when(F.col("_due"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("person_id", "org_id", "role_id") else F.col(c)
            for c in graph.cards.columns
        ]
    )
    fresh_pairs = overlaps.join(graph.overlaps.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    if settled is not None:
        fresh_pairs = fresh_pairs.join(settled.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    # The clean-up reads people, endpoints and cards for nearly every table: stored once.
    return drop_orphans(
        Graph(
            people=written(old_people.unionByName(new_people)),
            organizations=old_orgs.select("id", "name", "domain").unionByName(new_orgs),
            roles=roles.select(*graph.roles.columns),
            branches=grown.select(*graph.branches.columns),
            contact_points=written(old_points.unionByName(build_endpoints(links.withColumn("ord", F.col("ord") + base), fields))),
            cards=written(cards),
            overlaps=graph.overlaps.unionByName(fresh_pairs.withColumn("score", F.lit(SHARED_CONTACT_SCORE))),
        )
    )


# --- review decisions ----------------------------------------------------------------------------


def apply_decisions(people: DataFrame, decisions: DataFrame) -> DataFrame:
    """Merge pointers after a log of (seq, action merge|unmerge, survivor_id, loser_id).

    A row's own last decision sets its pointer; a later merge of the row it points at moves it along.
    """
    acts = decisions.filter(F.col("action").isin("merge", "unmerge") & ~F.col("survivor_id").eqNullSafe(F.col("loser_id")))
    own = acts.groupBy(F.col("loser_id").alias("id")).agg(
        F.max_by(F.struct(F.when(F.col("action") == "merge", F.col("survivor_id")).alias("to"), "seq"), "seq").alias("d")
    )
    pointers = own.select("id", F.col("d.to").alias("to"), F.col("d.seq").alias("seq")).filter(F.col("to").isNotNull())
    merges = acts.filter(F.col("action") == "merge").select(
        F.col("loser_id").alias("to"), F.col("survivor_id").alias("next"), F.col("seq").alias("at")
    )
    while True:
        later = (
            pointers.join(merges, "to")
            .filter(F.col("at") > F.col("seq"))
            .groupBy("id")
            .agg(F.min_by(F.struct("next", "at"), "at").alias("m"))
        )
        if later.isEmpty():
            break
        pointers = cut_lineage(
            pointers.join(later, "id", "left").select(
                "id", F.coalesce("m.next", "to").alias("to"), F.coalesce("m.at", "seq").alias("seq")
            )
        )
    # Opposite merges end in a row that points at itself: it stands for itself again.
    standing = pointers.filter(F.col("id") != F.col("to")).select("id", F.col("to").alias("merged_into_id"))
    return people.drop("merged_into_id").join(standing, "id", "left")


def survivor_map(people: DataFrame) -> DataFrame:
    """(person_id, survivor_id): pointers followed to the row that stands for the person.

    Paths double each round. Pointers that run in a circle have no such row: the smallest id of the circle counts.
    """
    to = F.coalesce("merged_into_id", "id")
    paths = people.select(F.col("id").alias("person_id"), to.alias("survivor_id"), F.least("id", to).alias("low"))
    pointing = people.filter(F.col("merged_into_id") != F.col("id")).select(F.col("id").alias("survivor_id"))
    for _ in range(pointing.count().bit_length() + 1):
        if paths.join(pointing, "survivor_id", "left_semi").isEmpty():
            return paths.select("person_id", "survivor_id")
        hop = paths.select(F.col("person_id").alias("survivor_id"), F.col("survivor_id").alias("next"), F.col("low").alias("next_low"))
        paths = cut_lineage(
            paths.join(hop, "survivor_id", "left").select(
                "person_id",
                F.coalesce("next", "survivor_id").alias("survivor_id"),
                F.least("low", F.coalesce("next_low", "low")).alias("low"),
            )
        )
    # What still ends at a pointing row ends in a circle, and that row's path has met the whole of it.
    ends = paths.join(pointing.withColumnRenamed("survivor_id", "person_id"), "person_id", "left_semi")
    circles = ends.select(F.col("person_id").alias("survivor_id"), F.col("low").alias("smallest"))
    return paths.join(circles, "survivor_id", "left").select("person_id", F.coalesce("smallest", "survivor_id").alias("survivor_id"))


def settled_pairs(decisions: DataFrame) -> DataFrame:
    """Pairs ruled on: linked or rejected, the latest ruling counts."""
    acts = decisions.filter(F.col("action").isin("merge", "separate"))
    return acts.groupBy(
        F.least("survivor_id", "loser_id").alias("a_id"), F.greatest("survivor_id", "loser_id").alias("b_id")
    ).agg(
        F.max_by(F.when(F.col("action") == "merge", "linked").otherwise("rejected"), "seq").alias("status")
    )


def pick_survivor(pairs: DataFrame) -> DataFrame:
    """The half with more cards survives; a tie keeps the first."""
    first = F.col("a_cards") >= F.col("b_cards")
    return pairs.withColumn("survivor_id", F.when(first, F.col("a_id")).otherwise(F.col("b_id"))).withColumn(
        "loser_id", F.when(first, F.col("b_id")).otherwise(F.col("a_id"))
    )


# --- clean-up ------------------------------------------------------------------------------------


def drop_orphans(graph: Graph) -> Graph:
    """Removes what nothing points at, in dependency order; merged rows and their survivors stay."""
    people, cards, points = graph.people, graph.cards, graph.contact_points

    def ids(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.filter(F.col(col).isNotNull()).select(F.col(col).alias(name))

    merged_away = people.filter(F.col("merged_into_id").isNotNull()).select(F.col("id").alias("person_id"))
    used_roles = ids(cards, "role_id", "id").union(ids(points, "role_id", "id"))
    roles = graph.roles.join(used_roles.distinct(), "id", "left_semi").unionByName(
        graph.roles.join(used_roles.distinct(), "id", "left_anti").join(merged_away, "person_id", "left_semi").select(*graph.roles.columns)
    )
    branches = graph.branches.join(ids(cards, "org_id", "org_id").distinct(), "org_id", "left_semi")
    owners = points.select("owner_type", "owner_id")
    used_people = (
        ids(cards, "person_id", "id")
        .union(owners.filter(F.col("owner_type") == "person").select("owner_id"))
        .union(ids(people, "merged_into_id", "id"))
        .union(merged_away)
    )
    kept_people = people.join(used_people.distinct(), "id", "left_semi")
    used_orgs = ids(cards, "org_id", "id").union(
        owners.filter(F.col("owner_type") == "organization").select("owner_id")
    )
    alive = kept_people.select("id")
    overlaps = graph.overlaps.join(alive.withColumnRenamed("id", "a_id"), "a_id", "left_semi").join(
        alive.withColumnRenamed("id", "b_id"), "b_id", "left_semi"
    )
    return graph.with_(
        roles=roles,
        branches=branches,
        people=kept_people,
        organizations=graph.organizations.join(used_orgs.distinct(), "id", "left_semi"),
        overlaps=overlaps,
    )


def detach_cards(graph: Graph, ids: DataFrame) -> Graph:
    """Withdraws the cards' endpoints and links, then cleans up."""
    gone = ids.select("id").distinct()
    points = graph.contact_points.join(gone.withColumnRenamed("id", "source_card_id"), "source_card_id", "left_anti")
    marked = graph.cards.join(gone.withColumn("_gone", F.lit(True)), "id", "left")
    nulled = marked.select(
        *[
            F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c in ("person_id", "org_id", "role_id") else F.col(c)
            for c in graph.cards.columns
        ]
    )
    return drop_orphans(graph.with_(contact_points=points.select(*graph.contact_points.columns), cards=nulled))


# --- lists and details ---------------------------------------------------------------------------


def people_list(people: DataFrame, cards: DataFrame) -> DataFrame:
    """Listed people with live-card count and last capture, most recent first."""
    seen = (
        live(cards)
        .filter(F.col("person_id").isNotNull())
        .groupBy(F.col("person_id").alias("id"))
        .agg(F.countDistinct(F.col("id")).alias("card_count"), F.max("captured_at").alias("last_seen"))
    )
    return (
        people.filter(F.col("merged_into_id").isNull())
        .join(seen, "id", "left")
        .select("id", "display_name", F.coalesce("card_count", F.lit(0)).alias("card_count"), "last_seen")
        .orderBy(F.desc_nulls_last("last_seen"), F.desc("id"))
    )


def org_list(orgs: DataFrame, cards: DataFrame, branches: DataFrame) -> DataFrame:
    seen = (
        live(cards)
        .filter(F.col("org_id").isNotNull())
        .groupBy(F.col("org_id").alias("id"))
        .agg(
            F.countDistinct("id").alias("card_count"),
            F.countDistinct("person_id").alias("people_count"),
            F.max("captured_at").alias("last_seen"),
        )
    )
    return (
        orgs.join(seen, "id", "left")
        .join(primary_branch(branches).withColumnRenamed("org_id", "id"), "id", "left")
        .select(
            "id",
            "name",
            F.coalesce("address", "domain").alias("subtitle"),
            F.coalesce("card_count", F.lit(0)).alias("card_count"),
            F.coalesce("people_count", F.lit(0)).alias("people_count"),
            "last_seen",
        )
        .orderBy(F.desc_nulls_last("last_seen"), F.desc("id"))
    )


def person_subtitles(people: DataFrame, roles: DataFrame, orgs: DataFrame, points: DataFrame) -> DataFrame:
    """'title · organization  +N more' from the person's and its merged rows' roles, else an endpoint."""
    survivors = people.select(F.col("id").alias("person_id"), F.coalesce("merged_into_id", "id").alias("id"))
    jobs = (
        roles.withColumnRenamed("id", "role_id")
        .join(survivors, "person_id")
        .join(orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org")), "org_id")
    )
    head = jobs.groupBy("id").agg(
        F.min_by(F.struct("title", "org"), F.struct(~F.col("is_current"), F.col("role_id"))).alias("job"),
        F.count("*").alias("n"),
    )
    reach = (
        points.filter(F.col("owner_type") == "person")
        .groupBy(F.col("owner_id").alias("id"))
        .agg(F.min_by("value", F.struct("ord", "field_id")).alias("endpoint"))
    )
    job = F.concat_ws(" · ", "job.title", "job.org")
    return (
        people.select("id")
        .join(head, "id", "left")
        .join(reach, "id", "left")
        .select(
            "id",
            F.when(F.col("n") > 1, F.concat(job, F.lit("  +"), (F.col("n") - 1).cast("string"), F.lit(" more")))
            .when(F.col("n") == 1, job)
            .otherwise(F.col("endpoint"))
            .alias("subtitle"),
        )
    )


def distinct_endpoints(points: DataFrame, *owner: str) -> DataFrame:
    """First row per (owner, kind, canonical or shown value)."""
    keyed = points.withColumn("_key", F.coalesce("normalized_value", "value"))
    return keep_first(keyed, [*owner, "kind", "_key"], ["ord", "field_id"]).drop("_key")


def _null_keyed(points: DataFrame) -> DataFrame:
    """Keeps rows without a role in one group of their own."""
    return points.withColumn("role_id", F.coalesce("role_id", F.lit(-1)))


def person_sections(graph: Graph) -> DataFrame:
    """Every listed person's detail as rows (id, section, sort, value): no list is ever built.

    Roles with title, the distinct endpoints under each role or loose, live cards, merged-in rows.
    """
    survivors = graph.people.select(F.col("id").alias("person_id"), F.coalesce("merged_into_id", "id").alias("id"))
    roles = (
        graph.roles.withColumnRenamed("id", "sort")
        .join(survivors, "person_id")
        .join(graph.organizations.select(F.col("id").alias("org_id"), F.col("name").alias("org")), "org_id")
        .select("id", F.lit("role").alias("section"), "sort", F.concat_ws(" · ", "title", "org").alias("value"))
    )
    mine = _null_keyed(
        graph.contact_points.filter(F.col("owner_type") == "person").withColumnRenamed("owner_id", "person_id").join(survivors, "person_id")
    )
    points = distinct_endpoints(
        mine.select("id", "role_id", "ord", "field_id", "kind", "value", "normalized_value"), "id", "role_id"
    ).select("id", F.lit("endpoint").alias("section"), F.col("role_id").alias("sort"), "value")
    cards = (
        live(graph.cards).withColumnRenamed("id", "card_id").join(survivors, "person_id")
        .select("id", F.lit("card").alias("section"), (-F.unix_micros("captured_at")).alias("sort"), F.col("card_id").cast("string").alias("value"))
    )
    merged = survivors.filter(F.col("person_id") != F.col("id")).select(
        "id", F.lit("merged").alias("section"), F.col("person_id").alias("sort"), F.col("person_id").cast("string").alias("value")
    )
    return roles.unionByName(points).unionByName(cards).unionByName(merged)


def org_sections(graph: Graph) -> DataFrame:
    """Every organization's detail as rows (id, section, sort, value)."""
    branches = graph.branches.select(
        F.col("org_id").alias("id"), F.lit("branch").alias("section"),
        F.when(F.col("is_primary"), F.lit(0)).otherwise(F.col("id")).cast("long").alias("sort"), F.col("address").alias("value"),
    )
    own = graph.contact_points.filter(F.col("owner_type") == "organization").withColumnRenamed("owner_id", "id")
    points = distinct_endpoints(own.select("id", "ord", "field_id", "kind", "value", "normalized_value"), "id").select(
        "id", F.lit("endpoint").alias("section"), F.col("ord").alias("sort"), "value"
    )
    people = (
        graph.roles.select(F.col("org_id").alias("id"), "person_id", "title").distinct()
        .join(graph.people.select(F.col("id").alias("person_id"), "display_name"), "person_id")
        .select("id", F.lit("person").alias("section"), F.col("person_id").alias("sort"), F.concat_ws(" · ", "display_name", "title").alias("value"))
    )
    cards = live(graph.cards).filter(F.col("org_id").isNotNull()).select(
        F.col("org_id").alias("id"), F.lit("card").alias("section"), (-F.unix_micros("captured_at")).alias("sort"), F.col("id").cast("string").alias("value")
    )
    return branches.unionByName(points).unionByName(people).unionByName(cards)


def person_details(graph: Graph, ids: DataFrame) -> DataFrame:
    """Nested detail of the few people a screen asks for: roles with endpoints, loose ones, cards, merged rows."""
    graph = graph.with_(
        people=graph.people.join(
            ids.select(F.col("id").alias("_asked")), F.coalesce("merged_into_id", "id") == F.col("_asked"), "left_semi"
        )
    )
    survivors = graph.people.select(
        F.col("id").alias("person_id"), F.coalesce("merged_into_id", "id").alias("survivor_id")
    )
    mine = _null_keyed(
        graph.contact_points.filter(F.col("owner_type") == "person")
        .withColumnRenamed("owner_id", "person_id")
        .join(survivors, "person_id")
    )
    endpoint = F.struct("ord", "field_id", "kind", "value", "normalized_value")
    per_role = (
        distinct_endpoints(mine.select("survivor_id", "role_id", "ord", "field_id", "kind", "value", "normalized_value"), "survivor_id", "role_id")
        .groupBy("survivor_id", "role_id")
        .agg(F.array_sort(F.collect_list(endpoint)).alias("contacts"))
    )
    none = F.array().cast("array<struct<ord:bigint,field_id:bigint,kind:string,value:string,normalized_value:string>>")
    roles = (
        graph.roles.withColumnRenamed("id", "role_id")
        .join(survivors, "person_id")
        .join(graph.organizations.select(F.col("id").alias("org_id"), F.col("name").alias("org_name")), "org_id")
        .join(per_role, ["survivor_id", "role_id"], "left")
        .groupBy("survivor_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (~F.col("is_current")).alias("past"), "role_id", "org_id", "org_name", "title",
                        F.coalesce("contacts", none).alias("contacts"),
                    )
                )
            ).alias("roles")
        )
    )
    loose = per_role.filter("role_id = -1").select("survivor_id", F.col("contacts").alias("loose_contacts"))
    cards = (
        live(graph.cards)
        .filter(F.col("person_id").isNotNull())
        .join(survivors, "person_id")
        .groupBy("survivor_id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("captured_at")).alias("k"), "id"))).alias("c"))
        .select("survivor_id", F.col("c.id").alias("card_ids"))
    )
    merged = (
        survivors.filter(F.col("person_id") != F.col("survivor_id"))
        .groupBy("survivor_id")
        .agg(F.array_sort(F.collect_list("person_id")).alias("merged_from"))
    )
    listed = graph.people.filter(F.col("merged_into_id").isNull()).select(
        F.col("id").alias("survivor_id"), "display_name"
    )
    return (
        listed.join(roles, "survivor_id", "left")
        .join(loose, "survivor_id", "left")
        .join(cards, "survivor_id", "left")
        .join(merged, "survivor_id", "left")
        .withColumnRenamed("survivor_id", "id")
    )


def org_details(graph: Graph, ids: DataFrame) -> DataFrame:
    """Nested detail of the few organizations a screen asks for: branches, endpoints, people, cards."""
    asked = ids.select("id").distinct()
    by_org = asked.withColumnRenamed("id", "org_id")
    graph = graph.with_(
        organizations=graph.organizations.join(asked, "id", "left_semi"),
        branches=graph.branches.join(by_org, "org_id", "left_semi"),
        roles=graph.roles.join(by_org, "org_id", "left_semi"),
        cards=graph.cards.join(by_org, "org_id", "left_semi"),
        contact_points=graph.contact_points.join(asked.withColumnRenamed("id", "owner_id"), "owner_id", "left_semi"),
    )
    branches = graph.branches.groupBy("org_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("k"), "id", "address"))),
            lambda b: b["address"],
        ).alias("addresses")
    )
    own = graph.contact_points.filter(F.col("owner_type") == "organization").withColumnRenamed("owner_id", "org_id")
    contacts = (
        distinct_endpoints(own.select("org_id", "ord", "field_id", "kind", "value", "normalized_value"), "org_id")
        .groupBy("org_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "field_id", "kind", "value", "normalized_value"))).alias("contacts"))
    )
    people = (
        graph.roles.select("org_id", "person_id", "title")
        .join(graph.people.select(F.col("id").alias("person_id"), "display_name"), "person_id")
        .groupBy("org_id")
        .agg(F.array_sort(F.collect_set(F.struct("display_name", "person_id", "title"))).alias("people"))
    )
    cards = (
        live(graph.cards)
        .filter(F.col("org_id").isNotNull())
        .groupBy("org_id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("captured_at")).alias("k"), "id"))).alias("c"))
        .select("org_id", F.col("c.id").alias("card_ids"))
    )
    return (
        graph.organizations.select(F.col("id").alias("org_id"), "name", "domain")
        .join(branches, "org_id", "left")
        .join(contacts, "org_id", "left")
        .join(people, "org_id", "left")
        .join(cards, "org_id", "left")
        .withColumnRenamed("org_id", "id")
    )


def pending_overlaps(graph: Graph, settled: DataFrame | None = None) -> DataFrame:
    """Unsettled shared-contact pairs whose halves both still stand, with card counts."""
    pairs = graph.overlaps
    if settled is not None:
        pairs = pairs.join(settled.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    listed = people_list(graph.people, graph.cards).select("id", "display_name", "card_count")

    def half(side: str) -> DataFrame:
        return listed.select(
            F.col("id").alias(f"{side}_id"), F.col("display_name").alias(f"{side}_name"), F.col("card_count").alias(f"{side}_cards")
        )

    return pairs.join(half("a"), "a_id").join(half("b"), "b_id").orderBy(F.desc("score"), "a_id", "b_id")


def same_name_people(graph: Graph) -> DataFrame:
    return name_creations(graph.people.select(F.col("id").alias("person_id"), "display_name"))


def endpoint_overlap(facts_keys: DataFrame, points: DataFrame) -> DataFrame:
    """(card_id, owner_id, n): endpoint rows each person shares with each card."""
    owned = (
        points.filter((F.col("owner_type") == "person") & F.col("normalized_value").isNotNull())
        .groupBy(F.col("normalized_value").alias("key"), "owner_id")
        .agg(F.count("*").alias("n"))
    )
    return shared_counts(facts_keys.select("card_id", "key"), owned)


def numbered_branches(branches: DataFrame) -> DataFrame:
    """Branches numbered within their organization; one of no organization has no number."""
    owned = position_in_group(branches.filter(F.col("org_id").isNotNull()), ["org_id"], "id", "branch_no")
    rest = branches.filter(F.col("org_id").isNull()).withColumn("branch_no", F.lit(None).cast(owned.schema["branch_no"].dataType))
    return owned.unionByName(rest)
