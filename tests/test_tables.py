"""Evaluation, cues, lifecycle, graph, export, sources and streaming on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from cardmill.operators import contacts, cues, evaluation, fields as FL, graph as G, lifecycle
from cardmill.sources import contact_export, evaluation_files, tables
from cardmill.sources.schemas import SCHEMAS
from cardmill.streaming import jobs


def ts(text):
    return F.lit(text).cast("timestamp")


# --- evaluation ----------------------------------------------------------------------------------


def test_eval_files_to_report(spark, tmp_path):
    run = lambda e, ms, text, f, n: {"engine": e, "durationMs": ms, "plainText": text, "fields": f, "blockCount": n, "failure": None}
    results = {"cards": [
        {"image": "a.jpg", "results": [run("routed", 100, "abc", {"phone": "+88 1", "company": "X"}, 3), run("fast", 10, "", {}, 0)]},
        {"image": "b.jpg", "results": [run("routed", 300, "q", {"phone": "2"}, 1)]},
        {"image": "c.jpg", "results": [run("routed", 200, "zz", {}, 0)]},
        {"image": "nolabel.jpg", "results": [run("routed", 999, "zz", {}, 1)]},
    ]}
    labels = {
        "a.jpg": {"script": "latin", "rawText": "abd", "fields": {"phone": "+88  1 ", "company": "y", "address": "h"}},
        "b.jpg": {"script": "Mixed", "fields": {"phone": "2"}},
        "c.jpg": {"script": "bengali", "rawText": "zz", "fields": {"phone": None}},
    }
    (tmp_path / "r.json").write_text(json.dumps(results))
    (tmp_path / "l.json").write_text(json.dumps(labels, indent=1))
    r, l = evaluation_files.read_eval_results(spark, str(tmp_path / "r.json")), evaluation_files.read_eval_labels(spark, str(tmp_path / "l.json"))
    scores = {(x.engine, x.bucket, x.field_key): (x.tp, x.fp, x.fn) for x in evaluation.field_scores(r, l).collect()}
    assert scores[("routed", "all", "phone")] == (2, 0, 0) and scores[("routed", "all", "company")] == (0, 1, 1)
    assert scores[("routed", "latin", "address")] == (0, 0, 1) and scores[("routed", "bengali", "phone")] == (1, 0, 0)
    report = {x.engine: x for x in evaluation.engine_report(r, l).collect()}
    routed = report["routed"]
    assert routed.cards == 3 and abs(routed.mean_cer - (1 / 3) / 3) < 1e-12 and abs(routed.mean_cer_labelled - 1 / 6) < 1e-12
    assert routed.mean_ms == 200 and routed.p90_ms == 300 and abs(routed.failure_rate - 1 / 3) < 1e-12
    assert routed.f1_bengali == 1.0 and report["fast"].f1_bengali == 0.0
    assert evaluation.quality_gate(evaluation.engine_report(r, l)).first().passes
    assert [x.image for x in evaluation.unlabelled(r, l).collect()] == ["nolabel.jpg"]
    text = {x.engine: x.report for x in evaluation_files.format_report(evaluation.engine_report(r, l), evaluation.field_scores(r, l)).collect()}
    assert "Latency: mean 200ms, p90 300ms" in text["routed"] and "  phone  P=1.000  R=1.000  F1=1.000  n=2" in text["routed"]
    evaluation_files.write_eval_report(evaluation.engine_report(r, l), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_field_scores_sort_no_results(spark):
    """A task holds the labels alone, and a value in two buckets is compared once."""
    r = spark.createDataFrame([("a", "e", {"k": "v"}), ("a", "f", {"k": "w"}), ("b", "e", {"k": "V "})], "image string, engine string, fields map<string,string>")
    l = spark.createDataFrame([("a", None, None, {"k": "v"}), ("b", "x", None, {"k": "v"})], "image string, script string, raw_text string, fields map<string,string>")
    scores = evaluation.field_scores(r, l)
    got = {(x.engine, x.bucket): (x.tp, x.fp, x.fn) for x in scores.collect()}
    assert got == {("e", "all"): (2, 0, 0), ("e", "latin"): (1, 0, 0), ("e", "bengali"): (1, 0, 0), ("f", "all"): (0, 1, 1), ("f", "latin"): (0, 1, 1)}
    plan = scores._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


@pytest.mark.parametrize("values", [[5], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [7, 7, 7, 1], list(range(0, 997, 3)) * 3, [0.5, 100.25, 3.0]])
def test_nearest_percentile(spark, values):
    df = spark.createDataFrame([("e", float(v)) for v in values], "g string, v double")
    s = sorted(map(float, values))
    assert evaluation.nearest_percentile(df, "g", "v").first().percentile == s[int((len(s) - 1) * 0.9 + 0.5)]


# --- cues ----------------------------------------------------------------------------------------


def test_cues(spark):
    texts = ["offset printing and banner press", "stationery and books", "dental clinic", "wedding decor and lighting", "Rahim Uddin, 01711223344", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r.category for r in cues.classify_cues(df, "id", "t").orderBy("id").collect()] == ["printing", "books", "medical", "events", None, None]
    assert cues.classify_cues(df.filter("id = 2"), "id", "t", labels=["zz", "dental"]).first().category == "dental"
    note = "Cheap for small orders. Printed our CSE Fest shirts. Quality good but delivery was two days late."
    got = cues.attribute_cues(spark.createDataFrame([(1, note), (2, "Met at the CSE fair.")], "id int, n string"), "id", "n").collect()
    assert {(r.id, r.key, r.value) for r in got} == {(1, "price_tier", "cheap"), (1, "min_order", "low"), (1, "delivery_reliability", "late"), (1, "quality", "good")}
    profiles = cues.build_profiles(spark.createDataFrame([(1, "press", "cheap"), (2, " ", None)], "subject_id long, card_text string, note_text string")).collect()
    assert [(p.subject_id, p.canonical_en, p.categories) for p in profiles] == [(1, "press\ncheap", ["printing"])]


# --- lifecycle -----------------------------------------------------------------------------------

FIELD = "id long, card_id long, field_key string, value string, normalized_value string, source string, verified_by_user boolean, validation_issue string"


def test_corrections_and_reextraction(spark):
    fields = spark.createDataFrame([(1, 1, "company", "Pet Shop", None, "printed", False, None), (2, 1, "phone", "01711", None, "printed", False, "tooShort"), (3, 1, "email", "x", None, "printed", False, None)], FIELD)
    edits = spark.createDataFrame(
        [(1, "2024-01-01", 1, "wrong", None, False), (1, "2024-01-02", 2, "AQUARIUS Pet Shop", None, False), (2, "2024-01-01", 3, "01711223344", None, False), (3, "2024-01-01", 4, None, None, True)],
        "field_id long, at string, seq long, value string, field_key string, deleted boolean",
    )
    got = {r.id: r for r in lifecycle.apply_edits(fields, edits).collect()}
    assert set(got) == {1, 2} and got[1].value == "AQUARIUS Pet Shop" and got[1].source == "user" and got[1].verified_by_user
    assert got[2].normalized_value == "+8801711223344" and got[2].validation_issue is None
    again = spark.createDataFrame([(9, 1, "company", "Pet Shop", None, "printed", False, None), (10, 1, "phone", "0191", None, "printed", False, "tooShort"), (11, 1, "website", "a.com", "a.com", "printed", False, None)], FIELD)
    after = lifecycle.upsert_extraction(lifecycle.apply_edits(fields, edits), again).collect()
    assert {(r.field_key, r.value) for r in after} == {("company", "AQUARIUS Pet Shop"), ("phone", "01711223344"), ("website", "a.com")}
    assert lifecycle.edit_interactions(fields, edits).count() == 4
    blocks = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "order_index int, field_id long").withColumn("assigned_field_key", F.lit("old"))
    released = {r.order_index: (r.field_id, r.assigned_field_key) for r in lifecycle.release_blocks(blocks, lifecycle.apply_edits(fields, edits)).collect()}
    assert released == {1: (1, "company"), 2: (None, None), 3: (None, None)}


def test_undo_window_edges(spark):
    at = lambda rows: spark.createDataFrame(rows, "id int, subject_id int, s double").select("id", "subject_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    deletes = at([(1, 1, 0.0), (2, 1, 4.9), (3, 2, 7.0), (4, 3, 3.0), (5, 4, 9.0), (6, 5, 2.0)])
    restores = at([(1, 1, 9.9), (2, 2, 12.000001), (3, 3, 2.9), (4, 4, 9.0), (5, 5, 1.0), (6, 5, 4.0)])
    assert {r.id for r in lifecycle.final_deletes(deletes, restores).collect()} == {1, 3, 4}


def event_files(spark, path):
    """One moment after the other dealt over eight files, so that every batch has late events."""
    rows = [(i, "error" if i % 3 else "signup", i % 4, i * 37 % 1000) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, user_id long, sec long").select(
        "event_id", "event_type", "user_id", F.timestamp_seconds("sec").alias("ts")
    )
    df.repartition(8, F.xxhash64("event_id")).write.parquet(path)
    return df


def test_delete_stream_loses_no_late_event(spark, tmp_path):
    df = event_files(spark, str(tmp_path / "in"))
    action = F.when(F.col("event_type") == "error", "delete").otherwise("restore")
    stream = jobs.read_changes(spark, str(tmp_path / "in"), files_per_batch=1).withColumn("action", action)
    jobs.final_delete_stream(stream, "user_id", str(tmp_path / "out"), str(tmp_path / "c"), seconds=20).awaitTermination()
    got = {r.delete_id for r in jobs.final_deletes_of(spark, "user_id", str(tmp_path / "out"), seconds=20).collect()}
    batch = lifecycle.final_deletes(df.filter("event_type = 'error'"), df.filter("event_type = 'signup'"), "user_id", 20)
    last = max(r.event_id * 37 % 1000 for r in df.collect())
    assert got == {r.event_id for r in batch.collect() if r.event_id * 37 % 1000 + 20 < last}


def test_changes_are_read_from_file_or_folder(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "folder.parquet"))
    part = next((tmp_path / "folder.parquet").glob("part-*.parquet"))
    (tmp_path / "both").mkdir()
    part.rename(tmp_path / "both" / "one.parquet")
    spark.range(5, 9).write.parquet(str(tmp_path / "both" / "other.parquet"))
    for k, name in enumerate(["one.parquet", "other.parquet"]):
        seen = []
        changes = jobs.read_changes(spark, str(tmp_path / "both" / name))
        jobs._run(changes, lambda b, _, seen=seen: seen.extend(r.id for r in b.collect()), str(tmp_path / f"c{k}")).awaitTermination()
        assert sorted(seen) == ([*range(5)], [*range(5, 9)])[k]


def test_merges_in_circles_end(spark):
    from cardmill.operators import graph

    people = spark.createDataFrame([(i,) for i in range(1, 8)], "id long").withColumn("merged_into_id", F.lit(None).cast("long"))
    log = [(1, "merge", 1, 2), (2, "merge", 2, 1), (3, "merge", 3, 4), (4, "merge", 4, 5), (5, "merge", 5, 3)]
    merged = graph.apply_decisions(people, spark.createDataFrame(log, "seq long, action string, survivor_id long, loser_id long"))
    pointers = {r.id: r.merged_into_id for r in merged.collect()}
    assert pointers[1] == 2 and pointers[2] is None
    survivors = {r.person_id: r.survivor_id for r in graph.survivor_map(merged).collect()}
    assert survivors[1] == survivors[2] == 2 and survivors[6] == 6 and len({survivors[k] for k in (3, 4, 5)}) == 1
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, None), (6, 4)], "id long, merged_into_id long")
    got = {r.person_id: r.survivor_id for r in graph.survivor_map(circle).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1}


def scan(spark, cards):
    """cards: list of dicts of field -> value; validated as extraction would."""
    rows, k = [], 0
    for i, card in enumerate(cards, 1):
        for key, value in card.items():
            k += 1
            rows.append((k, i, key, value))
    raw = spark.createDataFrame(rows, "id long, card_id long, field_key string, value string")
    fields = contacts.validate_fields(raw).withColumnRenamed("normalized", "normalized_value").withColumn("source", F.lit("printed")).withColumn("value_kind", F.lit("text"))
    card_rows = spark.range(1, len(cards) + 1).select("id", (ts("2024-01-01") + F.expr("make_interval(0,0,0,cast(id as int))")).alias("captured_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return card_rows, fields


@pytest.fixture(scope="module")
def graph(spark):
    cards = [
        {"person_name": "Md. Abul Bashar Sarker", "company": "Olympus Hospital", "phone": "01819104376", "designation": "Consultant", "address": "House 1, Dhaka"},
        {"person_name": "Abul Bashar Sarker", "company": "Green Specialized Hospital", "phone": "01819104376"},
        {"person_name": "Md. Rahman", "company": "Rahman Traders", "phone": "01711363991"},
        {"person_name": "Rahman", "company": "Rahman Motors", "phone": "01712000000"},
        {"person_name": "Truncated Number", "phone": "017098227"},
        {"company": "Techland BD", "website": "www.techlandbd.com", "phone": "01911000000", "address": "Shop 5, Dhaka"},
        {"company": "Techland Bangladesh Ltd", "website": "techlandbd.com", "address": " shop 5, dhaka"},
        {"company": "Aquarius Pet Shop"},
        {"company": "Aquarius Pet Shop Ltd."},
        {"website": "lonely.com"},
        {"person_name": "p", "email": "p_eal@yahoo.com"},
        {"person_name": "q", "email": "P_Eal@Yahoo.com"},
    ]
    made = G.promote_all(*scan(spark, cards))
    return made.with_(**{n: df.cache() for n, df in made.tables().items()})


def test_graph_scenarios(graph):
    people = {r.id: r.display_name for r in graph.people.collect()}
    assert people == {1: "Md. Abul Bashar Sarker", 3: "Md. Rahman", 4: "Rahman", 5: "Truncated Number", 11: "p"}
    links = {r.id: (r.person_id, r.org_id) for r in graph.cards.collect()}
    assert links[2] == (1, 2) and links[7] == (None, 6) and links[9] == (None, 8) and links[10] == (None, None) and links[12] == (11, None)
    roles = {(r.person_id, r.org_id): (r.id, r.title) for r in graph.roles.collect()}
    assert roles[(1, 1)] == (1, "Consultant") and (1, 2) in roles
    points = [(r.owner_type, r.owner_id, r.source_card_id) for r in graph.contact_points.collect()]
    assert ("organization", 6, 6) in points and not any(p[2] == 5 for p in points)
    branches = [(r.org_id, r.address, r.is_primary) for r in graph.branches.collect()]
    assert sorted(branches) == [(1, "House 1, Dhaka", True), (6, "Shop 5, Dhaka", True)]
    orgs = {r.id: (r.name, r.domain) for r in graph.organizations.collect()}
    assert orgs[6] == ("Techland BD", "techlandbd.com") and orgs[8] == ("Aquarius Pet Shop", None) and len(orgs) == 6
    assert [(r.name_key, r.position) for r in G.same_name_people(graph).filter("position > 1").collect()] == [("rahman", 2)]
    assert graph.overlaps.count() == 0


def test_lists_details_export(graph):
    listed = G.people_list(graph.people, graph.cards).collect()
    assert [(r.id, r.card_count) for r in listed] == [(11, 2), (5, 1), (4, 1), (3, 1), (1, 2)]
    subtitles = {r.id: r.subtitle for r in G.person_subtitles(graph.people, graph.roles, graph.organizations, graph.contact_points).collect()}
    assert subtitles[1] == "Consultant · Olympus Hospital  +1 more" and subtitles[11] == "p_eal@yahoo.com" and subtitles[5] is None
    detail = {r.id: r for r in G.person_details(graph, graph.people).collect()}
    assert [x.org_name for x in detail[1].roles] == ["Olympus Hospital", "Green Specialized Hospital"]
    assert [len(x.contacts) for x in detail[1].roles] == [1, 1] and detail[1].card_ids == [2, 1]
    assert [c.value for c in detail[11].loose_contacts] == ["p_eal@yahoo.com"]
    org = {r.id: r for r in G.org_details(graph, graph.organizations).collect()}
    assert org[6].addresses == ["Shop 5, Dhaka"] and len(org[6].contacts) == 1 and org[1].people[0].display_name == "Md. Abul Bashar Sarker"
    cards = {r.id: r for r in contact_export.person_cards(graph).collect()}
    assert cards[1].file_name == "Md_Abul_Bashar_Sarker" and cards[1].vcard.count("TEL;") == 1
    assert "ORG:Olympus Hospital\r\nTITLE:Consultant\r\nTEL;TYPE=WORK:01819104376\r\n" in cards[1].vcard
    org_card = {r.id: r.vcard for r in contact_export.organization_cards(graph).collect()}[6]
    assert "URL:techlandbd.com\r\nADR;TYPE=WORK:;;Shop 5\\, Dhaka;;;;\r\n" in org_card


def test_detail_rows_say_the_same(graph):
    rows = [(r.id, r.section, r.value) for r in G.person_sections(graph).collect()]
    assert (1, "role", "Consultant · Olympus Hospital") in rows and rows.count((1, "endpoint", "01819104376")) == 2
    assert {r[2] for r in rows if r[:2] == (1, "card")} == {"1", "2"}
    orgs = [(r.id, r.section, r.value) for r in G.org_sections(graph).collect()]
    assert (6, "branch", "Shop 5, Dhaka") in orgs and (1, "person", "Md. Abul Bashar Sarker · Consultant") in orgs


def edited(spark, fields, card, key, value):
    """The field table after one correction."""
    new = contacts.validate_fields(spark.createDataFrame([(card * 1000, card, key, value)], "id long, card_id long, field_key string, value string"))
    new = new.withColumnRenamed("normalized", "normalized_value").withColumn("source", F.lit("user")).withColumn("value_kind", F.lit("text"))
    return fields.filter(~((F.col("card_id") == card) & (F.col("field_key") == key))).unionByName(new)


def test_repromotion_keeps_merges_and_replaces_numbers(spark):
    cards, fields = scan(spark, [
        {"person_name": "Md. Rahman", "company": "Rahman Traders", "phone": "01711363991"},
        {"person_name": "Rahman", "company": "Rahman Motors", "phone": "017098227"},
        {"person_name": "Karim", "phone": "01711363991", "company": "Other"},
    ])
    keep = lambda g: g.with_(**{n: df.cache() for n, df in g.tables().items()})
    graph = keep(G.promote_all(cards, fields))
    log = spark.createDataFrame([(1, "merge", 1, 2)], "seq long, action string, survivor_id long, loser_id long")
    merged = keep(graph.with_(people=G.apply_decisions(graph.people, log)))
    due = lambda *ids: cards.filter(F.col("id").isin(*ids))
    # card 2 has no usable number, so it stays with whoever it was merged into
    again = keep(G.promote_more(merged, due(2), fields))
    assert {r.id: r.person_id for r in again.cards.collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.id: r.merged_into_id for r in again.people.collect()} == {1: None, 2: 1}
    assert {(r.person_id, r.org_id) for r in again.roles.collect()} == {(1, 1), (2, 2), (1, 2), (1, 3)}
    # a corrected number replaces the old one
    fixed = edited(spark, fields, 3, "phone", "01911556677")
    moved = keep(G.promote_more(graph, due(3), fixed))
    assert sorted((r.owner_id, r.value, r.source_card_id) for r in moved.contact_points.collect()) == [(1, "01711363991", 1), (1, "01911556677", 3)]
    # running it again changes nothing; a hand-added endpoint stays
    typed = moved.contact_points.limit(1).withColumn("source_card_id", F.lit(None).cast("long")).withColumn("value", F.lit("typed")).withColumn("normalized_value", F.lit("t@x.com"))
    twice = G.promote_more(moved.with_(contact_points=moved.contact_points.unionByName(typed)), due(1, 2, 3), fixed)
    assert sorted((r.owner_id, r.value) for r in twice.contact_points.collect()) == [(1, "01711363991"), (1, "01911556677"), (1, "typed")]
    # a new card arrives: a new person, numbered after everything that was there
    more_cards, more_fields = scan(spark, [{}, {}, {}, {"person_name": "Nila", "company": "Rahman Motors Ltd", "email": "nila@x.com", "address": "Road 1"}])
    grown = G.promote_more(moved.with_(cards=moved.cards.unionByName(more_cards.filter("id = 4").select("id", "captured_at", "deleted_at", *[F.lit(None).cast("long").alias(c) for c in ("person_id", "org_id", "role_id")]))), more_cards.filter("id = 4"), more_fields)
    nila = [r for r in grown.people.collect() if r.display_name == "Nila"]
    assert len(nila) == 1 and nila[0].id > 3 and {r.org_id for r in grown.cards.collect() if r.id == 4} == {2}
    assert [(r.org_id, r.is_primary) for r in grown.branches.collect()] == [(2, True)]


def test_merge_decisions(spark, graph):
    log = lambda rows: spark.createDataFrame(rows, "seq long, action string, survivor_id long, loser_id long")
    merged = graph.with_(people=G.apply_decisions(graph.people, log([(1, "merge", 3, 4)])))
    assert {r.id for r in G.people_list(merged.people, merged.cards).collect()} == {1, 3, 5, 11}
    detail = {r.id: r for r in G.person_details(merged, merged.people).collect()}
    assert len(detail[3].roles) == 2 and detail[3].merged_from == [4] and detail[3].card_ids == [4, 3]
    back = G.apply_decisions(graph.people, log([(1, "merge", 3, 4), (2, "unmerge", None, 4)]))
    assert back.filter("merged_into_id is not null").count() == 0
    chain = {r.id: r.merged_into_id for r in G.apply_decisions(graph.people, log([(1, "merge", 3, 4), (2, "merge", 1, 3), (3, "unmerge", None, 3), (4, "merge", 3, 5)])).collect()}
    assert chain == {1: None, 3: None, 4: 1, 5: 3, 11: None}
    hop = G.apply_decisions(graph.people, log([(1, "merge", 1, 3), (2, "merge", 3, 4)]))
    assert {r.person_id: r.survivor_id for r in G.survivor_map(hop).collect()}[4] == 1
    assert [(r.a_id, r.b_id, r.status) for r in G.settled_pairs(log([(1, "separate", 4, 3)])).collect()] == [(3, 4, "rejected")]


def test_detach_and_orphans(spark, graph):
    left = G.detach_cards(graph, spark.createDataFrame([(3,), (6,), (7,)], "id long"))
    assert {r.id for r in left.people.collect()} == {1, 4, 5, 11}
    assert 6 not in {r.id for r in left.organizations.collect()} and 3 not in {r.id for r in left.organizations.collect()}
    assert 6 not in {r.org_id for r in left.branches.collect()}
    kept = G.drop_orphans(graph.with_(people=graph.people.withColumn("merged_into_id", F.when(F.col("id") == 3, F.lit(4).cast("long"))), cards=graph.cards.limit(0), contact_points=graph.contact_points.limit(0)))
    assert {r.id for r in kept.people.collect()} == {3, 4} and [r.person_id for r in kept.roles.collect()] == [3]


def test_promotion_backfill_selection(spark, graph):
    points = graph.contact_points.select("source_card_id", F.when(F.col("source_card_id") != 4, F.col("normalized_value")).alias("normalized_value"))
    assert [r.id for r in FL.needs_promotion(graph.cards, points).collect()] == [10, 4]


# --- sources -------------------------------------------------------------------------------------


def test_typed_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "Rahim"), (2, "")], "id long, display_name string")
    old.write.parquet(str(tmp_path / "people"))
    read = tables.read_table(spark, str(tmp_path), "people")
    assert read.columns[:6] == ["id", "display_name", "photo_path", "relationship", "trust_score", "merged_into_id"]
    assert {r.id: r.ok for r in read.select("id", tables.validity("people").alias("ok")).collect()} == {1: True, 2: False}
    assert len(SCHEMAS) == 20
    kinds = spark.createDataFrame([("printed", "text"), ("rumour", "text")], "source string, value_kind string")
    assert [r.ok for r in kinds.select(tables.validity("card_fields").alias("ok")).collect()] == [True, False]


def test_vector_and_posting_sinks(spark, tmp_path):
    tables.write_vectors(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "subject_id long, vector array<float>"), str(tmp_path / "v"), "m")
    row = spark.read.parquet(str(tmp_path / "v")).first()
    assert (row.subject_id, row.dim, row.model) == (2, 2, "m")
    cards = spark.createDataFrame([("BEGIN:VCARD\r\nEND:VCARD\r\n",)] * 2, "vcard string").coalesce(1)
    contact_export.write_contact_cards(cards, str(tmp_path / "c"))
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "c").glob("part-*"))
    assert text == "BEGIN:VCARD\r\nEND:VCARD\r\n" * 2


def test_percentile_of_skewed_values(spark, monkeypatch):
    from cardmill.operators import evaluation

    monkeypatch.setattr(evaluation, "ORDERED_WHOLE", 10)
    values = [i % 977 / 7 for i in range(30_000)] + [1e12]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0)], "g string, v double")
    got = {r.g: r.percentile for r in evaluation.nearest_percentile(df, "g", "v").collect()}
    assert got == {"a": sorted(values)[int((len(values) - 1) * 0.9 + 0.5)], "b": 3.0}


def test_keep_first_keeps_order_and_null_keys(spark):
    from cardmill.functions.text import keep_first

    items = [("b", 1), ("a", 2), (None, 3), ("b", 4), (None, 5), ("a", 6), ("c", 7)]
    df = spark.createDataFrame([(items,), ([],), (None,)], "x array<struct<k:string,n:int>>")
    got = df.select(keep_first(F.col("x"), lambda e: e["k"], "struct<k:string,n:int>").alias("y")).collect()
    assert [None if r.y is None else [e.n for e in r.y] for r in got] == [[1, 2, 3, 5, 7], [], None]
