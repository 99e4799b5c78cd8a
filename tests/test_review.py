"""Duplicate candidates over rounds of proposals and rulings; deletion along dependencies."""

import json

import pytest

from cardmill.operators import candidates as C
from cardmill.operators.lifecycle import Edge, purge_cascade

PAIR = "a_id long, b_id long, score double, signals array<string>"
LOG = "seq long, action string, survivor_id long, loser_id long"


def test_a_settled_pair_never_comes_back(spark):
    none = spark.createDataFrame([], C.SCHEMA)
    first = spark.createDataFrame([(2, 1, 1.0, ["shared contacts"]), (1, 2, 0.6, ["same name"]), (3, 3, 1.0, ["x"]), (4, 1, 1.0, ["shared contacts"])], PAIR)
    made = C.propose(none, first)
    rows = {(r["a_id"], r["b_id"]): r for r in made.collect()}
    assert {k: (r["id"], r["score"], json.loads(r["signals_json"]), r["status"]) for k, r in rows.items()} == {
        (1, 2): (1, 0.6, ["same name"], "pending"), (1, 4): (2, 1.0, ["shared contacts"], "pending"),
    }
    log = spark.createDataFrame([(1, "separate", 2, 1), (2, "merge", 1, 4), (3, "unmerge", 1, 4), (4, "merge", 7, 8)], LOG)
    ruled = C.settle(made, log)
    again = C.propose(ruled, spark.createDataFrame([(1, 2, 1.0, ["shared contacts"]), (5, 4, 1.0, ["shared contacts"])], PAIR))
    assert sorted((r["id"], r["a_id"], r["b_id"], r["score"], r["status"]) for r in again.collect()) == [
        (1, 1, 2, 0.6, "rejected"), (2, 1, 4, 1.0, "linked"), (3, 4, 5, 1.0, "pending"),
    ]
    late = C.settle(again, spark.createDataFrame([(9, "merge", 2, 1)], LOG))
    assert {r["id"]: r["status"] for r in late.collect()} == {1: "linked", 2: "linked", 3: "pending"}
    people = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    assert {r["id"] for r in C.without_gone(late, people).collect()} == {1, 2}
    assert C.propose(none, spark.createDataFrame([], PAIR)).count() == 0


def test_pending_page_sums_up_both_halves(spark):
    people = spark.createDataFrame([(1, "A", None), (2, "B", None), (3, "C", 1), (4, "D", None)], "id long, display_name string, merged_into_id long")
    cards = spark.createDataFrame([(10, 1, None), (11, 1, None), (12, 2, None)], "id long, person_id long, deleted_at timestamp")
    roles = spark.createDataFrame([(5, 1, 7, "Boss", True), (6, 3, 7, None, False)], "id long, person_id long, org_id long, title string, is_current boolean")
    orgs = spark.createDataFrame([(7, "Firm")], "id long, name string")
    points = spark.createDataFrame([("person", 4, "017", 1, 1)], "owner_type string, owner_id long, value string, ord long, field_id long")
    made = spark.createDataFrame(
        [(1, 1, 2, 0.6, "[]", "pending"), (2, 1, 3, 1.0, "[]", "pending"), (3, 2, 4, 1.0, "[]", "pending"), (4, 1, 4, 1.0, "[]", "linked"), (5, 2, 99, 1.0, "[]", "pending")],
        C.SCHEMA,
    )
    page = C.pending_page(made, people, cards, roles, orgs, points).orderBy("position").collect()
    assert [(r["position"], r["id"], r["a_name"], r["a_cards"], r["a_subtitle"], r["b_name"], r["b_cards"], r["b_subtitle"]) for r in page] == [
        (0, 3, "B", 1, None, "D", 0, "017"), (1, 1, "A", 2, "Boss · Firm  +1 more", "B", 1, None),
    ]
    assert [r["id"] for r in C.pending_page(made, people, cards, roles, orgs, points, 1, 1).collect()] == [1]


def test_purge_follows_every_edge(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "leaf": t([(1, 20), (2, 21), (3, None)], "id long, mid_id long"),
        "mid": t([(20, 5), (21, 6), (22, None)], "id long, root_id long"),
        "root": t([(5,), (6,), (None,)], "id long"),
        "tagged": t([(1, "root", 5), (2, "other", 5), (3, None, 5)], "id long, kind string, subject long"),
        "loose": t([(1, 20), (2, 21), (3, None), (4, 99)], "id long, mid_id long"),
    }
    edges = [
        Edge("leaf", "mid_id", "mid"), Edge("mid", "root_id", "root"), Edge("tagged", "subject", "root", when="kind = 'root'"),
        Edge("loose", "mid_id", "mid", sets_null=True), Edge("leaf", "x", "not given"),
    ]
    doomed = {"root": t([(5,), (None,), (77,)], "id long")}
    left = {k: sorted(map(tuple, df.collect()), key=str) for k, df in purge_cascade(tables, doomed, edges).items()}
    assert left == {
        "leaf": [(2, 21), (3, None)], "mid": [(21, 6), (22, None)], "root": [(6,), (None,)],
        "tagged": [(2, "other", 5), (3, None, 5)], "loose": [(1, None), (2, 21), (3, None), (4, 99)],
    }
    with pytest.raises(ValueError):
        purge_cascade(tables, doomed, [Edge("leaf", "mid_id", "mid"), Edge("mid", "root_id", "leaf")])
