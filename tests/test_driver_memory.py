"""What the driver holds does not grow with the tables: no side of a join that grows with them is broadcast."""

from datetime import datetime

from cardmill import session
from cardmill.operators import graph as G
from cardmill.session import as_side, written
from tests.test_promotion import CARD, FIELD, fields_of
from tests.test_resolve import people_by_loop, random_cards


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graph_of_all_cards_broadcasts_no_table(spark):
    cards = random_cards(8, 30, 12, 0.2)
    fields = written(spark.createDataFrame(fields_of(cards), FIELD))
    known = written(spark.createDataFrame([(c[0], datetime(2024, 1, 1), None) for c in cards], CARD))
    made = G.promote_all(known, fields)
    for name in ("people", "organizations", "contact_points", "cards", "overlaps"):
        assert "BroadcastHashJoin" not in plan(getattr(made, name)), name
    want, _ = people_by_loop(cards)
    assert {r["id"]: r["person_id"] for r in made.cards.collect() if r["person_id"] is not None} == {k: v for k, v in want.items() if v is not None}


def test_small_file_of_many_rows_is_dealt_by_key(spark, monkeypatch):
    monkeypatch.setattr(session, "SENT_ROWS", 100)
    some, many = (written(spark.range(n).toDF("id")) for n in (100, 101))
    left = written(spark.range(1000).toDF("id"))
    assert "BroadcastHashJoin" in plan(left.join(as_side(some), "id", "left"))
    assert "BroadcastHashJoin" not in plan(left.join(as_side(many), "id", "left"))
