"""A promotion works out cards, endpoints and people once, not anew for every table of the graph that the clean-up reads."""

from datetime import datetime

from cardmill.operators import graph as G
from cardmill.streaming import promotion
from tests.test_promotion import CARD, FIELD, fields_of
from tests.test_resolve import people_by_loop, random_cards


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_clean_up_reads_stored_tables(spark, tmp_path):
    cards = random_cards(8, 30, 12, 0.2)
    fields = spark.createDataFrame(fields_of(cards), FIELD)
    known = spark.createDataFrame([(c[0], datetime(2024, 1, 1), None) for c in cards], CARD)
    empty = promotion.stored_graph(promotion.graph_store(spark, str(tmp_path / "graph")))
    links = [f"CAST(NULL AS long) AS {c}" for c in ("person_id", "org_id", "role_id")]
    grown = G.promote_more(empty.with_(cards=known.selectExpr("*", *links)), known.select("id", "captured_at"), fields)
    for name in ("people", "organizations", "roles", "branches", "contact_points", "cards"):
        assert exchanges(getattr(grown, name)) <= 30, name
    want, _ = people_by_loop(cards)
    assert {r["id"] for r in grown.cards.collect() if r["person_id"] is not None} == {k for k, v in want.items() if v is not None}
