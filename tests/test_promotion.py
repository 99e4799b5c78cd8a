"""Promotion in batches: the same people as card by card, a ledger that makes replays harmless, ids that stay."""

from datetime import datetime

import pytest

from cardmill.sources.segments import Segments
from cardmill.streaming import promotion
from tests.test_resolve import people_by_loop, random_cards

CARD = "id long, captured_at timestamp, deleted_at timestamp"
FIELD = "id long, card_id long, field_key string, value string, normalized_value string, source string, value_kind string"
DAY = datetime(2024, 1, 1)


def fields_of(cards):
    out = []
    for card_id, _, name, _, keys in cards:
        items = [("person_name", name, None)] if name else []
        items += [("phone", k, k) for k in keys]
        out += [(card_id * 16 + i, card_id, *item, "printed", "text") for i, item in enumerate(items)]
    return out


def groups(pairs):
    found = {}
    for card, person in pairs:
        if person is not None:
            found.setdefault(person, set()).add(card)
    return sorted(map(sorted, found.values()))


def snapshot(store):
    return {name: sorted(map(str, store.read(name).collect())) for name in store.keys if store.has(name)}


def test_batches_equal_card_by_card(spark, tmp_path, monkeypatch):
    cards = random_cards(8, 30, 12, 0.2)
    fields = spark.createDataFrame(fields_of(cards), FIELD)
    store = promotion.graph_store(spark, str(tmp_path / "graph"))
    people_ids = None
    for batch in range(2):
        part = spark.createDataFrame([(c[0], DAY, None) for c in cards[batch * 15 : batch * 15 + 15]], CARD)
        if batch == 1:  # dies before its commit, then runs again
            with monkeypatch.context() as broken:
                broken.setattr(Segments, "_swap", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    promotion.promote_batch(store, part, fields, batch)
            assert store.applied(promotion.STREAM) == 0
        assert promotion.promote_batch(store, part, fields, batch)
        before = snapshot(store)
        assert not promotion.promote_batch(store, part, fields, batch)
        assert snapshot(store) == before
        ids = {r["id"]: r["display_name"] for r in store.read("people").collect()}
        assert people_ids is None or people_ids.items() <= ids.items()  # nobody is numbered anew
        people_ids = ids
        store.compact()
    want, overlaps = people_by_loop(cards)
    linked = store.read("cards").collect()
    assert groups((r["id"], r["person_id"]) for r in linked) == groups(want.items())
    assert sum(r["promoted"] for r in store.read("batches").collect()) == len(cards)
    points = store.read("contact_points").collect()
    assert len(points) == sum(len(c[4]) for c in cards if want.get(c[0]) is not None)


def test_deleted_cards_and_blank_names(spark, tmp_path):
    store = promotion.graph_store(spark, str(tmp_path / "graph"))
    one = spark.createDataFrame([(1, DAY, None), (2, DAY, DAY)], CARD)
    fields = [(1, 1, "person_name", "Rahim", None, "printed", "text"), (2, 1, "phone", "017", "017", "printed", "text"), (3, 2, "phone", "018", "018", "printed", "text")]
    promotion.promote_batch(store, one, spark.createDataFrame(fields, FIELD), 0)
    assert {(r["id"], r["person_id"]) for r in store.read("cards").collect()} == {(1, 2), (2, None)} or len(store.read("people").collect()) == 1
    person = store.read("people").first()["id"]
    blank = store.read("people").selectExpr("id", "'  ' AS display_name", "merged_into_id")
    store.commit("by hand", 0, {"people": (blank, None)})
    more = fields + [(5, 3, "person_name", "Rahim Uddin", None, "printed", "text"), (6, 3, "phone", "017", "017", "printed", "text")]
    promotion.promote_batch(store, spark.createDataFrame([(3, DAY, None)], CARD), spark.createDataFrame(more, FIELD), 1)
    assert [(r["id"], r["display_name"]) for r in store.read("people").collect()] == [(person, "Rahim Uddin")]
    ledger = {r["batch_id"]: r["founded"] for r in store.read("batches").collect()}
    assert ledger == {0: 1, 1: 0}
