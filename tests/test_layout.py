"""Cards as blocks -> fields, on the shapes the rules were made for."""

import pytest
from pyspark.sql import functions as F

from cardmill.operators import layout as L
from cardmill.operators.fields import is_useful

SCHEMA = "card_id long, order_index int, text string, left double, top double, right double, bottom double, confidence double"


def blocks(spark, *cards):
    rows = []
    for card_id, lines in enumerate(cards):
        for i, (text, top, height) in enumerate(lines):
            rows.append((card_id, i, text, 10.0, float(top), 310.0, float(top + height), 0.9))
    return spark.createDataFrame(rows, SCHEMA)


WELL_FORMED = [
    ("Medica Books Ltd", 10, 34), ("Rahim Uddin", 60, 26), ("Senior Sales Manager", 92, 16), ("Mob: 01711-223344", 120, 16),
    ("info@medicabooks.com.bd", 142, 16), ("www.medicabooks.com.bd", 164, 16), ("House 42, Road 7, Dhanmondi, Dhaka", 186, 16),
]
STACKED = [("AQUARIUS", 10, 40), ("Pet Shop", 56, 18), ("01711-223344", 100, 16), ("Shop 12, Mirpur, Dhaka", 122, 16)]


@pytest.fixture(scope="module")
def read(spark):
    cards = [
        WELL_FORMED,
        STACKED,
        STACKED[:3],
        STACKED[:2],
        [("Rahim Uddin", 10, 30), ("Medica Books Ltd", 50, 28), ("01711-223344", 90, 16)],
        [("MD. KARIM", 10, 40), ("Karim Traders Ltd", 56, 18), ("Proprietor", 80, 14), ("01711-223344", 110, 16)],
        [("AQUARIUS", 10, 40), ("Pet Shop", 220, 18), ("01711-223344", 260, 16)],
        [("President", 10, 40), ("01711223344", 90, 16)],
        [("Just a line", 10, 20), ("01711-223344", 40, 16), ("call 01711223344", 60, 16)],
        [("Kamal", 10, 20), ("kamal@medica.com", 40, 10), ("12345678", 60, 10)],
    ]
    df = blocks(spark, *cards)
    fields = L.extract_card_fields(df)
    got = {}
    for r in fields.orderBy("stage", F.col("block_indices").getItem(0), "pos").collect():
        got.setdefault(r.card_id, []).append(r)
    left = {}
    for r in L.leftover_blocks(df, fields).collect():
        left.setdefault(r.card_id, set()).add(r.order_index)
    useful = {r.card_id: r.is_useful for r in is_useful(fields).collect()}
    return got, left, useful


def pick(got, card, key):
    return [r.value for r in got[card] if r.field_key == key]


def test_well_formed(read):
    got, left, useful = read
    by_key = {r.field_key: r for r in got[0]}
    assert by_key["phone"].normalized_value == "+8801711223344" and by_key["phone"].value == "01711223344"
    assert by_key["phone"].issue == "digit_restored" and by_key["phone"].raw_text == "01711-223344"
    assert by_key["email"].value == "info@medicabooks.com.bd" and by_key["website"].normalized_value == "medicabooks.com.bd"
    assert by_key["company"].value == "Medica Books Ltd" and by_key["person_name"].value == "Rahim Uddin"
    assert by_key["designation"].value == "Senior Sales Manager"
    assert by_key["address"].value == "House 42, Road 7, Dhanmondi, Dhaka"
    assert abs(by_key["company"].confidence - 0.9 * 0.85) < 1e-12 and abs(by_key["address"].confidence - 0.72) < 1e-12
    assert by_key["company"].region_rect == "10,10,310,44"
    assert 0 not in left and useful[0]


def test_stacked_type(read):
    got, left, _ = read
    assert pick(got, 1, "company") == ["AQUARIUS Pet Shop"] and pick(got, 1, "person_name") == []
    assert pick(got, 2, "company") == ["AQUARIUS Pet Shop"] and pick(got, 2, "person_name") == []
    assert got[3][0].block_indices == [0, 1] and 3 not in left
    assert pick(got, 6, "company") == ["Pet Shop"] and pick(got, 6, "person_name") == ["AQUARIUS"]


def test_people(read):
    got, _, useful = read
    assert pick(got, 4, "company") == ["Medica Books Ltd"] and pick(got, 4, "person_name") == ["Rahim Uddin"]
    assert pick(got, 5, "company") == ["Karim Traders Ltd"] and pick(got, 5, "person_name") == ["MD. KARIM"]
    assert pick(got, 5, "designation") == ["Proprietor"]
    assert pick(got, 7, "designation") == [] and pick(got, 7, "company") == ["President"]
    assert pick(got, 9, "company") == ["Kamal"] and useful[9]


def test_duplicate_phone_leaves_its_block_free(read):
    got, left, _ = read
    assert pick(got, 8, "phone") == ["01711223344"]
    assert pick(got, 8, "company") == ["Just a line"] and 2 in left[8]


def test_huge_card_folds_like_a_small_one(spark, monkeypatch):
    lines = []
    for i in range(120):
        lines += [("BRAND%d" % i, i * 100, 40), ("Pet Shop", i * 100 + 46, 18), ("filler %d" % i, i * 100 + 70, 9)]
    df = L.measured(blocks(spark, lines)).withColumn("domain", F.lit(None).cast("string")).withColumn(
        "looks", L.looks_like_company(F.col("txt"), F.col("domain"))
    )
    usual = {tuple(r.stack.indices) for r in L.merge_stacked(df).collect()}
    monkeypatch.setattr(L, "ORDERED_LINES", 100)
    sliced = [tuple(r.stack.indices) for r in L.merge_stacked(df).collect()]
    assert len(sliced) == len(set(sliced)) and set(sliced) == usual and (0, 1) in usual and len(usual) == 240


def test_passes_merge(spark):
    schema = "card_id long, text string, left double, top double, right double, bottom double"
    primary = spark.createDataFrame([(1, "a", 0.0, 0.0, 400.0, 50.0), (2, "z", 0.0, 0.0, 400.0, 50.0)], schema)
    secondary = spark.createDataFrame(
        [(1, "same", 10.0, 0.0, 300.0, 40.0), (1, "half", 0.0, 26.0, 100.0, 76.0), (1, "below", 0.0, 60.0, 100.0, 90.0),
         (1, "inside", 350.0, 5.0, 390.0, 20.0), (3, "other", 10.0, 0.0, 300.0, 40.0)],
        schema,
    )
    got = L.reading_order(L.merge_passes(primary, secondary)).orderBy("card_id", "order_index").collect()
    assert [(r.card_id, r.text, r.order_index) for r in got] == [
        (1, "a", 0), (1, "half", 1), (1, "below", 2), (2, "z", 0), (3, "other", 0)]
    routed = L.route_scripts(
        spark.createDataFrame([(["latin", "bengali"], ["latin"]), (["bengali"], ["latin"])], "requested array<string>, primary_scripts array<string>")
    ).collect()
    assert [(r.primary_pass, r.secondary_pass) for r in routed] == [(["latin"], ["bengali"]), (["latin"], ["bengali"])]
