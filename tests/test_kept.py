"""Lists and trust kept up to date by streams, against recomputing them."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cardmill.operators import graph
from cardmill.operators.lexical import bm25_topk, build_postings, doc_stats
from cardmill.operators.embedding import token_mean_vectors
from cardmill.plans import stream_queries
from cardmill.streaming import feedback, jobs, lists, search_index

CARD = "id long, captured_at timestamp, deleted_at timestamp, person_id long, org_id long, stamp long"
DAY = datetime(2024, 1, 1)


def card_changes(seed, n):
    rng = random.Random(seed)
    none = lambda x, p=0.15: None if rng.random() < p else x
    return [
        (
            rng.randrange(40), none(DAY + timedelta(days=rng.randrange(50))), none(DAY, 0.8),
            none(rng.randrange(8)), none(rng.randrange(4)), stamp,
        )
        for stamp in rng.sample(range(10 * n), n)
    ]


def test_lists_equal_recomputing_them(spark, tmp_path):
    store = lists.list_store(spark, str(tmp_path / "lists"))
    people = spark.createDataFrame([(i, f"P{i}", 1 if i == 3 else None) for i in range(9)], "id long, display_name string, merged_into_id long")
    orgs = spark.createDataFrame([(i, f"O{i}", None) for i in range(5)], "id long, name string, domain string")
    branches = spark.createDataFrame([(1, 2, "Road", True)], "id long, org_id long, address string, is_primary boolean")
    changes = card_changes(4, 100)
    newest: dict[int, tuple] = {}
    for batch in range(4):
        part = changes[batch * 25 : batch * 25 + 25]
        for row in part:
            if row[0] not in newest or row[5] > newest[row[0]][5]:
                newest[row[0]] = row
        assert lists.apply_card_changes(store, spark.createDataFrame(part, CARD), batch)
        assert not lists.apply_card_changes(store, spark.createDataFrame(changes[:25], CARD), batch)  # a replay
        store.compact()
        cards = spark.createDataFrame(list(newest.values()), CARD)
        assert lists.kept_people_list(store, people).collect() == graph.people_list(people, cards).collect()
        assert lists.kept_org_list(store, orgs, branches).collect() == graph.org_list(orgs, cards, branches).collect()


def test_a_batch_writes_touched_keys_alone(spark, tmp_path):
    store = lists.list_store(spark, str(tmp_path / "lists"))
    many = spark.range(500).select(
        "id", F.lit(DAY).alias("captured_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
        (F.col("id") % 100).alias("person_id"), (F.col("id") % 10).alias("org_id"), F.lit(1).cast("long").alias("stamp"),
    )
    lists.apply_card_changes(store, many, 0)
    moved = spark.createDataFrame([(7, DAY, None, 8, 7, 2), (9, DAY, None, 9, 9, 0)], CARD)  # the second is outdated
    lists.apply_card_changes(store, moved, 1)
    assert store.sizes("cards")[1:] == [(1, 1)]
    assert store.sizes("people_seen")[1:] == [(2, 2)]
    assert store.sizes("orgs_seen")[1:] == [(1, 1)]


def test_trust_counts_repeats_once_and_late_events(spark, tmp_path):
    rng = random.Random(2)
    events = [(i, rng.randrange(5), rng.choice(["useful", "not_relevant", "other", None])) for i in range(120)]
    rows = events + rng.sample(events, 60) + [(500, None, "useful")]
    rng.shuffle(rows)
    folder = tmp_path / "in"
    schema = "event_id long, subject_id long, verdict string"
    for k in range(3):  # one file after the other, the stream stopped and started in between
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(folder))
        store = feedback.trust_store(spark, str(tmp_path / "trust"), "subject_id")
        changes = jobs.read_changes(spark, str(folder), files_per_batch=1)
        feedback.trust_stream(changes, "subject_id", store, str(tmp_path / "state")).awaitTermination()
    want = {}
    for _, s, v in events:
        u, n = want.get(s, (0, 0))
        want[s] = (u + (v == "useful"), n + (v == "not_relevant"))
    got = {r["subject_id"]: (r["useful"], r["not_relevant"]) for r in feedback.current_trust(store).collect()}
    assert got == want
    assert all(abs(r["trust"] - (r["useful"] + 1) / (r["useful"] + r["not_relevant"] + 2)) < 1e-12 for r in feedback.current_trust(store).collect())


TEXT = "subject_id long, stamp long, gone boolean, card_text string, note_text string"


def test_index_equals_indexing_the_newest_texts(spark, tmp_path):
    rng = random.Random(6)
    tokens = spark.createDataFrame([(t, [float(i), 1.0]) for i, t in enumerate(["[UNK]", "a", "b", "c", "d"])], "token string, vector array<float>")
    columns = ["card_text", "note_text"]
    store = search_index.index_store(spark, str(tmp_path / "index"))
    newest: dict[int, tuple] = {}
    text = lambda: rng.choice([None, "", " ".join(rng.choice("abcd") for _ in range(rng.randrange(6)))])
    for batch in range(3):
        rows = [(rng.randrange(12), s, rng.random() < 0.2, text(), text()) for s in rng.sample(range(1000), 10)]
        for r in rows:
            if r[0] not in newest or r[1] > newest[r[0]][1]:
                newest[r[0]] = r
        changes = spark.createDataFrame(rows, TEXT)
        assert search_index.index_changes(store, changes, batch, tokens, columns=columns)
        assert not search_index.index_changes(store, changes, batch, tokens, columns=columns)
        store.compact()
    live = spark.createDataFrame([r for r in newest.values() if not r[2]], TEXT)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    want = build_postings(live, columns)
    assert same(store.read("postings").select(*want.columns), want)
    texts = live.select("subject_id", F.concat_ws(" ", *columns).alias("text"))
    vectors = token_mean_vectors(texts, tokens, "subject_id").select("subject_id", "vector")
    assert same(store.read("vectors").select("subject_id", "vector"), vectors)
    asks = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "")], "query_id long, text string")
    assert same(search_index.stored_lexical_arm(asks, store), bm25_topk(asks, want, doc_stats(live, columns)))

    some = spark.createDataFrame([(r[0],) for r in list(newest.values())[:4]], "subject_id long")
    assert search_index.remove_subjects(store, some, "purge", 0)
    left = {r[0] for r in list(newest.values())[4:]}
    for table in store.keys:
        assert {r["subject_id"] for r in store.read(table).collect()} <= left


def test_stream_files_grow_in_number_and_batches_stay_two(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "ROWS_PER_FILE", 20)
    rows = spark.range(190).withColumn("x", F.lit("y"))
    seen = []
    changes = stream_queries.dealt(spark, rows, str(tmp_path / "in"))
    writer = changes.writeStream.foreachBatch(lambda df, i: seen.append(df.count()))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 2 and sum(seen) == 190
    assert len(spark.read.parquet(str(tmp_path / "in")).inputFiles()) == 10


def test_index_stores_a_row_per_subject(spark, tmp_path):
    store = search_index.index_store(spark, str(tmp_path / "index"))
    texts = [(i, 1, False, "a b a c d", None if i % 2 else "b e") for i in range(6)] + [(9, 1, False, "", None)]
    assert search_index.index_changes(store, spark.createDataFrame(texts, TEXT), 0, columns=["card_text", "note_text"])
    assert store.sizes("postings") == [(7, 7)]
    listed = sorted(tuple(r) for r in store.read("postings").filter("subject_id = 0").select("column", "term", "doc_len", "tf").collect())
    assert listed == [("card_text", "a", 7, 2), ("card_text", "b", 7, 1), ("card_text", "c", 7, 1), ("card_text", "d", 7, 1), ("note_text", "b", 7, 1), ("note_text", "e", 7, 1)]
