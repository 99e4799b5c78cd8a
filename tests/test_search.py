"""Ranking arms, fusion, utility, hybrid search and vectors on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardmill.functions import fixed
from cardmill.operators import embedding, lexical, ranking, vectors
from cardmill.plans.search import hybrid_search
from cardmill.operators.fields import card_summaries, needs_indexing

CARDS = [
    (1, "Sonar Bangla Press", "01711223344", "cheap t-shirt printing, did our fest shirts, small orders fine", "Sonar Bangla Press\nShop No:12, New Market"),
    (2, "Dhaka Dental Care", "01911556677", "dentist near campus, expensive but good", None),
    (3, "G AHMED", "01673465717", None, "G AHMED\nPresident\nShop No:278, New Market, Dhaka-1205"),
    (4, "Gone Press", "01811111111", "printing", "printing press"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    cards = spark.createDataFrame([(c[0], c[4], "4" if c[0] == 4 else None) for c in CARDS], "id long, raw_ocr_text string, d string").select(
        "id", "raw_ocr_text", F.lit("2024-01-01").cast("timestamp").alias("captured_at"), F.when(F.col("d").isNotNull(), F.lit("2024-02-02").cast("timestamp")).alias("deleted_at")
    )
    rows = []
    for i, name, phone, _, _ in CARDS:
        rows += [(i * 10, i, "company", name), (i * 10 + 1, i, "phone", phone)]
    fields = spark.createDataFrame(rows, "id long, card_id long, field_key string, value string")
    notes = spark.createDataFrame([(c[0], "card", c[0], c[3], None) for c in CARDS if c[3]], "id long, subject_type string, subject_id long, body string, transcript string")
    docs = lexical.index_text(cards, fields, notes)
    return cards, fields, notes, docs, lexical.build_postings(docs).cache(), lexical.doc_stats(docs)


def ask(spark, corpus, texts, vector=None):
    cards, fields, notes, _, postings, stats = corpus
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    hits = hybrid_search(queries, lexical.bm25_topk(queries, postings, stats), vector, card_summaries(cards, fields, notes), F.lit("2024-01-01").cast("timestamp"))
    out = {i: [] for i in range(len(texts))}
    for r in hits.orderBy("query_id", "rank").collect():
        out[r.query_id].append(r)
    return out


def test_index_text(corpus):
    rows = {r.subject_id: r for r in corpus[3].collect()}
    assert rows[2].card_text == "Dhaka Dental Care\n01911556677" and rows[3].note_text == ""


def test_finds_the_right_card(spark, corpus):
    near = arm(spark, [(2, 3, 0.8)])
    got = ask(spark, corpus, ["printing", "01711-223344", "G AHMED", "dentist", "", "???", "print cheap", "t-shirt", 'quote " inside', "NEAR(x y)", "AND NOT OR", "zzz"], near)
    assert [got[i][0].title if got[i] else None for i in range(8)] == [
        "Sonar Bangla Press", "Sonar Bangla Press", "G AHMED", "Dhaka Dental Care", None, None, "Sonar Bangla Press", "Sonar Bangla Press"]
    assert got[11] == [] and all(h.subject_id != 4 for hits in got.values() for h in hits)
    assert got[0][0].reasons == ["your note", "printing"] and got[2][0].reasons == ["g, ahmed"]
    # without the vector arm the note's "good" outweighs the name, by the published weights
    assert ask(spark, corpus, ["G AHMED"])[0][0].title == "Dhaka Dental Care"
    assert got[6][0].reasons == ["your note", "print, cheap"]
    # one arm, second rank after the deleted card the index still holds; note, default trust, fresh
    assert abs(got[0][0].utility - (0.38 * (61 / 62) / 2 + 0.18 + 0.10 * 0.5 + 0.03)) < 1e-9


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "d"), (4, "e f"), (5, "abc g")], "subject_id long, card_text string")
    queries = spark.createDataFrame([(7, "a b b")], "query_id long, text string")
    postings, stats = lexical.build_postings(docs, ["card_text"]), lexical.doc_stats(docs, ["card_text"])
    got = {r.subject_id: r.score for r in lexical.bm25_topk(queries, postings, stats).collect()}
    avg, n = 10 / 5, 5

    def part(tf, df, length):
        idf = math.log((n - df + 0.5) / (df + 0.5))
        idf = idf if idf > 0 else 1e-6
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))

    want = {1: part(2, 3, 3) + 2 * part(1, 1, 3), 2: part(1, 3, 2), 5: part(1, 3, 2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def arm(spark, rows):
    return lexical.top_k(spark.createDataFrame(rows, "query_id long, subject_id long, score double"), None)


def test_fusion(spark):
    lex, vec = arm(spark, [(1, 1, 9.0), (1, 2, 3.0)]), arm(spark, [(1, 1, 0.9), (1, 3, 0.8)])
    got = ranking.rrf(lex, vec).orderBy("fused_rank").collect()
    assert [(r.subject_id, r.found_by_both, r.semantic_only) for r in got] == [(1, True, False), (2, False, False), (3, False, True)]
    assert abs(got[0].fused_score - 2 / 61) < 1e-15
    scaled = arm(spark, [(1, 1, 9e6), (1, 2, 3e-6)])
    assert [tuple(r) [:2] for r in ranking.rrf(scaled, vec).orderBy("fused_rank").collect()] == [tuple(r)[:2] for r in got]
    assert ranking.rrf(lex, lexical.empty_arm(spark), limit=1).count() == 1
    assert [r.subject_id for r in arm(spark, [(1, 7, 1.0), (1, 3, 1.0), (1, 5, 1.0)]).orderBy("rank").collect()] == [3, 5, 7]


def test_utility(spark):
    one = {n: 1.0 for n in fixed.WEIGHTS}
    rows = [(0, False, False, *one.values()), (1, True, False, *one.values()), (2, True, True, *[0.0] * 8), (3, False, False, float("nan"), 5.0, *[0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, is_expired boolean, is_outdated boolean, " + ", ".join(f"{n} double" for n in one))
    got = ranking.utility(df).withColumn("why", ranking.top_reasons(F.col("contributions"))).orderBy("id").collect()
    assert [round(r.utility, 9) for r in got] == [1.0, 0.5, 0.0, 0.18]
    assert got[0].why == ["semantic", "note_relevance", "category_match"] and got[3].why == ["note_relevance"]
    assert abs(sum(fixed.WEIGHTS.values()) - 1) < 1e-12
    weights = spark.createDataFrame([("semantic", 0.5), ("junk", 9.0)], "key string, value double")
    again = ranking.utility(df.filter("id = 0"), weights).first()
    assert again.utility == 1.0 and abs(again.contributions[0].value - 0.5) < 1e-12
    low = ranking.utility(spark.range(1)).first()
    assert abs(low.utility - (0.05 + 0.015)) < 1e-12


@pytest.mark.parametrize("query_bytes,cells", [(8 << 20, 1), (100, 3)])
def test_cosine_against_brute_force(spark, monkeypatch, query_bytes, cells):
    monkeypatch.setattr(vectors, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(vectors, "CELLS", cells)
    monkeypatch.setattr(vectors, "CELL_ROWS", 10)
    rng = np.random.default_rng(3)
    unit = lambda n: [list(map(float, v / np.linalg.norm(v))) for v in rng.normal(size=(n, 6))]
    qs, cs = unit(8), unit(60)
    cs[10] = cs[20]
    queries = spark.createDataFrame([(i, v, "m") for i, v in enumerate(qs)], "query_id long, vector array<double>, model string")
    corpus = spark.createDataFrame(
        [(i, v, "m") for i, v in enumerate(cs)] + [(99, [1.0], "m"), (98, qs[0], "other"), (97, [None, *qs[0][1:]], "m"), (96, None, "m"), (95, qs[0], None)], "subject_id long, vector array<double>, model string"
    )
    got = {}
    for r in vectors.cosine_topk(queries, corpus.repartition(3), k=7, floor=0.25).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.subject_id)
    for i, q in enumerate(qs):
        scores = [(-round(float(np.dot(q, c)), 9), j) for j, c in enumerate(cs) if np.dot(q, c) >= 0.25]
        assert got.get(i, []) == [j for _, j in sorted(scores)[:7]]


def test_blocks_that_cannot_reach_are_passed_over(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    near = centres[np.repeat(np.arange(6), 300)] + rng.normal(size=(1800, 16)) * 0.05
    near /= np.linalg.norm(near, axis=1)[:, None]
    corpus = spark.createDataFrame([(i, v.tolist(), "m") for i, v in enumerate(near)], "subject_id long, vector array<double>, model string")
    queries = spark.createDataFrame([(i, v.tolist(), "m") for i, v in enumerate(near[::300])], "query_id long, vector array<double>, model string")
    report = vectors.scan_report(queries, corpus.coalesce(1), k=5, floor=0.9).first()
    assert report.skipped > report.blocks / 2
    got = vectors.cosine_topk(queries, corpus, k=5, floor=0.9).collect()
    for i, q in enumerate(near[::300]):
        best = sorted((-round(float(q @ c), 9), j) for j, c in enumerate(near))[:5]
        assert [r.subject_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == [j for _, j in best]
    assert vectors.cosine_topk(queries.limit(0), corpus).count() == 0


def test_quantization(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [1e-3, 2e-3, -127e-3])], "subject_id long, vector array<float>")
    got = {r.subject_id: r for r in vectors.quantize_int8(df).collect()}
    assert got[1].quantized == [64, -127, 0] and got[2].quantized == [0, 0, 0] and got[2].scale == 1.0 and got[3].quantized == [1, 2, -127]
    assert vectors.quantize_quality(df.filter("subject_id <> 2")).first().passes
    moved = df.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.01).cast("float")))
    assert {r.same for r in vectors.vector_parity(df, moved).collect()} == {False}
    assert [r.subject_id for r in vectors.vector_rows(df, "m").orderBy("subject_id").collect()] == [1, 3]
    v = "array<double>"
    trio = spark.createDataFrame([(1, [1.0, 0.0], [0.8, 0.6], [0.0, 1.0]), (2, [1.0, 0.0], [0.3, 0.95], [0.0, 1.0])], f"id long, anchor {v}, related {v}, unrelated {v}")
    assert [r.holds for r in vectors.pairwise_margin(trio).orderBy("id").collect()] == [True, False]


def greedy(word, vocab):
    if len(word) > 100:
        return ["[UNK]"]
    out, start = [], 0
    while start < len(word):
        for end in range(len(word), start, -1):
            piece = ("##" if start else "") + word[start:end]
            if piece in vocab:
                out.append(piece)
                start = end
                break
        else:
            return ["[UNK]"]
    return out


def test_word_pieces_against_greedy_loop(spark):
    rng = random.Random(5)
    vocab = {"[UNK]", "a", "ab", "abc", "##b", "##bc", "##c", "##ca", "b", "ca", "##a", "x" * 101}
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(300)} | {"x" * 101, "ab" * 50}
    tokens = spark.createDataFrame([(v,) for v in sorted(vocab)], "token string")
    got = {}
    for r in embedding.word_pieces(spark.createDataFrame([(w,) for w in words], "word string"), tokens).orderBy("word", "pos").collect():
        got.setdefault(r.word, []).append(r.token)
    assert got == {w: greedy(w, vocab) for w in words}


def test_tokenize_and_mean(spark):
    texts = [(1, "cheap t-shirt printing"), (2, "CAFÉ​ naïve"), (3, "  \n"), (4, "info@medica.com 漢字"), (5, "cheap\x00er cheap")]
    df = spark.createDataFrame(texts, "subject_id long, text string")
    words = {r.subject_id: r.w for r in df.select("subject_id", embedding.words(F.col("text")).alias("w")).collect()}
    assert words == {1: ["cheap", "t", "-", "shirt", "printing"], 2: ["cafe", "naive"], 3: [], 4: ["info", "@", "medica", ".", "com", "漢", "字"], 5: ["cheaper", "cheap"]}
    table = {"cheap": [1.0, 0.0], "##er": [0.0, 3.0], "[UNK]": [0.0, -1.0], "t": [0.5, 0.5]}
    tokens = spark.createDataFrame(list(table.items()), "token string, vector array<float>")
    got = {r.subject_id: r for r in embedding.token_mean_vectors(df, tokens).collect()}
    assert set(got) == {1, 2, 4, 5} and got[5].n_tokens == 3
    want = np.array([2.0, 3.0]) / np.linalg.norm([2.0, 3.0])
    assert np.allclose(got[5].vector, want, atol=1e-6) and np.allclose(got[2].vector, [0, -1])
    sequence = embedding.tokenize(df.filter("subject_id = 5"), tokens).orderBy("position", "piece").collect()
    assert [r.token for r in sequence] == ["cheap", "##er", "cheap"]
    assert embedding.check_token_table(tokens).first().has_unknown


def test_signals_and_ablation(spark):
    subjects = spark.createDataFrame([(1,), (2,)], "subject_id long")
    feedback = spark.createDataFrame([(1, "useful"), (1, "outdated"), (1, "not_relevant")], "subject_id long, verdict string")
    uses = spark.createDataFrame([(1, "used")], "subject_id long, kind string")
    checks = spark.createDataFrame([(1, True), (1, False)], "subject_id long, verified_by_user boolean")
    got = {r.subject_id: r for r in ranking.ranking_signals(subjects, feedback, uses, checks).collect()}
    assert (got[1].trust, got[1].is_outdated, got[1].previous_use, got[1].verified) == (0.5, True, 1.0, 0.5)
    assert (got[2].trust, got[2].is_outdated, got[2].previous_use, got[2].verified) == (0.5, False, 0.0, 0.0)
    moved = ranking.rank_ablation(arm(spark, [(1, 1, 2.0), (1, 2, 1.0)]), arm(spark, [(1, 2, 2.0), (1, 3, 1.0)]))
    assert {r.subject_id: (r.rank_a, r.rank_b, r.moved) for r in moved.collect()} == {1: (1, None, None), 2: (2, 1, 1), 3: (None, 2, None)}


def test_needs_indexing(spark, corpus):
    index = spark.createDataFrame([(1,), (1,)], "subject_id long")
    assert {r.id for r in needs_indexing(corpus[0], index).collect()} == {2, 3}


def test_location_takes_the_nearest_place(spark):
    from cardmill.operators import ranking

    hits = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (3, 10), (1, 10)], "query_id long, subject_id long")
    askers = spark.createDataFrame([(1, "North", "Dhaka", "BD"), (2, "North", None, None), (3, None, None, None)], "query_id long, area string, city string, country string")
    places = spark.createDataFrame(
        [(10, "north", "Dhaka", "BD"), (10, None, "Dhaka", "BD"), (11, "north", "Sylhet", "BD"), (12, "North", "Dhaka", "IN")],
        "subject_id long, area string, city string, country string",
    )
    got = {(r.query_id, r.subject_id): r.location for r in ranking.location_scores(hits, askers, places).collect()}
    assert got == {(1, 10): 1.0, (1, 11): 0.3, (1, 12): 0.0, (2, 10): 1.0, (3, 10): 0.0}
    kinds = lambda key, rows: spark.createDataFrame(rows, f"{key} long, category string")
    same = ranking.category_scores(hits, kinds("query_id", [(1, "food"), (2, None)]), kinds("subject_id", [(10, "food"), (11, "books"), (12, None)]))
    assert {(r.query_id, r.subject_id): r.category_match for r in same.collect()} == {(1, 10): 1.0, (1, 11): 0.0, (1, 12): 0.0, (2, 10): 0.0, (3, 10): 0.0}


def test_place_and_category_are_grouped_once(spark):
    from cardmill.operators import ranking

    table = lambda rows, names: spark.createDataFrame(rows, names)
    hits = table([(1, 10), (1, 11), (2, 12), (1, 10)], "query_id long, subject_id long")
    askers = table([(1, "North", "Dhaka", "BD")], "query_id long, area string, city string, country string")
    places = table([(10, None, "Dhaka", "BD"), (10, "north", "Dhaka", "BD")], "subject_id long, area string, city string, country string")
    asked, offered = table([(1, "food")], "query_id long, category string"), table([(11, "food"), (11, "books")], "subject_id long, category string")
    both = ranking.place_and_category(hits, askers, places, asked, offered)
    assert {tuple(r) for r in both.collect()} == {(1, 10, 1.0, 0.0), (1, 11, 0.0, 1.0), (2, 12, 0.0, 0.0)}
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 4 and plan.count("Aggregate") == 1


def test_scan_of_texts_equals_stored_index_in_several_query_batches(spark, monkeypatch):
    texts = [(1, "a a b", "ab"), (2, "a c", ""), (3, None, "b a"), (4, "abc ab b", "b"), (5, "", ""), (6, "c", "a a")]
    docs = spark.createDataFrame(texts, "subject_id long, card_text string, note_text string")
    columns = ["card_text", "note_text"]
    queries = spark.createDataFrame([(7, "a b b"), (8, "ab"), (9, "c zz"), (10, "!")], "query_id long, text string")
    postings = lexical.build_postings(docs, columns)
    counts = {(r.subject_id, r.column, r.term): r.tf for r in postings.collect()}
    assert counts[1, "card_text", "a"] == 2 and counts[6, "note_text", "a"] == 2 and len(counts) == postings.count()
    assert sorted(map(tuple, lexical.text_term_stats(docs, columns).collect())) == sorted(map(tuple, lexical.term_stats(postings).collect()))
    rows = lexical.texts_by_subject(docs, columns)
    want = sorted(map(str, lexical.bm25_topk(queries, postings, lexical.doc_stats(docs, columns), 3).collect()))
    assert want and want == sorted(map(str, lexical.ranked_scan(queries, rows, rows, 3).collect()))
    everything = [r for r in lexical.scan_scores(queries, rows, rows).collect()]
    assert {r.subject_id for r in everything if r.query_id == 7} == {1, 2, 3, 4, 6}
    assert all(r.score is None for r in everything if r.subject_id == 3)
    monkeypatch.setattr(lexical, "QUERY_CELLS", 1)
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 3)
    assert want == sorted(map(str, lexical.ranked_scan(queries, rows, rows, 3).collect()))
    # Neither the index nor its statistics shuffle a row per (subject, term).
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_mean_vectors_in_blocks_shuffle_no_vector_per_document_and_word(spark, monkeypatch):
    rng = random.Random(8)
    pieces = ["[UNK]", "a", "b", "ab", "##a", "##b", "##ba", "c"]
    tokens = spark.createDataFrame([(t, [rng.uniform(-1, 1) for _ in range(5)]) for t in pieces], "token string, vector array<float>")
    spoken = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(12))) for _ in range(60)]
    texts = [(i % 55, t) for i, t in enumerate(spoken)] + [(90, None), (91, ""), (92, "a" * 101), (93, "cc ! ́")]
    df = spark.createDataFrame(texts, "subject_id long, text string")
    vectors = {r.token: r.vector for r in tokens.collect()}
    want: dict[int, list] = {}
    for r in embedding.tokenize(df, tokens).collect():
        want.setdefault(r.subject_id, []).append(vectors[r.token])
    for chars, rows in ((16 << 20, 1 << 15), (40, 3)):
        monkeypatch.setattr(embedding, "BLOCK_CHARS", chars)
        monkeypatch.setattr(embedding, "SUM_ROWS", rows)
        made = embedding.token_mean_vectors(df, tokens)
        got = {r.subject_id: r for r in made.collect()}
        assert got.keys() == want.keys() and made.count() == len(want)
        for k, vs in want.items():
            total = [sum(x) for x in zip(*vs)]
            norm = math.sqrt(sum(x * x for x in total))
            assert got[k].n_tokens == len(vs) and all(abs(x / norm - y) < 1e-6 for x, y in zip(total, got[k].vector))
    # Vectors meet the texts by block: nothing is summed after a join per (document, word).
    assert "Summarizer" not in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and "aggregate_metrics" not in plan


def test_texts_stay_and_shared_vectors_travel_once(spark, monkeypatch):
    rng = random.Random(4)
    spoken = [f"w{i}" for i in range(40)]
    shared = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(2)]
    table = {w: shared[i % 2] for i, w in enumerate(spoken)}
    tokens = spark.createDataFrame([*table.items(), ("odd", [1.0])], "token string, vector array<float>")
    texts = [(i, " ".join(rng.choices([*spoken, "odd"], k=30))) for i in range(40)]
    monkeypatch.setattr(embedding, "MOST_WORDS", 50)
    made = embedding.token_mean_vectors(spark.createDataFrame(texts, "subject_id long, text string").repartition(3), tokens)
    for r in made.collect():
        said = dict(texts)[r.subject_id].split()
        total = np.sum([table[w] for w in said if w in table], axis=0)
        assert r.n_tokens == 30 and np.allclose(r.vector, total / np.linalg.norm(total), atol=1e-6)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == 40 and "cells" in plan and "regexp_replace" not in plan  # no text is dealt to the blocks
    cells = embedding.packed(np.array([2, 0, 1]), np.array([3, 70000, 1]), np.array([1, 2, 300]))
    assert [x.tolist() for x in embedding.unpacked(cells)] == [[2, 0, 1], [3, 70000, 1], [1, 2, 300]]
    assert [x.tolist() for x in embedding.unpacked(embedding.packed(*[np.array([], np.int64)] * 3))] == [[], [], []]
