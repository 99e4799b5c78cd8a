"""Whole-table resolution against the card-by-card rule, written down directly as a loop."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cardmill.operators import resolve
from cardmill.operators.ordering import global_position, position_in_group
from cardmill.operators.resolve import duplicate_page, name_creations, resolve_orgs, resolve_people

LEGAL = {"ltd", "limited", "traders"}


def org_name_key(name):
    if name is None:
        return None
    words = [w for w in re.sub("[^a-z0-9]", " ", name.lower()).split() if w not in LEGAL]
    return " ".join(words) or None


def people_by_loop(cards, standing=(), survivors=None, base=0):
    """cards: (card_id, ord, name, linked, keys)."""
    survivors = survivors or {}
    rows = [(k, p, c) for k, p, c in standing]
    answer, pairs = {}, set()
    for card_id, ord_, name, linked, keys in sorted(cards, key=lambda c: c[1]):
        rows = [r for r in rows if r[2] != card_id]
        held = Counter(p for k, p, _ in rows if k in set(keys))
        person = None
        if held:
            order = sorted(held, key=lambda p: (-held[p], p))
            person = survivors.get(order[0], order[0])
            pairs |= {tuple(sorted((person, p))) for p in order[1:] if p != person}
        elif linked is not None:
            person = survivors.get(linked, linked)
        elif name:
            person = base + ord_
        if person is not None:
            rows += [(k, person, card_id) for k in keys]
        answer[card_id] = person
    return answer, pairs


def orgs_by_loop(cards, standing=(), base=0):
    orgs = [list(o) for o in sorted(standing)]
    answer = {}
    for card_id, ord_, company, domain in sorted(cards, key=lambda c: c[1]):
        if company is None and domain is None:
            continue
        for org in orgs:
            if (domain is not None and org[2] == domain) or (
                org_name_key(company) is not None and org_name_key(company) == org_name_key(org[1])
            ):
                if domain is not None and org[2] is None:
                    org[2] = domain
                answer[card_id] = org[0]
                break
        else:
            orgs.append([base + ord_, company or domain, domain])
            answer[card_id] = base + ord_
    return answer, {o[0]: o[2] for o in orgs}


def random_cards(seed, n, n_keys, hot=0.0, linked=None):
    rng = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        keys = [f"k{rng.randrange(n_keys)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))]
        if rng.random() < hot:
            keys.append("hot")
        name = f"n{rng.randrange(5)}" if rng.random() < 0.8 else None
        out.append((i, i, name, linked(rng) if linked else None, keys))
    return out


def run_people(spark, cards, standing=None, survivors=None, base=0):
    df = spark.createDataFrame([c[:4] for c in cards], "card_id long, ord long, name string, linked long")
    ends = spark.createDataFrame([(c[0], k) for c in cards for k in c[4]] or [(-1, "x")], "card_id long, key string")
    stand = None if standing is None else spark.createDataFrame(list(standing), "key string, person_id long, card_id long")
    surv = None if survivors is None else spark.createDataFrame(list(survivors.items()), "person_id long, survivor_id long")
    got, overlaps = resolve_people(df, ends, stand, surv, base)
    return (
        {r.card_id: r.person_id for r in got.collect()},
        {(r.a_id, r.b_id) for r in overlaps.collect()},
    )


@pytest.mark.parametrize("seed,n,n_keys,hot", [(1, 60, 40, 0.0), (2, 80, 15, 0.3), (3, 60, 90, 0.5)])
def test_people_fresh(spark, seed, n, n_keys, hot):
    cards = random_cards(seed, n, n_keys, hot)
    assert run_people(spark, cards) == people_by_loop(cards)


def test_people_on_a_chain(spark):
    cards = [(i, i, f"n{i}", None, [f"k{i}", f"k{i + 1}"]) for i in range(1, 41)]
    got, _ = run_people(spark, cards)
    assert set(got.values()) == {1}


@pytest.mark.parametrize("seed", [4, 5])
def test_people_with_standing_rows_links_and_merges(spark, seed):
    rng = random.Random(seed)
    cards = random_cards(seed, 50, 20, 0.2, lambda r: r.randrange(10) if r.random() < 0.3 else None)
    standing = [(f"k{rng.randrange(20)}", rng.randrange(10), rng.choice([None, 900, rng.randrange(1, 51)])) for _ in range(40)]
    survivors = {3: 1, 7: 2}
    assert run_people(spark, cards, standing, survivors, 100) == people_by_loop(cards, standing, survivors, 100)


@pytest.mark.parametrize("seed", [6, 7])
def test_orgs(spark, seed):
    rng = random.Random(seed)
    name = lambda: None if rng.random() < 0.3 else rng.choice(["রহিম", "Ltd", *[f"firm {j} ltd" for j in range(12)], *[f"Firm {j}" for j in range(12)]])
    host = lambda: None if rng.random() < 0.5 else f"d{rng.randrange(9)}.com"
    cards = [(i, i, name(), host()) for i in range(1, 90)]
    standing = [(0, "firm 3", None), (1, "d2.com", "d2.com"), (2, "firm 3", "d4.com")] if seed == 7 else []
    base = 50 if standing else 0
    df = spark.createDataFrame(cards, "card_id long, ord long, company string, domain string")
    stand = spark.createDataFrame(standing, "org_id long, name string, domain string") if standing else None
    got, domains = resolve_orgs(df, stand, base)
    want, want_domains = orgs_by_loop(cards, standing, base)
    assert {r.card_id: r.org_id for r in got.collect()} == want
    found = {r.org_id: r.domain for r in domains.collect()}
    assert found == {k: v for k, v in want_domains.items() if v is not None}


def test_same_name_pairs_by_page(spark):
    people = spark.createDataFrame(
        [(1, "Md. Rahman"), (2, "Karim"), (4, "Rahman"), (9, "rahman"), (11, "Mr."), (12, "karim"), (15, "RAHMAN")],
        "person_id long, display_name string",
    )
    made = name_creations(people)
    pages = [
        [(r.pair_no, r.a_id, r.b_id) for r in duplicate_page(made, o, 3).orderBy("pair_no").collect()] for o in (0, 3, 6)
    ]
    assert [p[1:] for page in pages for p in page] == [(1, 4), (1, 9), (4, 9), (2, 12), (1, 15), (4, 15), (9, 15)]
    assert [p[0] for page in pages for p in page] == list(range(1, 8))


def test_positions_over_chunks(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") % 3).alias("g"))
    got = position_in_group(df, ["g"], "id", "p", width=50)
    assert got.filter(F.col("p") != F.floor(F.col("id") / 3) + 1).count() == 0
    ranked = global_position(df.repartition(5), [F.desc("id")], "p")
    assert ranked.filter(F.col("p") != 999 - F.col("id")).count() == 0 and ranked.count() == 1000


def jobs_of(spark, run):
    """The result of ``run`` and the number of Spark jobs it took."""
    sc = spark.sparkContext
    group = f"jobs of {id(run)} {random.random()}"
    sc.setJobGroup(group, "")
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("seed,block", [(2, 7), (9, 30)])
def test_people_in_several_blocks(spark, monkeypatch, seed, block):
    monkeypatch.setattr(resolve, "BLOCK", block)
    cards = random_cards(seed, 80, 15, 0.3)
    assert run_people(spark, cards) == people_by_loop(cards)


def test_people_in_several_blocks_with_standing_rows(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 9)
    rng = random.Random(4)
    cards = random_cards(4, 50, 20, 0.2, lambda r: r.randrange(10) if r.random() < 0.3 else None)
    standing = [(f"k{rng.randrange(20)}", rng.randrange(10), rng.choice([None, 900, rng.randrange(1, 51)])) for _ in range(40)]
    survivors = {3: 1, 7: 2, 1: 5, 5: 6}  # a chain: who is hit by way of 3 is told as 1, then as 5, then as 6
    assert run_people(spark, cards, standing, survivors, 100) == people_by_loop(cards, standing, survivors, 100)


def test_jobs_do_not_grow_with_the_turns_that_a_card_waits_for(spark):
    """Each card needs the one before it: decided all at once, every round settled one or two more of them."""

    def waiting(n):
        # Card i holds the keys of its pair's founder once and of the loser twice, so its choice follows the choice before.
        cards = [(1, 1, "a", None, ["k0", "x0"]), (2, 2, "b", None, ["y0", "y0"])]
        for i in range(1, n):
            cards.append((i + 2, i + 2, f"n{i}", None, [f"k{i - 1}", f"y{i - 1}", f"k{i}", f"y{i}"][: 4 if i % 2 else 3]))
        return cards

    few, many = waiting(6), waiting(40)
    got, jobs_few = jobs_of(spark, lambda: run_people(spark, few))
    assert got == people_by_loop(few)
    got, jobs_many = jobs_of(spark, lambda: run_people(spark, many))
    assert got == people_by_loop(many)
    assert jobs_many <= jobs_few + 15
