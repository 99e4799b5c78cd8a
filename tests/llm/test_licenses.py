"""License scans against every unit compared with every template, without any bound."""

import random
import re
import time

import pytest

from cardmill.llm import licenses
from cardmill.llm.decontaminate import words_of

APACHE = licenses.TEMPLATES["Apache-2.0/header"]
TEXTS = [
    None, "", "\n\n", "plain words of no license at all",
    "Intro ü\nLicensed under the Apache License, Version 2.0.\nmore text here",
    "LICENSED under cc-by NC 4.0!!", "licensed under CC BY 4.0",
    "Title\n\n" + APACHE.replace(" software ", "\nsoftware ") + "\n\nThe end of it",
    APACHE.replace("express", "explicit").replace("writing", "print"), "This work is licensed under the GNU General Public License, version 3.",
    "word " * 50_000 + "\nReleased under the MIT License.", licenses.TEMPLATES["MIT/text"].upper(), "Released under\nthe MIT License.",
]


def dice(a, b):
    a, b = licenses.bigrams(words_of(a)), licenses.bigrams(words_of(b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def brute(text, threshold):
    text = text or ""
    spans, at = {}, 0
    lines = []
    for line in text.split("\n"):
        lines.append((at, at + len(line)))
        at += len(line) + 1
    for a, b in lines:
        if a < b:
            spans.setdefault((a, b), "line")
    run = []
    for a, b in [*lines, (len(text), len(text))]:
        if text[a:b].strip():
            run.append((a, b))
        elif run:
            spans.setdefault((run[0][0], run[-1][1]), "paragraph")
            run = []
    if run:
        spans.setdefault((run[0][0], run[-1][1]), "paragraph")
    if text:
        spans.setdefault((0, len(text)), "text")
    out = []
    for (a, b), unit in sorted(spans.items()):
        score, name = min((-dice(text[a:b], t), name) for name, t in licenses.TEMPLATES.items())
        if -score >= threshold:
            out.append((name, unit, a, b, -score))
    return out


def garbled(rng):
    words = rng.choice(list(licenses.TEMPLATES.values())).split()
    for _ in range(rng.randrange(0, 1 + len(words) // 4)):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], ["other"], [words[k], "extra"]])
    return ("\n" if rng.random() < 0.3 else " ").join(words) + rng.choice(["", "\nnext line", "\n\nnext paragraph"])


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_matches_equal_all_comparisons(spark, threshold):
    rng = random.Random(6)
    texts = TEXTS + [garbled(rng) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, TEXTS[4], "x"), (4, TEXTS[4], "x")], "doc_id long, text string, matches string")
    got = licenses.license_matches(docs, threshold=threshold).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = TEXTS[4] if r["doc_id"] is None else texts[r["doc_id"]]
        assert [tuple(m) for m in r["matches"]] == brute(text, threshold)


def test_no_templates_or_rows(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert [r["matches"] for r in licenses.license_matches(docs, {}).collect()] == [[]]
    assert licenses.license_matches(docs.limit(0)).count() == 0


def paragraphs(text, size=40):
    words = text.split()
    return "\n\n".join("\n".join(" ".join(words[j : j + 10]) for j in range(i, min(i + size, len(words)), 10)) for i in range(0, len(words), size))


def listed(text, threshold=0.8):
    units, runs = licenses.Templates(licenses.TEMPLATES, threshold).scan(text)
    return [(m["template"], text[m["start"] : m["end"]]) for m in units + runs]


@pytest.mark.parametrize("name", ["MIT/text", "ISC/text", "Apache-2.0/header", "GPL-3.0/header"])
def test_licenses_of_several_paragraphs_in_long_documents(name):
    text = paragraphs(licenses.TEMPLATES[name])
    other = " ".join(f"größe{k} der Dinge." for k in range(600))
    found = listed(other + "\n\nint main() {}\n" + text + "\nrest of it " + other)
    assert [x for x in found if x[0] == name] == [(name, text.rstrip(".>/"))]


def test_notices_inside_prose():
    notice = "Released under the MIT License"
    assert listed(f"It was made – with care. {notice}. See below for more of it.") == [("MIT/notice", notice)]
    twice = listed(f"One: {notice}. Two and more words: {notice}! " + "a b " * 5_000 + f"{notice} " * 2_000 + "end of it")
    assert twice == [("MIT/notice", notice)] * 2_002


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_every_run_that_matches_overlaps_one_listed(threshold):
    rng = random.Random(3)
    known = {n: licenses.TEMPLATES[n] for n in ("MIT/notice", "CC-BY-4.0/notice", "GPL-2.0/notice", "MPL-2.0/header")}
    found = licenses.Templates(known, threshold)
    for _ in range(60):
        words = " ".join(rng.choice(list(known.values())) + rng.choice([" ", " a b c ", " a the the "]) for _ in range(2)).split()
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["x"], [words[k], words[k]]])
        text = " ".join(["plain", *words, "words"])
        units, runs = found.scan(text)
        for r in runs:
            assert r["dice"] == pytest.approx(dice(text[r["start"] : r["end"]], known[r["template"]])) and r["dice"] >= threshold
        at = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", text)]
        spans = [(m["start"], m["end"]) for m in units + runs]
        for i in range(len(at)):
            for j in range(i + 1, len(at)):
                a, b = at[i][0], at[j][1]
                if not any(x < b and a < y for x, y in spans):
                    assert max(dice(text[a:b], t) for t in known.values()) < threshold


def test_time_grows_with_the_text():
    templates = licenses._templates(tuple(licenses.TEMPLATES.items()), licenses.DICE)
    line = next(iter(licenses.TEMPLATES.values())).replace("\n", " ")[:60]
    notices = [t for t in licenses.TEMPLATES.values() if "\n" not in t][:3] or [line]
    took = []
    for n in (500, 4000):
        text = "\n".join(f"{notices[i % len(notices)]}" for i in range(n))
        start = time.time()
        found, _ = templates.scan(text)
        took.append(time.time() - start)
        assert found
    assert took[1] < 24 * max(took[0], 0.05)  # in proportion, not eight times eight
