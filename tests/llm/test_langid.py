"""Language ID: the kernel against sets, the ridge solution against a direct one, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np

from cardmill.llm import langid

SYLLABLES = {
    "aa": "ka lo mi ne ru ta".split(), "bb": "sch und ein ver ße ö".split(), "cc": "que ción los ñ ará de".split(),
}


def corpus(n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60))]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


def brute_set(text, features):
    letters = {chr(c): features.symbol[c] for c in {ord(x) for x in text.lower()}}
    out, symbols = set(), []
    for c in text.lower():
        if letters[c] != langid.GAP or not symbols or symbols[-1] != langid.GAP:
            symbols.append(int(letters[c]))
    for order in langid.ORDERS:
        for i in range(len(symbols) - order + 1):
            code = 0
            for s in symbols[i : i + order]:
                code = code * langid.SYMBOLS + s
            out.add((order, code))
    return out


def test_scores_equal_plain_kernel_ridge():
    rows = [(t, lang) for _, t, lang in corpus(90)]
    model = langid.fit_rows(rows)
    features = langid.Featurizer(model.alphabet, model.grams)
    known = {(o, int(c)) for o, codes in zip(langid.ORDERS, model.grams) for c in codes}
    marks, taken = [], {}
    for text, lang in rows:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= langid.LANDMARKS_PER_LANGUAGE:
            marks.append(brute_set(text, features))
    assert set().union(*marks) == known
    sets = [brute_set(t, features) & known for t, _ in rows]
    kernel = lambda xs, ys: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in ys] for x in xs])
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values.max()
    z = kernel(sets, marks) @ (vectors[:, good] / np.sqrt(values[good]))
    target = np.array([[lang == k for k in model.languages] for _, lang in rows], float)
    weight = np.array([len(rows) / (len(model.languages) * sum(lang == x for _, x in rows)) for _, lang in rows])
    coef = np.linalg.solve(z.T @ (z * weight[:, None]) + langid.RIDGE * len(rows) * np.eye(z.shape[1]), z.T @ (target * weight[:, None]))
    want = np.clip((z @ coef).max(axis=1), 0, 1)
    langs, scores = langid.predict_texts([t for t, _ in rows], model)
    assert np.allclose(scores, want, atol=2e-3)
    assert langs == [model.languages[k] for k in (z @ coef).argmax(axis=1)]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 -- !", None), (None, "Kalomi", "aa"), (1003, "日本語", None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + extra], "doc_id long, text string, lang string, score double")
    model = langid.fit(docs)
    got = [tuple(r) for r in langid.predict(docs, model).collect()]
    by_id = {g[0]: g for g in got}
    assert len(got) == len(rows) + len(extra)
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(by_id[i][1] == lang for i, _, lang in out) >= 0.97 * len(out)
    assert [by_id[k][1:] for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by_id[1003][1] in model.languages
    assert all(0 <= g[2] <= 1 for g in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs) is None
    assert [tuple(r) for r in langid.predict(docs, None).collect()] == [(1, "und", 0.0)]
    assert langid.predict(docs.limit(0), None).count() == 0


def test_long_text_is_read_whole():
    model = langid.fit_rows([(t, lang) for _, t, lang in corpus(90)])
    text = "1 " * 400_000 + "verschöund einße undein " * 50
    assert langid.predict_texts([text, "x"], model)[0][0] == "bb"


def test_languages_of_many_scripts():
    rng = random.Random(5)

    def letters(low, n):
        return [c for c in map(chr, range(low, low + 4 * n)) if c.isalpha() and c == c.lower()][:n]

    scripts = {"latin": letters(0x61, 26), "cyrillic": letters(0x430, 40), "greek": letters(0x3B1, 24), "arabic": letters(0x627, 26), "hangul": letters(0xAC00, 300), "han": letters(0x4E00, 600)}
    kinds = {f"{name}{k}": rng.sample(x, len(x) // 2) for name, x in scripts.items() for k in (1, 2)}

    def text(lang):
        return " ".join("".join(rng.choices(kinds[lang], k=rng.randrange(2, 6))) for _ in range(20))

    often = ["latin1", "latin2", "cyrillic1", "cyrillic2"]
    rows = [(text(lang), lang) for lang in kinds for _ in range(60 if lang in often else 30)]
    model = langid.fit_rows(rows)
    assert set(model.alphabet) == {c for t, _ in rows for c in t if c != " "}
    tests = [(text(lang), lang) for lang in kinds for _ in range(20)]
    langs, _ = langid.predict_texts([t for t, _ in tests], model)
    assert sum(got == want for got, (_, want) in zip(langs, tests)) >= 0.97 * len(tests)
