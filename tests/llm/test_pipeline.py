"""The corpus pipeline against its stages' rules on a small corpus, and what each stage must leave alone."""

import random

import corpus_pipeline
from cardmill.llm import secrets

SYLLABLES = {"en": "the of in tion er th sh".split(), "de": "sch und ein ver ße ö".split()}


def write_tables(spark, path):
    rng = random.Random(8)

    def text(lang, n):
        return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(n))

    docs = [(i, text(lang, 80), lang) for i in range(60) for lang in [rng.choice(["en", "de"])]]
    item = text("en", 30)
    docs += [(100, docs[4][1], docs[4][2]), (101, docs[5][1] + " extra", docs[5][2]), (102, "--- 123 ...", "en"), (103, None, "en")]
    docs += [(104, text("en", 40) + " " + item, "en"), (105, text("en", 50) + " password=abcdef123456", None)]
    rows = [(i, t, lang, "src", len(t or "")) for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = dict((i, t) for i, t, _ in write_tables(spark, str(tmp_path)))
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = current.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "MinHash near-dedup", "benchmark decontamination", "secret scans", "packing",
    ]
    want = [{102, 103}, {100, 101}, {104}, set()]
    left = set(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 4:
            break
        left -= want[k]
        assert out.columns == columns and sorted(r["doc_id"] for r in out.collect()) == sorted(left)
        current = out
    texts = {r["doc_id"]: r["text"] for r in current.collect()}
    assert texts == {i: secrets.redact(docs[i]) for i in left} and texts[105].endswith(" [SECRET]")
    assert {r["doc_id"] for r in out.collect()} == left


def test_run_applies_all(spark, tmp_path):
    write_tables(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert ids.isdisjoint({100, 101, 102, 103, 104}) and 105 in ids
    for i in ids:
        own = [r for r in got if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]
